"""Python data sources for files that Spark has no reader for: tables inside zips, streamed, and Arrow files, by runs of batches.

They open files in tasks through pyarrow's file systems (local folders, HDFS, object stores), by ranges: a zip's central directory
and then one member, an Arrow file's footer and then the batches of one task. Nothing is held whole.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import NO_VALUE

CELLS = "probe_id string, row_index int, sample_id string, beta double"
LINES = "file string, number long, value string"
BLOCK = 4 << 20  # bytes of text parsed at a time; a header must be no longer


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def files_under(path: str, suffix: str) -> list[str]:
    """The file, or the folder's files with the suffix, in order."""
    fs, p = _file_system(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(p)) if x.is_file and x.base_name.endswith(suffix))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _open(path: str) -> pa.NativeFile:
    fs, p = _file_system(path)
    return fs.open_input_file(p)


@dataclass
class FilePart(InputPartition):
    """A file, and for Arrow files the run of its record batches."""

    path: str
    first: int = 0
    last: int = 0


def header_of(line: str, sample_ids: list[str]) -> list[str]:
    """The header's names; it must start with sample_id and hold every wanted sample."""
    names = line.rstrip("\r\n").split("\t")
    if names[0] != "sample_id":
        raise ValueError(f"the header starts with {names[0]!r}, not sample_id")
    have = set(names)
    if missing := [s for s in sample_ids if s not in have]:
        raise ValueError(f"samples not in header: {missing[:5]}")
    return names


def wide_batches(member, names: list[str], sample_ids: list[str], prefix: str, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """CELLS of a wide table's open stream after its header line: only the wanted columns are parsed, a block at a time.

    NA tokens are null; any other text that is no number fails, and so does a probe row with another number of fields than the header.
    Rows whose name lacks the prefix are passed over, whatever they hold.
    """
    def ragged(row) -> str:
        return "error" if row.text.startswith(prefix) else "skip"

    wanted = list(dict.fromkeys(sample_ids))
    reader = pyarrow.csv.open_csv(
        member, pyarrow.csv.ReadOptions(use_threads=False, block_size=block, column_names=names),
        pyarrow.csv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=True, invalid_row_handler=ragged),
        pyarrow.csv.ConvertOptions(include_columns=["sample_id", *wanted], column_types={c: pa.string() for c in ("sample_id", *wanted)}, strings_can_be_null=False))
    tokens = pa.array(NO_VALUE, pa.string())
    for batch in reader:
        batch = batch.filter(pc.starts_with(batch.column("sample_id"), prefix))
        probes = batch.column("sample_id")
        for i, s in enumerate(sample_ids):
            text = pc.utf8_trim_whitespace(batch.column(s))
            beta = pc.cast(pc.if_else(pc.is_in(text, tokens), None, text), pa.float64())
            beta = pc.if_else(pc.is_nan(beta), None, beta)
            yield pa.RecordBatch.from_arrays([probes, pa.array([i] * len(probes), pa.int32()), pa.array([s] * len(probes), pa.string()), beta], names=["probe_id", "row_index", "sample_id", "beta"])


def member_stream(archive: zipfile.ZipFile, path: str, member: str | None, suffix: str = ".txt"):
    """The member as a stream, by name or the first with the suffix; an archive without it fails."""
    names = [member] if member else sorted(n for n in archive.namelist() if n.lower().endswith(suffix))[:1]
    if not names or names[0] not in archive.namelist():
        raise FileNotFoundError(f"no {member or suffix} in {path}")
    return archive.open(names[0])


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.member = json.loads(options["paths"]), options.get("member")
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in self.paths]


class _WideReader(_ZipReader):
    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        samples, prefix = json.loads(self.options["samples"]), self.options["prefix"]
        with _open(partition.path) as f, zipfile.ZipFile(f) as z, member_stream(z, partition.path, self.member) as raw:
            found = 0
            names = header_of(raw.readline(BLOCK).decode("utf-8", "replace"), samples)
            for batch in wide_batches(raw, names, samples, prefix):
                found += batch.num_rows
                yield batch
            if samples and not found:
                raise ValueError(f"no row with prefix {prefix} in {partition.path}")


class _LineReader(_ZipReader):
    def read(self, partition: FilePart) -> Iterator[tuple]:
        with _open(partition.path) as f, zipfile.ZipFile(f) as z, member_stream(z, partition.path, self.member) as raw:
            for i, line in enumerate(io.TextIOWrapper(raw, self.options.get("encoding", "utf-8"), "replace")):
                yield partition.path, i, line.rstrip("\r\n")


class WideZip(DataSource):
    """Wide tables inside zips, a task each: options paths (JSON list), member, samples (JSON list), prefix."""

    @classmethod
    def name(cls) -> str:
        return "wide_zip"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WideReader(self.options)


class ZipLines(DataSource):
    """Lines of a member of each zip, a task each: options paths (JSON list), member (else the first .txt), encoding."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options)


def arrow_batches(source, first: int, last: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches first to last (exclusive) of an open Arrow file, with just the target's columns, cast to its types."""
    with pa.ipc.open_file(source) as f:
        have = f.schema.names
    if missing := [n for n in target.names if n not in have]:
        raise ValueError(f"columns not in the file: {missing[:5]}")
    at = sorted(have.index(n) for n in target.names)
    with pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=at)) as f:
        for i in range(first, last):
            batch = f.get_batch(i)
            yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in target], schema=target)


class _ArrowReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths, self.bytes, self.schema = json.loads(options["paths"]), int(options["bytes"]), schema

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.paths:
            with _open(path) as source:
                with pa.ipc.open_file(source) as f:
                    n = f.num_record_batches
                runs = max(1, min(n, -(-source.size() // self.bytes)))
            edges = [n * i // runs for i in range(runs + 1)]
            parts += [FilePart(path, a, b) for a, b in zip(edges, edges[1:]) if a < b]
        return parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as source:
            yield from arrow_batches(source, partition.first, partition.last, to_arrow_schema(self.schema))


class ArrowFiles(DataSource):
    """Arrow IPC files, a task for each run of record batches: options paths (JSON list), bytes (of a file that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options, schema)


def read_wide_zip(spark: SparkSession, path: str, member: str | None, sample_ids: list[str], probe_prefix: str = "cg") -> DataFrame:
    """CELLS of a member of each zip under path (a zip or a folder of zips): only wanted samples and probe rows; row_index is the order asked for.

    A zip is a task, which inflates the member as a stream and parses the wanted columns block by block. A zip without the member (None:
    its first .txt), a sample that is not there, a token that is no number, a short probe row, and a zip without probes fail the job.
    """
    spark.dataSource.register(WideZip)
    paths = files_under(path, ".zip")
    named = {"member": member} if member else {}
    return spark.read.format("wide_zip").options(paths=json.dumps(paths), samples=json.dumps(sample_ids), prefix=probe_prefix, **named).load()


def read_zip_lines(spark: SparkSession, path: str, member: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """(file, number, value): the lines of a member of each zip under path, streamed."""
    spark.dataSource.register(ZipLines)
    named = {"member": member} if member else {}
    return spark.read.format("zip_lines").options(paths=json.dumps(files_under(path, ".zip")), encoding=encoding, **named).load()


def read_arrow(spark: SparkSession, path: str, schema: str, task_bytes: int = 64 << 20) -> DataFrame:
    """The schema's columns of Arrow files (a file, or a folder of .arrow files); a file is split into runs of record batches.

    A task reads its own batches' bytes of these columns; a column that a file lacks, or whose values do not cast, fails the job.
    """
    spark.dataSource.register(ArrowFiles)
    paths = files_under(path, ".arrow")
    return spark.read.format("arrow_files").schema(schema).options(paths=json.dumps(paths), bytes=str(task_bytes)).load()


def locate(places: list[tuple[str, str | None]], suffix: str = ".txt") -> tuple[str, str]:
    """(kind, path) of the first of places that is there: a text file, a text file by name in a folder, or a zip.

    places: (path, name), where name is the file to look for if path is a folder. kind is file, folder or zip. None there is an error.
    """
    for path, name in places:
        fs, p = _file_system(path)
        kind = fs.get_file_info(p).type
        if kind == pafs.FileType.File:
            return ("zip" if path.lower().endswith(".zip") else "file"), path
        if kind == pafs.FileType.Directory and name:
            for found in (name, f"{name}.gz", f"{name.removesuffix(suffix)}.zip"):
                if fs.get_file_info(f"{p.rstrip('/')}/{found}").type == pafs.FileType.File:
                    return ("zip" if found.endswith(".zip") else "folder"), f"{path.rstrip('/')}/{found}"
    raise FileNotFoundError(f"none of {[p for p, _ in places]} is there")
