"""Tables that are replaced while they are read: each version is a folder, and a pointer file names the one that counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import require_columns
from .tables import upsert

POINTER = "current.json"
CHECKSUMS = ("entry_id", "download_path", "sha256", "bytes")


class StoredTable:
    """A Parquet table under `path`, in any store that Spark writes.

    A write makes a new folder from whatever it reads, the table itself too, and then swaps the pointer by one rename: readers see
    the old version or the new one, never a part. A write that fails leaves the old version as it was. Older versions go after the
    swap, save the last `keep`, for readers that still hold them. Writers take turns; one that finds another's version fails.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 0):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _at(self, *names: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def state(self) -> dict:
        """The pointer: version, its number, and what write() was told to note; empty where there is no table yet."""
        fs, p = self._at(POINTER)
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.state())

    def read(self) -> DataFrame:
        """The current version; it stays readable while the next is written."""
        now = self.state()
        if not now:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{now['version']}")

    def _swap(self, state: dict) -> None:
        jvm = self.spark._jvm
        fs, spare = self._at(f".{uuid.uuid4().hex}.tmp")
        out = fs.create(spare, True)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        _, pointer = self._at(POINTER)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(pointer).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(spare), fs.makeQualified(pointer), how)

    def _versions(self) -> list[str]:
        fs, top = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith("v-"))

    def _delete(self, version: str) -> None:
        fs, p = self._at(version)
        fs.delete(p, True)

    def write(self, df: DataFrame, **notes) -> None:
        """Make df the table; notes are kept in the pointer, so they change with the rows or not at all."""
        before = self.state()
        number = before.get("number", 0) + 1
        version = f"v-{number:010d}-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.path}/{version}")
            if self.state() != before:
                raise RuntimeError(f"the table at {self.path} was replaced while this version was written")
        except BaseException:
            self._delete(version)
            raise
        self._swap({"number": number, "version": version, "notes": notes})
        old = [v for v in self._versions() if v != version]
        for v in old[: len(old) - self.keep]:
            self._delete(v)

    def upsert(self, rows: DataFrame, key: str, **notes) -> None:
        """Put rows (with seq, their order) into the table, a row for each key; the first call makes the table."""
        old = self.read() if self.exists() else rows.drop("seq").limit(0)
        self.write(upsert(old, rows, key), **notes)


def upsert_checksums(table: StoredTable, rows: DataFrame) -> None:
    """Put download checksums into their stored table; the last row (by seq) of an entry_id counts. All of CHECKSUMS must be there."""
    table.upsert(require_columns(rows, [*CHECKSUMS, "seq"]).select(*CHECKSUMS, "seq"), "entry_id")
