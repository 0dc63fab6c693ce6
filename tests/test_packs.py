"""Zips streamed and Arrow files in runs of batches: results, error rules, flat memory, byte ranges."""

import gzip
import io
import zipfile

import pyarrow as pa
import pytest

from cohortweave.sources import measurements, packs, tables

WIDE = "sample_id\tA\tB\tC\nage\t1\tx y\t3\ncg1\t.10\tNA\t.30\nshort\t1\ncg2\t.11\t.21\t.31\nother\t0\t0\t0\n"


def zipped(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".txt", text)
    return str(path)


def cells(df):
    return sorted((r.row_index, r.sample_id, r.probe_id, r.beta) for r in df.collect())


WANT = [(0, "C", "cg1", 0.3), (0, "C", "cg2", 0.31), (1, "B", "cg1", None), (1, "B", "cg2", 0.21)]


def test_places_of_a_pack(spark, tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "p.txt").write_text(WIDE)
    (tmp_path / "packed").mkdir()
    zipped(tmp_path / "packed" / "p.zip", p=WIDE)
    with gzip.open(tmp_path / "g.txt.gz", "wt") as f:
        f.write(WIDE)
    none = (str(tmp_path / "nothing"), "p.txt")
    for place in ((str(tmp_path / "plain" / "p.txt"), None), (str(tmp_path / "plain"), "p.txt"), (str(tmp_path / "packed"), "p.txt"),
                  (f"file://{tmp_path}/packed/p.zip", None), (str(tmp_path / "g.txt.gz"), None)):
        assert cells(measurements.read_pack(spark, [none, place], ["C", "B"])) == WANT
    assert packs.locate([none, (str(tmp_path / "plain"), "p.txt"), (str(tmp_path / "packed"), "p.txt")])[0] == "folder"
    with pytest.raises(FileNotFoundError):
        packs.locate([none])


def test_zips_of_a_folder_by_member(spark, tmp_path):
    zipped(tmp_path / "a.zip", m__w=WIDE, other="x")
    zipped(tmp_path / "b.zip", m__w=WIDE.replace("cg", "cgb"))
    df = packs.read_wide_zip(spark, str(tmp_path), "m/w.txt", ["A"])
    assert df.rdd.getNumPartitions() == 2 and sorted(r.probe_id for r in df.collect()) == ["cg1", "cg2", "cgb1", "cgb2"]


@pytest.mark.parametrize("text, says", [
    (WIDE.replace(".31", "n/a"), "n/a"), (WIDE.replace("cg2\t.11\t.21\t.31", "cg2\t.11"), "Expected 4 columns"), ("id\tA\ncg1\t1\n", "not sample_id"),
    ("sample_id\tA\ncg1\t1\n", "not in header"), ("sample_id\tB\tC\nage\t1\t2\n", "no row with prefix")])
def test_pack_faults(spark, tmp_path, text, says):
    with pytest.raises(Exception, match=says):
        packs.read_wide_zip(spark, zipped(tmp_path / "w.zip", w=text), None, ["C", "B"]).collect()


def test_bad_tokens_and_empty_files_fail(spark, tmp_path):
    (tmp_path / "w.txt").write_text(WIDE.replace(".31", "n/a"))
    assert len(measurements.read_wide(spark, str(tmp_path / "w.txt"), ["A", "B"]).collect()) == 4
    with pytest.raises(Exception, match="not a number: n/a"):
        measurements.read_wide(spark, str(tmp_path / "w.txt"), ["C"]).collect()
    with pytest.raises(Exception, match="no nope"):
        packs.read_wide_zip(spark, zipped(tmp_path / "w.zip", w=WIDE), "nope", ["A"]).collect()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("cg1\t0.5\n")
    (tmp_path / "s" / "b.txt").write_text("")
    with pytest.raises(ValueError, match="b.txt"):
        measurements.read_two_column(spark, str(tmp_path / "s"))


def test_memory_stays_flat(tmp_path):
    path = tmp_path / "big.zip"
    samples = [f"S{i}" for i in range(200)]
    row = "\t".join(["0.123456"] * 200)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("w.txt", "w") as f:
        f.write(("sample_id\t" + "\t".join(samples) + "\n").encode())
        for i in range(0, 120_000, 1000):
            f.write("".join(f"cg{i + k}\t{row}\n" for k in range(1000)).encode())
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("w.txt").file_size > 200e6
        with z.open("w.txt") as raw:
            names = packs.header_of(raw.readline().decode(), ["S7", "S3"])
            seen = most = 0
            before = pa.total_allocated_bytes()
            for batch in packs.wide_batches(raw, names, ["S7", "S3"], "cg"):
                seen += batch.num_rows
                most = max(most, pa.total_allocated_bytes() - before)
    assert seen == 240_000 and most < 60e6


def test_sheet_in_a_zip(spark, tmp_path):
    text = '"sample_id" "project_id" "age"\n"1" "GSM1" "P 1" "34"\n"2" "GSM2" "P2" NA\n'
    sheet = tables.read_sheet(spark, zipped(tmp_path / "s.zip", b=text, c="other"))
    assert [tuple(r) for r in sheet.orderBy("sample_id").collect()] == [("GSM1", "P 1", "34"), ("GSM2", "P2", None)]


class Counting(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def arrow_file(path, n=64, rows=1000):
    kind = pa.schema([("k", pa.string()), ("x", pa.float64()), ("pad", pa.binary()), ("d", pa.dictionary(pa.int32(), pa.string()))])
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, kind) as w:
        for i in range(n):
            d = pa.array(["u"] * rows).dictionary_encode()
            w.write(pa.record_batch([pa.array([f"{i}-{j}" for j in range(rows)]), pa.array([i + j / rows for j in range(rows)]), pa.array([bytes([i]) * 200] * rows), d], schema=kind))
    return str(path)


def test_arrow_files_split_by_batches(spark, tmp_path):
    path = arrow_file(tmp_path / "t.arrow")
    df = packs.read_arrow(spark, path, "x double, k string, d string", task_bytes=1 << 20)
    assert df.rdd.getNumPartitions() >= 8
    rows = df.collect()
    assert len(rows) == 64_000 and {(r.k, r.x) for r in rows} == {(f"{i}-{j}", i + j / 1000) for i in range(64) for j in range(1000)} and {r.d for r in rows} == {"u"}
    with pytest.raises(Exception, match="not in the file"):
        packs.read_arrow(spark, path, "nope int").collect()
    with pytest.raises(FileNotFoundError):
        packs.read_arrow(spark, str(tmp_path / "none"), "x double")


def test_a_task_reads_its_own_ranges(tmp_path):
    data = open(arrow_file(tmp_path / "t.arrow"), "rb").read()
    target = pa.schema([("x", pa.float64())])
    source = Counting(data)
    got = list(packs.arrow_batches(pa.PythonFile(source, "r"), 10, 14, target))
    assert [b.column("x")[0].as_py() for b in got] == [10.0, 11.0, 12.0, 13.0]
    assert source.total < len(data) * 4 / 64 + 200_000
