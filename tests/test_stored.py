"""Table digests, stored tables that are replaced in place, log streams that restart, and run states by timers."""

import glob
import os
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortweave.operators.digest import table_digest
from cohortweave.sources import releases
from cohortweave.sources.stored import StoredTable, upsert_checksums
from cohortweave.streaming import monitor


def digest(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return tuple(table_digest(df, df.columns).first())


def test_digest_is_of_a_multiset(spark):
    one = "k string"
    assert digest(spark, [("a",), ("a",)], one) != digest(spark, [("b",), ("b",)], one)
    assert digest(spark, [("a",), ("b",)], one) == digest(spark, [("b",), ("a",)], one)
    assert digest(spark, [("a",)], one)[1] != digest(spark, [("a",)] * 3, one)[1]
    assert digest(spark, [], one) == (0, "0" * 32)
    two = "k string, v string"
    cases = [("a", None), (None, "a"), ("a", ""), ("", "a"), ("null", "a"), ("a;string 1:b", "c"), ("a", "b;string 1:c"), (None, None)]
    assert len({digest(spark, [c], two) for c in cases}) == len(cases)
    assert digest(spark, [(1,)], "k int") != digest(spark, [(1,)], "k long") != digest(spark, [("1",)], one)
    nested = "k array<int>, b binary, d decimal(9,2), s struct<x:int,y:string>"
    rows = [([1, None], b"\0", None, (1, None)), ([1], b"\0", None, (1, None)), ([1, None], b"\0", None, (None, "1")), ([1, None], None, None, None)]
    assert len({digest(spark, [r], nested) for r in rows}) == len(rows)


def test_digest_adds_up_over_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("t"))
    assert len({table_digest(df.repartition(n), ["id", "t"]).first() for n in (1, 3, 40)}) == 1
    halves = [int(table_digest(df.filter(c), ["id", "t"]).first().digest, 16) for c in ("id < 1000", "id >= 1000")]
    assert int(table_digest(df, ["id", "t"]).first().digest, 16) == sum(halves) % 2**128


def test_release_with_repeated_rows_is_told_apart(spark, tmp_path):
    path, made = str(tmp_path / "r"), {"sample_index": "row_index long, sample_id string", "locus_index": "col_index long, locus_id long"}
    tables = {"sample_index": spark.createDataFrame([(1, "a"), (1, "a")], made["sample_index"]), "locus_index": spark.createDataFrame([(1, None)], made["locus_index"])}
    releases.write_release(tables, path, releases.INDEX)
    assert releases.release_faults(spark, path, releases.INDEX) == []
    spark.createDataFrame([(2, "b"), (2, "b")], made["sample_index"]).write.mode("overwrite").parquet(f"{path}/sample_index.parquet")
    spark.createDataFrame([(None, 1)], made["locus_index"]).write.mode("overwrite").parquet(f"{path}/locus_index.parquet")
    assert [f.split(":")[0] for f in releases.release_faults(spark, path, releases.INDEX)] == ["sample_index", "locus_index"]


SUMS = "entry_id string, download_path string, sha256 string, bytes long, seq int"


def folders(path):
    return sorted(os.path.basename(p) for p in glob.glob(f"{path}/v-*"))


def test_stored_upserts_onto_itself(spark, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t")
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    upsert_checksums(table, spark.createDataFrame([("e1", "p", "h1", 1, 1), ("e2", "p", "h1", 1, 1)], SUMS))
    upsert_checksums(table, spark.createDataFrame([("e1", "p", "h2", 2, 1), ("e1", "p", "h3", 3, 2)], SUMS))
    upsert_checksums(table, spark.createDataFrame([("e3", "p", "h4", 4, 1)], SUMS))
    assert sorted((r.entry_id, r.sha256) for r in table.read().collect()) == [("e1", "h3"), ("e2", "h1"), ("e3", "h4")]
    assert len(folders(tmp_path / "t")) == 1 and not glob.glob(f"{tmp_path}/t/.*.tmp")
    with pytest.raises(KeyError, match="sha256"):
        upsert_checksums(table, spark.createDataFrame([("e3", 1)], "entry_id string, seq int"))


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t")
    table.write(spark.range(5), tag="one")
    held = table.read()
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        table.write(bad)
    assert table.state()["notes"] == {"tag": "one"} and held.count() == table.read().count() == 5 and len(folders(tmp_path / "t")) == 1
    kept = StoredTable(spark, f"file://{tmp_path}/t", keep=1)
    kept.write(table.read().filter("id > 2"))
    assert held.count() == 5 and table.read().count() == 2 and len(folders(tmp_path / "t")) == 2
    table.write(spark.range(1))
    assert len(folders(tmp_path / "t")) == 1


def test_a_second_writer_is_told(spark, tmp_path, monkeypatch):
    a, b = StoredTable(spark, f"file://{tmp_path}/t"), StoredTable(spark, f"file://{tmp_path}/t")
    a.write(spark.range(1))
    states = iter([a.state(), {}])
    monkeypatch.setattr(b, "state", lambda: next(states))
    with pytest.raises(RuntimeError, match="was replaced"):
        b.write(spark.range(9))
    assert a.read().count() == 1 and len(folders(tmp_path / "t")) == 1


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    spare = f"{folder}/.{name}.tmp"
    with open(spare, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(spare, f"{folder}/{name}")


def test_log_stream_restarts(spark, tmp_path):
    log, table, cp = str(tmp_path / "log"), StoredTable(spark, f"file://{tmp_path}/t"), str(tmp_path / "cp")

    def go():
        monitor.keep_log(monitor.log_stream(spark, log), table, cp).awaitTermination()
        return sorted((r.run, r.epoch, r.train_loss, r.train_f1) for r in table.read().collect())

    put(f"{log}/r1", "m-1.jsonl", '{"epoch": 1, "train_loss": 3, "train_f1": 0.1}', "broken {", "[1]", '{"epoch": "x"}', "")
    put(f"{log}/r2", "m-1.jsonl", '{"epoch": 1, "train_loss": 9}')
    assert go() == [("r1", 1, 3.0, 0.1), ("r2", 1, 9.0, None)]
    first = {(r.run, r.epoch): r.first_at for r in table.read().collect()}
    put(f"{log}/r1", "m-2.jsonl", '{"epoch": 2, "train_loss": 2}', '{"epoch": 1, "train_loss": 2.5}')
    two = [("r1", 1, 2.5, None), ("r1", 2, 2.0, None), ("r2", 1, 9.0, None)]
    assert go() == two and go() == two
    assert {(r.run, r.epoch): r.first_at for r in table.read().collect()}["r1", 1] == first["r1", 1]
    version = table.state()["version"]
    newest = max(int(f) for f in os.listdir(f"{cp}/commits") if f.isdigit())
    os.remove(f"{cp}/commits/{newest}")  # as after a crash between the table's swap and the stream's own commit
    crc = f"{cp}/commits/.{newest}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert go() == two and table.state()["version"] == version
    shutil.rmtree(cp)  # another stream reads all again: the same rows
    assert go() == two and len(table.state()["notes"]) == 2


def test_a_log_that_grows_in_place(spark, tmp_path):
    log, table = str(tmp_path / "log"), StoredTable(spark, f"file://{tmp_path}/t")
    put(f"{log}/r", "metrics.jsonl", '{"epoch": 1, "lr": 0.5}')
    monitor.read_log(spark, log, table)
    before = table.read().first()
    put(f"{log}/r", "metrics.jsonl", '{"epoch": 1, "lr": 0.5}', '{"epoch": 2, "learning_rate": 0.25}')
    monitor.read_log(spark, log, table)
    got = sorted((r.epoch, r.learning_rate, r.first_at) for r in table.read().collect())
    assert [g[:2] for g in got] == [(1, 0.5), (2, 0.25)] and got[0][2] == before.first_at < got[1][2]


def test_run_states_by_timer(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    put(f"{log}/other", "config.yaml", "training: {}")
    put(f"{log}/run", "m-1.jsonl", '{"epoch": 1}', '{"epoch": 2}')
    states = monitor.run_states(monitor.log_stream(spark, log), stall=2)
    q = states.writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    def wait(run, status):
        until = time.time() + 90
        while time.time() < until:
            if any(r.run == run and r.status == status for r in seen):
                return [r for r in seen if r.run == run][-1]
            if q.exception():
                raise q.exception()
            time.sleep(0.2)
        raise AssertionError((run, status, seen))

    try:
        assert wait("run", "running").n_epochs == 2
        assert wait("other", "waiting").latest is None
        stalled = wait("run", "stalled")
        assert (stalled.latest, stalled.n_epochs) == (2, 2)
        put(f"{log}/run", "m-2.jsonl", '{"epoch": 4}', '{"epoch": 3}')
        until = time.time() + 90
        while not any(r.latest == 4 and r.status == "running" for r in seen) and time.time() < until:
            time.sleep(0.2)
        row = next(r for r in seen if r.latest == 4 and r.status == "running")
        assert row.n_epochs == 3 and row.seconds_per_epoch > 0
        put(f"{log}/run", "metrics.json", "{}")
        assert wait("run", "finished").latest == 4
        order = [r.status for r in seen if r.run == "run"]
        assert [s for i, s in enumerate(order) if i == 0 or order[i - 1] != s][:4] in (["running", "stalled", "running", "finished"], ["running", "stalled", "running", "stalled"])
    finally:
        q.stop()


def test_pace_spans_epochs(spark):
    assert monitor._pace([(1, 100.0), (2, 130.0)]) == 30 and monitor._pace([(1, 0.0), (3, 60.0), (4, 60.0)]) == 30 and monitor._pace([(1, 5.0)]) is None
    stamps = spark.createDataFrame([(1, datetime(2020, 1, 1, 0, 0, 0)), (3, datetime(2020, 1, 1, 0, 1, 0))], "epoch int, first_at timestamp")
    assert tuple(monitor.time_left(stamps, 10).first()) == (3, 30.0, 210.0)
