"""Readers, writers and streams on small files, with their error rules."""

import os
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import scores, text
from cohortweave.operators import checks, digest, matrix, phenotypes, scorers, splits
from cohortweave.sources import annotation, measurements, packs, tables
from cohortweave.streaming import monitor


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb" if isinstance(content, bytes) else "w") as f:
        f.write(content)
    return path


def test_two_column_files(spark, tmp_path):
    put(tmp_path, "B.txt", "cg1\t0.5\ncg2\tNAN\ncg3\t1.5\n")
    put(tmp_path, "A.txt", "cg1\t.\ncg2\tx\n")
    put(tmp_path, "E.txt", "\n")
    got = measurements.read_two_column(spark, str(tmp_path))
    assert sorted((r.sample_id, r.probe_id, r.beta) for r in got.collect() if r.beta is not None) == [("B", "cg1", 0.5), ("B", "cg3", 1.5)]
    assert got.count() == 5 and measurements.missing_samples(got, ["A", "B", "E", "F"]) == ["E", "F"]


@pytest.mark.parametrize("content", ["cg1\t0.5\ncg1\t0.6\n", "\t0.5\n"])
def test_repeated_and_null_probes_fail(spark, tmp_path, content):
    put(tmp_path, "A.txt", content)
    with pytest.raises(Exception, match="probe"):
        measurements.read_two_column(spark, str(tmp_path)).collect()


def test_no_sample_file_fails(spark, tmp_path):
    with pytest.raises(ValueError, match="no sample rows"):
        measurements.read_two_column(spark, str(tmp_path))


WIDE = "sample_id\tA\tB\tC\nage\t1\t2\t3\ncg1\t.10\tNA\t.30\ncg2\t.11\t.21\t.31\nother\t0\t0\t0\n"


def test_wide_tables_plain_and_zipped(spark, tmp_path):
    plain = put(tmp_path, "w.txt", WIDE)
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("m/w.txt", WIDE)
    for df in (measurements.read_wide(spark, plain, ["C", "A"]), packs.read_wide_zip(spark, str(tmp_path / "w.zip"), "m/w.txt", ["C", "A"])):
        got = sorted((r.row_index, r.sample_id, r.probe_id, r.beta) for r in df.collect())
        assert got == [(0, "C", "cg1", 0.3), (0, "C", "cg2", 0.31), (1, "A", "cg1", 0.1), (1, "A", "cg2", 0.11)]
    with pytest.raises(ValueError, match="not in header"):
        measurements.read_wide(spark, plain, ["Z"])
    with pytest.raises(ValueError, match="sample_id"):
        measurements.read_wide(spark, put(tmp_path, "x.txt", "id\tA\ncg1\t1\n"), ["A"])


def test_tiles_come_back(spark, tmp_path):
    cells = spark.range(2000).select((F.col("id") % 7).alias("row_index"), (F.col("id") * 13 % 997).alias("col_index"), (F.col("id") / 2000).alias("beta")).filter("row_index <> 3 OR col_index < 100")
    measurements.write_tiles(cells, str(tmp_path / "t"), width=64)
    back = measurements.read_tiles(spark, str(tmp_path / "t"), width=64)
    out = matrix.round_trip(back, cells, ["row_index", "col_index"]).first()
    assert (out.n, out.n_mismatch, out.max_diff) == (cells.count(), 0, 0.0)
    assert {r.n for r in spark.read.parquet(str(tmp_path / "t")).select(F.size("tile").alias("n")).distinct().collect()} == {64}


def test_sheets(spark, tmp_path):
    path = put(tmp_path, "s.txt", '"sample_id" "project_id" "age" "secret"\n"1" "GSM1" "P1" "34" "x"\n"2" "GSM2" "P 2" NA "y"\n')
    sheet = tables.read_sheet(spark, path)
    assert [tuple(r) for r in sheet.orderBy("sample_id").collect()] == [("GSM1", "P1", "34", "x"), ("GSM2", "P 2", None, "y")]
    out = tables.normalised_sheet(sheet, "age", "age", "s.txt").orderBy("sample_id").collect()
    assert [(r.study_id, r.phenotype_value, r.phenotype_value_numeric, r.phenotype_family) for r in out] == [("P1", "34", 34.0, "age"), ("P 2", None, None, "age")]
    assert tables.safe_fields(sheet).columns == ["sample_id", "age"]
    with pytest.raises(KeyError, match="bmi"):
        tables.normalised_sheet(sheet, "bmi", "bmi", "s.txt")


def test_associations_and_square_tables(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "id\ttrait\n1\tcaf\xe9\n2\tx\ty\n3\n".encode("latin-1"))
    rows, n = tables.read_associations(spark, path)
    assert sorted((r.id, r.trait) for r in rows.collect() if r.trait) == [("1", "café"), ("2", "x")] and tuple(n.first()) == (3, 2)
    square = tables.read_square(spark, put(tmp_path, "q.tsv", "t\ta.b\tc\na.b\t1\tNA\nc\t0.5\t1\n"))
    assert sorted(tuple(r) for r in square.collect()) == [("a.b", "a.b", 1.0), ("c", "a.b", 0.5), ("c", "c", 1.0)]


def test_arrow_files(spark, tmp_path):
    t = pa.Table.from_pandas(pd.DataFrame({"GSM_ID": ["a", "b"], "x": [0.5, None], "y": [1, 2]}))
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    got = packs.read_arrow(spark, str(tmp_path / "t.arrow"), "GSM_ID string, x double").collect()
    assert [(r.GSM_ID, r.x) for r in got][0] == ("a", 0.5) and len(got) == 2


def test_gtf_islands_and_bed(spark, tmp_path):
    gtf = '#x\nchr1\ts\tgene\t10\t20\t.\t+\t.\tgene_id "G.1"; gene_id "H.2"; gene_biotype "protein_coding"; note bare;\nchr1\tshort\n'
    r = annotation.read_gtf(spark, put(tmp_path, "g.gtf", gtf)).collect()
    assert [(x.gene_id, x.gene_type, x.start, x.end) for x in r] == [("H.2", "protein_coding", 10, 20)]
    lines = "585\tchr1\t100\t200\tn\nchr2\t5\t9\tm\n#c\n"
    got = annotation.parse_islands(spark.read.text(put(tmp_path, "i.txt", lines))).collect()
    assert sorted(tuple(x) for x in got) == [("chr1", 101, 200), ("chr2", 6, 9)]
    regions = spark.createDataFrame([("r", "g", "gene_body", "chr1", 100, 200, "+")], "region_id string, gene_id string, region_type string, chromosome string, start long, end long, strand string")
    annotation.write_bed(regions, str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first().value == "chr1\t99\t200\tr\t0\t+\tg\tgene_body"


def test_platform_lists_go_by_line(spark, tmp_path):
    o, c = put(tmp_path, "o.tsv", "Probe_ID\ncg1\ncg2\n"), put(tmp_path, "c.tsv", "CpG_chrm\tCpG_beg\nchr1\t99\nNA\tNA\n")
    got = {r.probe_id: (r.chromosome, r.position, r.mapping_status) for r in annotation.read_platform(spark, o, c).collect()}
    assert got == {"cg1": ("chr1", 100, "mapped"), "cg2": (None, None, "unmapped")}
    with pytest.raises(Exception, match="length"):
        annotation.read_platform(spark, o, put(tmp_path, "d.tsv", "h\tb\nchr1\t1\n")).collect()


def test_tables_and_upserts(spark, tmp_path):
    path = str(tmp_path / "x")
    idx = spark.createDataFrame([(0, "a"), (1, "b")], "row_index long, sample_id string")
    tables.write_index(idx, path, ["row_index", "sample_id"], "row_index", 2)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match=r"0\.\.2"):
        tables.write_index(idx, path, ["row_index"], "row_index", 3)
    with pytest.raises(KeyError, match="nope"):
        tables.write_table(idx, path, ["nope"])
    old = spark.createDataFrame([("e1", "h0"), ("e2", "h0")], "entry_id string, sha256 string")
    new = spark.createDataFrame([("e1", "h1", 1), ("e1", "h2", 2), ("e3", "h1", 1)], "entry_id string, sha256 string, seq int")
    assert {tuple(r) for r in tables.upsert(old, new, "entry_id").collect()} == {("e1", "h2"), ("e2", "h0"), ("e3", "h1")}
    entries = spark.createDataFrame([("a", "age", " S2 ,S1,"), ("b", "sex", "")], "entry_id string, family string, study_ids string")
    assert [r.study_ids for r in tables.registry_rows(tables.select_entries(entries, family="age")).collect()] == ["S1,S2"]
    d = digest.table_digest(idx, ["row_index", "sample_id"]).first()
    assert d == digest.table_digest(idx.orderBy(F.desc("row_index")), ["row_index", "sample_id"]).first()


def test_log_stream_and_status(spark, tmp_path):
    log = tmp_path / "log"
    os.makedirs(log)
    put(log, "a.jsonl", '{"epoch": 1, "train_f1": 0.5, "lr": 0.1}\nbroken {\n[1]\n{"epoch": "x"}\n{"epoch": 2, "train_macro_f1": 0.7, "train_f1": 0.1}\n')
    rows = tables.parse_epochs(spark.read.text(str(log))).orderBy("epoch").collect()
    assert [(r.epoch, r.train_f1, r.learning_rate) for r in rows] == [(1, 0.5, 0.1), (2, 0.7, None)]
    stamps = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2020-01-01 00:01:40'), (2, TIMESTAMP '2020-01-01 00:02:10') AS t(epoch, first_at)")
    assert tuple(monitor.time_left(stamps, 10).first()) == (2, 30.0, 240.0)
    s = spark.sql("SELECT * FROM VALUES (true, true, 3), (false, true, 0), (false, false, 2), (false, false, 0) AS t(f, a, n)")
    assert [r[0] for r in s.select(monitor.run_status(F.col("f"), F.col("a"), F.col("n"))).collect()] == ["finished", "running", "stalled", "waiting"]


def test_windowed_counts_stream(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 1200) AS ts, 'x' AS event_type, 1.0D AS value FROM range(6)").write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = monitor.windowed_counts(ev).writeStream.outputMode("complete").format("memory").queryName("ev_counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("ev_counts").collect()) == [3, 3]


def test_text_rules(spark):
    d = spark.createDataFrame([("cg1_TC21\n", "\tMT", "", " . ", "NAN", "a_b")], "p string, c string, e string, n string, v string, t string")
    r = d.select(text.probe_stem(F.col("p")), text.contig_name(F.col("c")), text.location_key(F.col("e"), F.lit(10)), text.contig_name(F.col("n")), text.parse_measure(F.col("v")), text.donor_of(F.col("t"))).first()
    assert tuple(r) == ("cg1", "chrM", None, None, None, "b")
    for bad in (text.sex_label(F.lit("other")), text.donor_of(F.lit("none"))):
        with pytest.raises(Exception, match="sex label|donor"):
            d.select(bad).collect()
    assert d.select(text.sex_label(F.lit(" ")), text.valid(F.lit(None), "commit")).first()[:] == (None, False)


def test_splits(spark):
    rows = spark.createDataFrame([(f"x{i}", s) for i, s in enumerate("AAAAABBBCCDE")], "sample_id string, study_id string")
    roles = {r.study_id: r.role for r in splits.auto_split(rows, seed=7).collect()}
    assert set(roles) == set("ABCDE") and set(roles.values()) == set(splits.ROLES) and splits.leaking(splits.auto_split(rows, seed=7)).isEmpty()
    with pytest.raises(ValueError, match="two roles"):
        splits.explicit_split(rows, {"train": ["A"], "validation": ["A"]})
    with pytest.raises(ValueError, match="without a role"):
        splits.explicit_split(rows, {"train": ["A"]})
    with pytest.raises(ValueError, match="unknown donors"):
        splits.donor_split(rows.withColumn("title", F.lit("t_1")), ["9"])


def test_labels_fail_loudly(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b")], "row_index long, sample_id string")
    one = phenotypes.row_labels(spark.createDataFrame([("a", "S", "34")], "sample_id string, study_id string, phenotype_value string"))
    onto = spark.createDataFrame([("blood", 0)], "label string, class_id int")
    with pytest.raises(Exception, match="no study|no label"):
        phenotypes.unified_table(index, one, one.limit(0), one.limit(0), onto).collect()
    with pytest.raises(Exception, match="many-to-one"):
        phenotypes.unified_table(index, one.unionByName(one), one.limit(0), one.limit(0), onto).collect()
    with pytest.raises(ValueError, match="no label has"):
        phenotypes.ontology(onto, "label", 2)
    with pytest.raises(ValueError, match="without samples"):
        phenotypes.cohort(spark.createDataFrame([("a", "S")], "sample_id string, study_id string"), ["T"], 1)
    with pytest.raises(KeyError, match="x"):
        checks.require_columns(index, ["x"])


def test_metrics_edges(spark):
    d = spark.createDataFrame([(5, 0.1), (9, 0.9), (9, 0.8)], "y int, s double")
    assert scores.auroc(scores.two_classes(d, "y"), "s", "y").first()[0] == 1.0
    with pytest.raises(ValueError, match="two classes"):
        scores.two_classes(d.filter("y = 5"), "y")
    assert scores.regression_scores(d.limit(1).withColumn("k", F.lit(1)), "y", "s", ["k"]).first().r is None
    w = {r.c: r.weight for r in scores.class_weights(spark.createDataFrame([("a",), ("a",)], "c string"), "c", spark.createDataFrame([("a",), ("b",)], "c string")).collect()}
    assert w == {"a": 0.75, "b": 1.5}
    s = spark.createDataFrame([("p", "g", 0.9)], "sample string, gene string, score double")
    grid = scorers.with_absent(s, spark.createDataFrame([("p",), ("q",)], "sample string"), spark.createDataFrame([("g",)], "gene string"), "sample", "gene").orderBy("sample").collect()
    assert [(r.score, r.present) for r in grid] == [(0.9, True), (0.5, False)]
    assert scores.multitask_loss(d.limit(0), {"t": (F.col("s"), F.lit(True), 1.0)}).first().loss == 0.0
