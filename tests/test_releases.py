"""Releases against their manifests, and sample sheets by place."""

import pytest

from cohortweave.sources import releases


def test_release_round_trip_and_faults(spark, tmp_path):
    path = str(tmp_path / "r")
    tables = {
        "sample_index": spark.createDataFrame([(0, "a", "x")], "row_index long, sample_id string, extra string"),
        "locus_index": spark.createDataFrame([(0, 5), (1, 6)], "col_index long, locus_id long"),
    }
    made = releases.write_release(tables, path, releases.INDEX)
    assert made["locus_index"]["rows"] == 2 and releases.release_faults(spark, path, releases.INDEX) == []
    assert releases.read_release(spark, path, releases.INDEX)["sample_index"].columns == ["row_index", "sample_id"]
    spark.createDataFrame([(0, 5), (1, 7)], "col_index long, locus_id long").write.mode("overwrite").parquet(f"{path}/locus_index.parquet")
    spark.createDataFrame([(0,)], "row_index long").write.mode("overwrite").parquet(f"{path}/sample_index.parquet")
    faults = releases.release_faults(spark, path, {**releases.INDEX, "loci": ("locus_id",)})
    assert [f.split(":")[0] for f in faults] == ["sample_index", "locus_index", "loci"] and "digest" in faults[1]


def test_sheets_from_the_first_place(spark, tmp_path):
    sheet = tmp_path / "b.txt"
    sheet.write_text('"sample_id" "project_id" "sex"\n"1" "GSM1" "P1" "F"\n')
    out = releases.export_families(spark, {"sex": ([str(tmp_path / "a.txt"), str(sheet)], "sex")}, str(tmp_path / "o"))
    r = spark.read.parquet(out[0]).first()
    assert (r.sample_id, r.study_id, r.phenotype_value, r.source_file) == ("GSM1", "P1", "F", "b.txt")
    with pytest.raises(FileNotFoundError):
        releases.first_existing(spark, [str(tmp_path / "none")])
