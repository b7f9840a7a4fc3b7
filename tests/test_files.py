"""Readers and file audits on small files with nulls, comments, repeats and faults."""

import pytest
from pyspark.sql import functions as F

from driftlens.sources import files


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_tables_by_ending(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for ending in (".csv", ".csv.gz", ".jsonl", ".ndjson", ".parquet"):
        path = str(tmp_path / f"t{ending}")
        files.write_table(frame, path)
        assert sorted(map(tuple, files.read_table(spark, path, "k int, v string").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="no table format"):
        files.read_table(spark, "x.xls", "k int")


def test_measurements(spark, tmp_path):
    path = put(tmp_path, "m.csv", "# note\nv,code,n,c\n1,A1C,1,5\n2,,0,many\n")
    assert sorted(map(tuple, files.measurements(spark, path, "code", "n", "c").collect())) == [("1", "A1C", 1, 5.0), ("2", "", 0, None)]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.measurements(spark, path, "code", "n", "c", {"z"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.measurements(spark, put(tmp_path, "bad.csv", "v,code,n,c\n1,A1C,x,5\n"), "code", "n", "c").collect()
    with pytest.raises(ValueError, match="repeats"):
        files.unique_index(spark, put(tmp_path, "i.csv", "a,b\n1,x\n1,y\n"), {"b"}, ["a"])


def test_folders(spark, tmp_path):
    put(tmp_path / "assays", "a.csv", "code,v\nA1C,1\n")
    put(tmp_path / "assays", "b.csv", "code,v\nA2C,2\n")
    index = spark.createDataFrame([("a.csv", "p")], "file string, panel string")
    assert [tuple(r) for r in files.assays(spark, str(tmp_path / "assays"), index, "file", "code string, v int").collect()] == [("a.csv", "A1C", 1, "p")]
    for folder, text in (("fold_random_5", "m\nA1C\nA1C\n"), ("fold_modulo_5", "m\nA1C\n"), ("elsewhere", "m\nA1C\n")):
        put(tmp_path / "folds" / folder, "a.csv", text)
    got = files.fold_scores(spark, str(tmp_path / "folds"), "m string", "m").collect()
    assert sorted((r["split"], r["repeats"]) for r in got) == [("modulo_position", 1), ("random_variant", 2), ("random_variant", 2)]


def test_targets(spark, tmp_path):
    path = put(tmp_path, "t.fa", ">one first protein\nacd\nEF*\n\n>two\r\nGG\r\n")
    assert sorted((r["target_id"], r["sequence"], r["sequence_length"]) for r in files.fasta(spark, path).collect()) == [("one", "ACDEF", 5), ("two", "GG", 2)]
    wide = spark.createDataFrame([("A1C", "0.5", "1", "x"), ("A1C:D2E", "1", "1", "1"), ("D2E", "NaN", "2", "2")], "m string, y string, p string, q string")
    assert sorted(map(tuple, files.predictor_panel(wide, "m", "y", set()).collect())) == [("A1C", 1, 0.5, "p", 1.0), ("A1C", 1, 0.5, "q", None)]


def test_audits(spark, tmp_path):
    for name in "abc":
        put(tmp_path / "m", name, name * 3)
    found = files.manifest(spark, str(tmp_path / "m"))
    expected = found.filter("file <> 'c'").withColumn("sha256", F.when(F.col("file") == "a", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("d", 3, "x")], "file string, bytes bigint, sha256 string"))
    assert dict(map(tuple, files.verify(expected, found).collect())) == {"a": "hash", "b": "verified", "c": "unexpected", "d": "missing"}
    keys = spark.createDataFrame([(t, v) for t in "pqrs" for v in (1, 2)], "t string, v int")
    cached = spark.createDataFrame([("p", 1, 0.1), ("p", 2, 0.2), ("q", 1, 0.1), ("q", 1, 0.1), ("r", 1, 0.1), ("r", 2, None), ("x", 1, 0.1)], "t string, v int, s double")
    assert {r["t"]: r["status"] for r in files.cache_audit(keys, cached, "t", "v", "s").collect()} == {"p": "valid", "q": "invalid", "r": "invalid", "s": "missing"}
    made, status = files.outcome_scan(cached, keys, "t", "v", "s")
    assert made.count() == 4 and {r["t"]: (r["variants"], r["status"]) for r in status.collect()}["s"] == (0, "no_finite_outcomes")
