"""A store that follows its documents: only what has changed moves, and a run that dies changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import reanalysis

SCHEMA = "doc_id long, text string, category string"


def docs(spark, change=()):
    rows = {i: (i, f"text {i}", "ab"[i % 2]) for i in range(40)}
    for r in change:
        rows[r[0]] = r
    return spark.createDataFrame([r for r in rows.values() if r[1] != "gone"], SCHEMA)


def analysis(note, seen=None):
    def run(df):
        return df.select("doc_id", F.length("text").alias("n"), F.lit(note).alias("note"))

    return run


def rows_of(spark, store):
    schema = analysis("")(spark.createDataFrame([], SCHEMA)).schema
    return {r.doc_id: (r.n, r.note) for r in reanalysis.stored(spark, store, schema).collect()}


def test_only_changes_move(spark, tmp_path):
    store, go = str(tmp_path / "store"), lambda d, note, **o: reanalysis.reanalyze(d, store, analysis(note), o.pop("version", "1"), buckets=8, **o)
    assert go(docs(spark), "first") == 40 and len(rows_of(spark, store)) == 40
    assert go(docs(spark), "second") == 0 and {n for _, n in rows_of(spark, store).values()} == {"first"}
    assert go(docs(spark, [(3, "longer text", "b"), (50, None, "a"), (7, "gone", "b")]), "third") == 2
    got = rows_of(spark, store)
    assert got[3] == (11, "third") and got[50] == (None, "third") and 7 not in got and len(got) == 40 and sum(n == "third" for _, n in got.values()) == 2
    written = [d for d in os.listdir(f"{store}/data/run=2") if d.startswith("bucket=")]
    assert len(written) <= 3
    assert go(docs(spark, [(3, "longer text", "b"), (50, None, "a"), (7, "gone", "b")]), "fourth") == 0


def test_versions_and_rules(spark, tmp_path):
    store = str(tmp_path / "store")
    rules = lambda a: F.when(F.col("category") == "a", F.lit(a)).otherwise("-")
    go = lambda note, version, a: reanalysis.reanalyze(docs(spark), store, analysis(note), version, rules(a), buckets=4)
    assert go("x", "1", "rule one") == 40
    assert go("y", "1", "rule two") == 20  # those of category a
    assert go("y", "1", "rule two") == 0
    assert go("z", "2", "rule two") == 40 and {n for _, n in rows_of(spark, store).values()} == {"z"}


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    reanalysis.reanalyze(docs(spark), store, analysis("good"), "1", buckets=4)

    def dies(df):
        return df.select("doc_id", F.length("text").alias("n"), F.when(F.col("doc_id") == 9, F.raise_error(F.lit("dies"))).otherwise("bad").alias("note"))

    with pytest.raises(Exception, match="dies"):
        reanalysis.reanalyze(docs(spark), store, dies, "2", buckets=4)
    assert {n for _, n in rows_of(spark, store).values()} == {"good"}
    assert reanalysis.reanalyze(docs(spark), store, analysis("new"), "2", buckets=4) == 40
    assert {n for _, n in rows_of(spark, store).values()} == {"new"} and len(rows_of(spark, store)) == 40


def test_odd_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(None, "no id", "a"), (1, "x", "a"), (1, "x", "a"), (1, "other", "a"), (2, "", "b")], SCHEMA)
    assert reanalysis.reanalyze(rows, store, analysis("q"), "1") == 2
    assert reanalysis.reanalyze(rows, store, analysis("q"), "1") == 0 and len(rows_of(spark, store)) == 2
    assert reanalysis.reanalyze(rows.limit(0), store, analysis("q"), "1") == 0 and rows_of(spark, store) == {}
