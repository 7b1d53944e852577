"""Stored analyses that follow their inputs: what has changed is analysed again, and only that.

A store is a folder of runs. A run holds whole buckets of documents (by a hash of the id), and its commit, written last, names them; of a
bucket the last committed run counts. So a run that dies leaves the store as it was, and its number is used again; one that is
repeated finds nothing to do. Each row keeps a fingerprint of what it was made from: the version of the analysis, the text, and what
else the caller names, such as the rules learned for its category.

Scale: fingerprints meet by id; of the buckets that a change touches the other rows are copied, without being analysed. A store has a
fixed number of buckets, so a change of a few documents writes a few buckets, each about 1/buckets of the store.

Documents without an id are left out; of rows that repeat an id the first by fingerprint counts; documents that are gone leave the store;
a null text is an input like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.shipping import ship
from ledgerloom.streaming.queue import existing

OWN = "doc_id long, fingerprint string"


def current_runs(spark: SparkSession, store: str) -> DataFrame:
    """bucket and run: which run counts for each bucket."""
    return existing(spark, f"{store}/commits", "bucket int, run int").groupBy("bucket").agg(F.max("run").alias("run"))


def stored(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of a store: doc_id, fingerprint, bucket and the columns of the analysis (schema: theirs, without doc_id)."""
    fields = ", ".join([OWN, *(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "doc_id"), "bucket int", "run int"])
    rows = existing(spark, f"{store}/data", fields)
    return rows.join(F.broadcast(current_runs(spark, store)), ["bucket", "run"], "left_semi").drop("run")  # one row a bucket


def reanalyze(docs: DataFrame, store: str, analyze: Callable[[DataFrame], DataFrame], version: str, also: Column | None = None, buckets: int = 256) -> int:
    """Brings a store up to date with docs (doc_id, text and others) and returns how many documents were analysed.

    analyze: one row for each document that it is given, with doc_id. also: what else a row's analysis depends on, as text. buckets is
    the store's, from its first run on.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = [F.lit(version), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("-")), F.coalesce((also if also is not None else F.lit("")).cast("string"), F.lit("-"))]
    marked = docs.filter("doc_id IS NOT NULL").withColumns({"fingerprint": F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), "bucket": F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets)).cast("int")})
    marked = marked.dropDuplicates(["doc_id", "fingerprint"])
    first = marked.groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"))
    marked = marked.join(first, ["doc_id", "fingerprint"])
    schema = analyze(docs.limit(0)).schema
    had = stored(spark, store, schema)
    run = (existing(spark, f"{store}/commits", "bucket int, run int").agg(F.max("run")).first()[0] or 0) + 1
    # what is new, what differs, and what is gone
    both = marked.select("doc_id", "bucket", F.col("fingerprint").alias("now")).join(had.select("doc_id", F.col("bucket").alias("was_in"), "fingerprint"), "doc_id", "full")
    changes = both.filter(~F.col("now").eqNullSafe(F.col("fingerprint"))).select("doc_id", F.coalesce("bucket", "was_in").alias("bucket"), F.col("now").isNotNull().alias("there"))
    changes.write.mode("overwrite").parquet(f"{store}/changes/run={run}")
    changes = spark.read.parquet(f"{store}/changes/run={run}")
    touched = changes.select("bucket").distinct()
    if touched.isEmpty():
        return 0
    fresh = marked.join(changes.filter("there").select("doc_id"), "doc_id", "left_semi")
    made = analyze(fresh.drop("fingerprint", "bucket")).join(fresh.select("doc_id", "fingerprint", "bucket"), "doc_id")
    kept = had.join(F.broadcast(touched), "bucket", "left_semi").join(changes.select("doc_id"), "doc_id", "left_anti")  # at most `buckets` rows
    names = ["doc_id", "fingerprint", *(f.name for f in schema.fields if f.name != "doc_id"), "bucket"]
    made.select(names).unionByName(kept.select(names)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/run={run}")
    touched.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/run={run}")
    return changes.filter("there").count()
