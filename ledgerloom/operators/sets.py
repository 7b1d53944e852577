"""Multiset differences, preference joins, voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def bag_difference(new: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of new that stored rows don't absorb: each stored row absorbs one with equal keys (nulls equal nulls).

    Stored rows are counted by key before the join, so a frequent key sends one row for each task.
    """
    counts = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_c")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = numbered(new, keys, order).join(counts, same, "left")
    return joined.filter(F.col("_n") > F.coalesce("_c", F.lit(0))).select(*new.columns)


def surplus(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n: how many rows of each key bag_difference() keeps, counted on both sides in one shuffle."""
    both = new.select(*keys, F.lit(1).alias("_n")).unionByName(stored.select(*keys, F.lit(-1).alias("_n")))
    return both.groupBy(*keys).agg(F.sum("_n").alias("n")).filter("n > 0")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return numbered(df, keys, order).filter("_n = 1").drop("_n")


def vote(df: DataFrame, group: list[str], value: str, weight: str, place: str) -> DataFrame:
    """The value with most weight in each group, of equal ones the one that came first."""
    sums = df.groupBy(*group, value).agg(F.sum(weight).alias("votes"), F.min(place).alias("first"))
    best = F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("first")))
    return sums.groupBy(*group).agg(best.alias("b")).select(*group, F.col(f"b.{value}").alias(value), "b.votes")


def reply_edges(letters: DataFrame, refs: DataFrame) -> DataFrame:
    """src, dst: each reference's target, by canonical number; a target of the reference's date first, else the first.

    letters: id, key, letter_date; refs: src, key, ref_date, letter_date. A target is no letter of itself, nor a later one.
    """
    targets = letters.select(F.col("id").alias("dst"), "key", F.col("letter_date").alias("dst_date"))
    found = refs.join(targets, "key").filter("src <> dst").filter("dst_date IS NULL OR letter_date IS NULL OR dst_date <= letter_date")
    match = F.coalesce(F.col("dst_date") == F.col("ref_date"), F.lit(False))
    best = F.min(F.struct((~match).cast("int").alias("other"), "dst"))
    return found.groupBy("src", "key").agg(best.alias("b")).select("src", F.col("b.dst").alias("dst"))


def vote_numbers(readings: DataFrame, group: list[str]) -> DataFrame:
    """The number that several readings agree on most: group, year, seq, suffix and votes.

    readings: group, year, seq (digits as text), suffix, weight, place. Zeros that a reading has stuck to a number's end are misread dots,
    so 12870 also counts for 1287, with its own votes. Of equal ones the shorter stands, then the first. The suffix is the most frequent
    one among the year's readings that begin with the number.
    """
    keys = [*group, "year"]
    counts = readings.groupBy(*keys, "seq").agg(F.sum("weight").alias("own"), F.min("place").alias("first"))
    zeros = F.length(F.regexp_extract("seq", "(0*)$", 1))
    cuts = F.transform(F.sequence(F.lit(0), F.least(zeros, F.length("seq") - 1)), lambda n: F.substring(F.col("seq"), F.lit(1), F.length("seq") - n))
    also = counts.select(*keys, F.explode(cuts).alias("seq"), "own").groupBy(*keys, "seq").agg(F.sum("own").alias("votes"))
    both = counts.join(also, [*keys, "seq"])
    best = both.groupBy(*group).agg(F.max_by(F.struct("year", "seq", "votes"), F.struct("votes", -F.length("seq"), -F.col("first"))).alias("b")).select(*group, "b.*")
    ends = readings.filter("suffix IS NOT NULL AND suffix <> ''").select(*keys, F.col("seq").alias("read"), "suffix", "weight", "place")
    tied = best.join(ends, keys).filter(F.startswith("read", "seq")).groupBy(*group, "suffix").agg(F.sum("weight").alias("w"), F.min("place").alias("p"))
    said = tied.groupBy(*group).agg(F.max_by("suffix", F.struct("w", -F.col("p"))).alias("suffix"))
    return best.join(said, group, "left").select(*group, "year", "seq", "suffix", "votes")


def vote_dates(readings: DataFrame, group: list[str], years: DataFrame | None = None, plausible: tuple[int, int] = (1350, 1460)) -> DataFrame:
    """The date that several readings agree on: group, year, month, day and whole (whether one reading has it so).

    readings: group, y, m, d (whole numbers, as read), weight, place. Where some reading is a date in itself, these are voted on as they
    are; where none is, year, month and day are each voted on among the values that can be, with years (group, y), those of the numbers,
    as further votes. No date where one of the three has no such value.
    """
    y, m, d = F.col("y").between(*plausible), F.col("m").between(1, 12), F.col("d").between(1, 31)
    good = y & m & d & ((F.col("m") <= 6) | (F.col("d") <= 30))
    date = F.struct("y", "m", "d")
    whole = vote(readings.filter(good).withColumn("date", date), group, "date", "weight", "place").select(*group, F.col("date").alias("whole"))
    parts = readings.select(*group, F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.when(ok, F.col(c)).alias("v")) for c, ok in (("y", y), ("m", m), ("d", d))))).alias("x"), "weight", "place").select(*group, "x.part", "x.v", "weight", "place")
    if years is not None:
        more = years.filter(F.col("y").between(*plausible)).select(*group, F.lit("y").alias("part"), F.col("y").cast(parts.schema["v"].dataType).alias("v"), F.lit(1).alias("weight"), F.lit(1 << 30).alias("place"))
        parts = parts.unionByName(more)
    each = vote(parts.filter("v IS NOT NULL"), [*group, "part"], "v", "weight", "place")
    apart = each.groupBy(*group).agg(*(F.max(F.when(F.col("part") == c, F.col("v"))).alias(c) for c in "ymd")).filter("y IS NOT NULL AND m IS NOT NULL AND d IS NOT NULL AND (m <= 6 OR d <= 30)")
    asked = readings.select(*group).distinct()
    out = asked.join(whole, group, "left").join(apart.select(*group, date.alias("apart")), group, "left").withColumn("x", F.coalesce("whole", "apart")).filter("x IS NOT NULL")
    return out.select(*group, F.col("x.y").alias("year"), F.col("x.m").alias("month"), F.col("x.d").alias("day"), F.col("whole").isNotNull().alias("whole"))
