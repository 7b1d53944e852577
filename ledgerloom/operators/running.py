"""Running states over ordered events: balances, drawdowns, streaks, as-of look-ups.

A running total over a whole table is computed in two steps: sums by day and a window over days (whose number doesn't grow with
the events), then a window within each day; so no task holds all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(events: DataFrame, day: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """events with the sum of amount up to and with each row, by day and then order."""
    days = events.groupBy(day).agg(F.sum(amount).alias("_day"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(day).alias("_d"), F.coalesce(F.sum("_day").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = events.withColumn("_own", F.sum(amount).over(within))
    return own.join(days, F.col(day).eqNullSafe(F.col("_d"))).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_d")


def as_of(probes: DataFrame, events: DataFrame, at: str, amount: str, name: str) -> DataFrame:
    """probes with the sum of amount over all events at or before their time.

    Times are summed by day first, so that the window over all of them has a row a day; within a day it goes by time.
    """
    times = events.groupBy(at).agg(F.sum(amount).alias("_a")).unionByName(probes.select(at).distinct().withColumn("_a", F.lit(0).cast("long")))
    times = times.groupBy(at).agg(F.sum("_a").alias("_a")).withColumn("_on", F.to_date(at))
    total = running_total(times, "_on", [F.col(at)], "_a", name)
    return probes.join(total.select(at, name), at, "left")


def drawdown(curve: DataFrame, day: str, order: list[Column]) -> DataFrame:
    """The largest fall from a peak, in percent; transfers move the peak with them.

    curve has balance and transfers (their running sum) and is_transfer. The running peak is taken by day first.
    """
    own = F.when(~F.col("is_transfer"), F.col("balance") - F.col("transfers"))
    rows = curve.withColumn("_own", own)
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(day).agg(F.max("_own").alias("_top")).select(F.col(day).alias("_d"), F.max("_top").over(before).alias("_before"))
    within = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("_own").over(within)).join(days, F.col(day).eqNullSafe(F.col("_d")))
    peak = F.col("transfers") + F.greatest("_peak", "_before")
    fall = F.when((peak > 0) & ~F.col("is_transfer"), 100.0 * (peak - F.col("balance")) / peak)
    return rows.agg(F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown"))


def deepest_fall(events: DataFrame, day: str, order: list[Column]) -> DataFrame:
    """drawdown() of the curve that events (amount, transfer, is_transfer) make, in one shuffle by day.

    Sums and peaks go within a day first; what the days before add is a row a day.
    """
    within = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select(day, "is_transfer", *order, F.sum("amount").over(within).alias("_a"), F.sum("transfer").over(within).alias("_t"), F.col("amount").alias("_amount"), "transfer")
    rows = rows.withColumn("_top", F.max(F.when(~F.col("is_transfer"), F.col("_a") - F.col("_t"))).over(within))
    days = rows.groupBy(day).agg(F.sum("_amount").alias("a"), F.sum("transfer").alias("t"), F.max("_top").alias("top"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumnRenamed(day, "_d").select("_d", "top", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}0") for c in "at"))
    days = days.select("_d", "_a0", "_t0", F.max(F.col("top") + F.col("_a0") - F.col("_t0")).over(before).alias("_before"))
    whole = rows.join(days, F.col(day).eqNullSafe(F.col("_d")))
    peak = F.col("_t0") + F.col("_t") + F.greatest(F.col("_top") + F.col("_a0") - F.col("_t0"), F.col("_before"))
    fall = F.when((peak > 0) & ~F.col("is_transfer"), 100.0 * (peak - F.col("_a0") - F.col("_a")) / peak)
    return whole.agg(F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown"))


def streaks(df: DataFrame, group: list[str], order: list[Column], result: str) -> DataFrame:
    """Longest runs of equal results in each group, for each result.

    Runs are found among rows of the same first value of the order (a day), and then the first and the last run of each day are
    joined to those of the days around it, so that no task holds a whole group.
    """
    at, *rest = order
    names = [f"_o{i}" for i in range(len(rest))]
    rows = df.select(*group, F.col(result), at.alias("_at"), *(c.alias(n) for c, n in zip(rest, names, strict=True)))
    within = lambda *more: F.row_number().over(Window.partitionBy(*group, "_at", *more).orderBy(*(names or ["_at"])))
    rows = rows.withColumns({"_place": within(), "_own": within(result)}).withColumn("_run", F.col("_place") - F.col("_own"))
    runs = rows.groupBy(*group, "_at", result, "_run").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_place"))
    run = F.struct("_place", result, "n")
    days = runs.groupBy(*group, "_at").agg(F.min(run).alias("_first"), F.max(run).alias("_last"), F.count(F.lit(1)).alias("_runs"))
    edges = F.when(F.col("_runs") == 1, F.array("_first")).otherwise(F.array("_first", "_last"))
    ends = days.select(*group, "_at", F.posexplode(edges).alias("_part", "x")).select(*group, "_at", "_part", f"x.{result}", "x.n")
    along = Window.partitionBy(*group).orderBy("_at", "_part")  # at most two rows a day
    begins = (F.col("_part") == 1) | ~F.lag(result).over(along).eqNullSafe(F.col(result))
    ends = ends.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(along))
    joined = ends.groupBy(*group, result, "_run").agg(F.sum("n").alias("n"))
    return runs.select(*group, result, "n").unionByName(joined.drop("_run")).groupBy(*group, result).agg(F.max("n").alias("longest"))
