"""Operational reports. `as_of` is a parameter everywhere: no report reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.functions.numbers import share

OPEN = ("todo", "doing", "waiting")


def day(text: str) -> Column:
    return F.to_date(F.lit(text))


def task_buckets(tasks: DataFrame, as_of: str) -> DataFrame:
    """Open tasks by bucket: overdue, today, upcoming (within 7 days), undated (urgent or high)."""
    due, now = F.col("due_date"), day(as_of)
    bucket = (
        F.when(due < now, "overdue").when(due == now, "today").when(due <= F.date_add(now, 7), "upcoming").when(due.isNull() & F.col("priority").isin("urgent", "high"), "undated")
    )
    return tasks.filter(F.col("status").isin(*OPEN)).withColumn("bucket", bucket).filter("bucket IS NOT NULL")


def activity(projects: DataFrame, tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Each project with its number of open tasks and its last report's day: two sums by key, joined."""
    opened = tasks.filter(F.col("status").isin(*OPEN)).groupBy("project_id").agg(F.count(F.lit(1)).alias("open_tasks"))
    last = reports.groupBy("project_id").agg(F.max("report_date").alias("last_report"))
    keyed = projects.select(F.col("id").alias("project_id"), "name", "status")
    return keyed.join(opened, "project_id", "left").join(last, "project_id", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))


def outstanding() -> Column:
    """What an invoice still brings: its approved amount, its net if that is null or 0, less what is paid."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(F.col("approved_amount"), zero), F.nullif(F.col("net_amount"), zero), zero) - F.coalesce("paid_amount", zero)


def net_rule() -> Column:
    """An invoice's net amount: as given, or gross less deductions."""
    return F.coalesce("net_amount", F.col("gross_amount") - F.coalesce("deductions", F.lit(0)))


def receivable(invoices: DataFrame) -> DataFrame:
    """Approved (or net) less paid of invoices that are neither drafts nor paid, whatever the period."""
    due = F.coalesce("approved_amount", "net_amount", F.lit(0)) - F.coalesce("paid_amount", F.lit(0))
    return invoices.filter(~F.col("status").isin("draft", "paid")).agg(F.coalesce(F.sum(due), F.lit(0)).alias("receivable"), F.count(F.lit(1)).alias("invoices"))


def in_period(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.filter(F.col(column) >= day(start))
    if end:
        df = df.filter(F.col(column) <= day(end))
    return df


def by_kind(transactions: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums and counts by keys and kind, on the raw keys: null and any word for it stay apart."""
    return transactions.groupBy(*keys, "kind").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))


def by_project(transactions: DataFrame, projects: DataFrame) -> DataFrame:
    """Sums by project id and kind; projects of one name stay apart."""
    sums = by_kind(transactions, "project_id")
    return sums.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id", "left")


def month_of(date: Column) -> Column:
    """The Solar-Hijri month of a DATE."""
    return F.substring(calendar.jalali_text(date), 1, 7)


def by_day(transactions: DataFrame) -> DataFrame:
    """Sums and counts by day and kind: what reports by month start from, so that the calendar is reckoned for days and not for rows."""
    return by_kind(transactions, "tx_date")


def by_month(transactions: DataFrame) -> DataFrame:
    """Sums and counts by Solar-Hijri month and kind."""
    return by_day(transactions).groupBy(month_of(F.col("tx_date")).alias("month"), "kind").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def span(transactions: DataFrame) -> DataFrame:
    """How many there are, and the first and last day."""
    return transactions.agg(F.count(F.lit(1)).alias("n"), F.min("tx_date").cast("string").alias("first_day"), F.max("tx_date").cast("string").alias("last_day"))


def month_to_date(transactions: DataFrame, as_of: str) -> DataFrame:
    """Sums by kind from the month's first day to as_of; a kind without any has 0."""
    rows = transactions.filter((F.col("tx_date") >= F.trunc(day(as_of), "month")) & (F.col("tx_date") <= day(as_of)))
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).alias(k) for k in ("income", "expense")))
    return sums.select(F.explode(F.create_map(F.lit("income"), F.col("income"), F.lit("expense"), F.col("expense"))).alias("kind", "total"))


def top_categories(transactions: DataFrame, n: int = 5) -> DataFrame:
    """Expenses of the n largest categories, and of all others together."""
    sums = transactions.filter("kind = 'expense'").groupBy(F.coalesce("category", F.lit("-")).alias("category")).agg(F.sum("amount").alias("total"))
    best = sums.orderBy(F.desc("total"), "category").limit(n).select("category", F.lit(True).alias("_best"))
    named = F.when(F.col("_best"), F.col("category")).otherwise("other")
    return sums.join(F.broadcast(best), "category", "left").groupBy(named.alias("category")).agg(F.sum("total").alias("total"))  # n rows


def month_pivot(transactions: DataFrame) -> DataFrame:
    """Income and expense by Solar-Hijri month, 0 where there's none."""
    rows = by_day(transactions).select(month_of(F.col("tx_date")).alias("month"), "kind", "total")
    return rows.groupBy("month").pivot("kind", ["income", "expense"]).agg(F.sum("total")).na.fill(0, ["income", "expense"])


def overview(projects: DataFrame, tasks: DataFrame, invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    """Each project's task counts, invoice sums, income and expense, and the billed share of its contract."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "done").alias("tasks_done"))
    i = invoices.groupBy("project_id").agg(F.count(F.lit(1)).alias("invoices"), zero(F.sum("net_amount")).alias("net"), zero(F.sum("approved_amount")).alias("approved"), zero(F.sum("paid_amount")).alias("paid"))
    x = transactions.groupBy("project_id").agg(zero(F.sum(F.when(F.col("kind") == "income", F.col("amount")))).alias("income"), zero(F.sum(F.when(F.col("kind") == "expense", F.col("amount")))).alias("expense"))
    out = projects.select(F.col("id").alias("project_id"), "name", "contract_amount")
    for part in (t, i, x):
        out = out.join(part, "project_id", "left")
    filled = [c for c in out.columns if c not in ("project_id", "name", "contract_amount")]
    return out.select("project_id", "name", "contract_amount", *(zero(c).alias(c) for c in filled)).withColumn("billed", share(F.col("approved"), F.col("contract_amount")))


def time_progress(start: Column, end: Column, as_of: Column) -> Column:
    """Percent of a period that has passed, 0 to 100, rounded half to even; null for an empty period."""
    total, passed = F.datediff(end, start), F.datediff(as_of, start)
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 * passed / total, 0).cast("int"))))


def due_reminders(tasks: DataFrame, at: str, as_of: str) -> DataFrame:
    """Open tasks whose reminder time has come and that have not been reminded (column reminded, where the table has it)."""
    fresh = F.coalesce("reminded", F.lit(0)) == 0 if "reminded" in tasks.columns else F.lit(True)
    return tasks.filter((F.col(at) <= F.lit(as_of)) & F.col("status").isin(*OPEN) & fresh)


def daily_brief(tasks: DataFrame, activity_: DataFrame, invoices: DataFrame, as_of: str, stale_days: int = 3, waiting_days: int = 30) -> DataFrame:
    """Lines of a day's brief: (section, ord, text), at most 10 tasks of a bucket and 8 of each other kind."""
    t = task_buckets(tasks, as_of).select(F.col("bucket").alias("section"), F.col("title").alias("text"), F.col("due_date").alias("at"), F.col("id"))
    stale = activity_.filter((F.col("status") == "active") & (F.col("last_report").isNull() | (F.datediff(day(as_of), "last_report") >= stale_days))).select(F.lit("stale").alias("section"), F.col("name").alias("text"), F.col("last_report").alias("at"), F.col("project_id").alias("id"))
    late = invoices.filter(F.col("status").isin("submitted", "reviewing") & (F.datediff(day(as_of), "submit_date") > waiting_days)).select(F.lit("waiting").alias("section"), F.col("number").alias("text"), F.col("submit_date").alias("at"), "id")
    ord_ = F.row_number().over(Window.partitionBy("section").orderBy(F.col("at").asc_nulls_first(), "id"))
    rows = t.unionByName(stale).unionByName(late).withColumn("ord", ord_)
    return rows.filter(F.col("ord") <= F.when(F.col("section").isin("stale", "waiting"), 8).otherwise(10)).select("section", "ord", "text")
