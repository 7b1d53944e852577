"""Whole reports of one call each: the dashboard of a day, the sheet of every project, the finance of a period.

A report is one table whose column `section` says what a row is; nothing is gathered in one row or one task. Rows come without an order;
they carry what they are to be shown by. `as_of` is a parameter: no report reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import CATALOG, PRIORITY, TASK_STATUS
from ledgerloom.functions.numbers import share
from ledgerloom.operators.listing import order_of, rank_of, with_project_name
from ledgerloom.plans import reports as R

# States of projects on the dashboard, and of invoices that wait for money.
SHOWN = ("active", "tender", "on_hold")
PENDING = ("submitted", "reviewing", "approved", "partial")
GONE = ("done", "cancelled")


def own(df: DataFrame, column: str, kind: str) -> Column:
    """A column, or null where the table lacks it."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def dashboard(projects: DataFrame, tasks: DataFrame, reports: DataFrame, invoices: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    """section, id, title, project_id, project_name, state, rank, day, days, open_tasks and amount.

    Sections: overdue, today, upcoming and undated tasks (state: priority; rank: its place; days: until due), project (those in SHOWN;
    day: last report; days: until its end), invoice (those in PENDING; day: submitted; days: waiting; amount: what is outstanding),
    and month (income and expense of the month so far). A null key has no name. Empty tables leave the two rows of month.
    """
    now = R.day(as_of)
    due = R.task_buckets(tasks, as_of).select(F.col("bucket").alias("section"), "id", "title", "project_id", F.col("priority").alias("state"), rank_of("priority", PRIORITY).alias("rank"), F.col("due_date").alias("day"), F.datediff("due_date", now).alias("days"))
    wait = invoices.filter(F.col("status").isin(*PENDING)).select(F.lit("invoice").alias("section"), "id", F.col("number").alias("title"), "project_id", F.col("status").alias("state"), F.col("submit_date").alias("day"), F.datediff(now, "submit_date").alias("days"), R.outstanding().alias("amount"))
    records = with_project_name(due.unionByName(wait, allowMissingColumns=True), projects)
    left = F.datediff(own(projects, "end_date", "date"), now)
    shown = R.activity(projects, tasks, reports).filter(F.col("status").isin(*SHOWN))
    ends = projects.select(F.col("id").alias("project_id"), left.alias("days"))
    p = shown.join(ends, "project_id").select(F.lit("project").alias("section"), F.col("project_id").alias("id"), F.col("name").alias("title"), "project_id", F.col("name").alias("project_name"), F.col("status").alias("state"), rank_of("status", SHOWN).alias("rank"), F.col("last_report").alias("day"), "days", "open_tasks")
    m = R.month_to_date(transactions, as_of).select(F.lit("month").alias("section"), F.col("kind").alias("title"), F.trunc(now, "month").alias("day"), F.col("total").alias("amount"))
    rows = records.unionByName(p, allowMissingColumns=True).unionByName(m, allowMissingColumns=True)
    whole = {"id": "long", "project_id": "long", "rank": "long", "day": "string", "days": "long", "open_tasks": "long", "amount": "long"}
    return rows.select("section", "id", "title", "project_id", "project_name", "state", *(F.col(c).cast(t).alias(c) for c, t in whole.items() if c not in ("id", "project_id")))


def first_ids(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """project_id and the ids of its first n records, in order. Spark cuts each partition to n a project before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    best = df.withColumn("_r", rank).filter(F.col("_r") <= n)
    return best.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias(name))  # n at most


def sheet(projects: DataFrame, tasks: DataFrame, reports: DataFrame, invoices: DataFrame, transactions: DataFrame, as_of: str, shown: int = 20, recent: int = 5) -> DataFrame:
    """Each project's row: time and physical progress, days left, tasks by state, invoices and their share of the contract, income and
    expense, and the ids of its first open tasks and last daily reports.

    Tasks of a state that isn't in TASK_STATUS (null too) count in tasks_other. A project without rows in a table has 0 and empty lists;
    without dates, or with an empty period, no time progress. Every table is summed by key before it is joined.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = F.col("status")
    known = F.coalesce(state.isin(*TASK_STATUS), F.lit(False))
    t = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"), *(F.count_if(state == s).alias(f"tasks_{s}") for s in TASK_STATUS), F.count_if(~known).alias("tasks_other"))
    i = invoices.groupBy("project_id").agg(F.count(F.lit(1)).alias("invoices"), *(zero(F.sum(f"{c}_amount")).alias(c) for c in ("net", "approved", "paid")))
    x = transactions.groupBy("project_id").agg(*(zero(F.sum(F.when(F.col("kind") == k, F.col("amount")))).alias(k) for k in ("income", "expense")))
    start, end, progress = own(projects, "start_date", "date"), own(projects, "end_date", "date"), own(projects, "progress", "int")
    now = R.day(as_of)
    out = projects.select(F.col("id").alias("project_id"), "name", "status", "contract_amount", R.time_progress(start, end, now).alias("time_progress"), progress.alias("progress"), F.datediff(end, now).alias("days_left"))
    head = out.columns
    for part in (t, i, x):
        out = out.join(part, "project_id", "left")
    out = out.select(*head, *(zero(F.col(c)).alias(c) for c in out.columns if c not in head))
    open_ = first_ids(tasks.filter(~F.coalesce(state.isin(*GONE), F.lit(False))), order_of(CATALOG["tasks"]), shown, "open_tasks")
    last = first_ids(reports, order_of(CATALOG["daily_reports"]), recent, "recent_reports")
    none = F.array().cast("array<long>")
    out = out.join(open_, "project_id", "left").join(last, "project_id", "left")
    return out.withColumns({"open_tasks": F.coalesce("open_tasks", none), "recent_reports": F.coalesce("recent_reports", none), "billed": share(F.col("net"), F.col("contract_amount"))})


def finance(transactions: DataFrame, projects: DataFrame, invoices: DataFrame, start: str | None = None, end: str | None = None, project: int | None = None) -> DataFrame:
    """section, kind, label, project_id, total, n, first_day and last_day of the transactions of a period, of all projects or one.

    Sections: total (by kind), category, month (Solar-Hijri) and project (label: its name, null without one), each by kind and on raw
    keys, balance (income less expense, all rows, first and last day) and receivable, which knows no period. One scan and one shuffle make
    all sums but the last; months are reckoned from days. Without transactions only receivable is left.
    """
    if project is not None:
        transactions, invoices = (df.filter(F.col("project_id") == project) for df in (transactions, invoices))
    rows = R.in_period(transactions, "tx_date", start, end).select("kind", "category", "tx_date", "project_id", "amount", F.col("tx_date").alias("day"))
    signed = F.when(F.col("kind") == "income", F.col("amount")).when(F.col("kind") == "expense", -F.col("amount")).otherwise(0)
    keys = [F.col(c) for c in ("kind", "category", "tx_date", "project_id")]
    sets = [[], keys[:1], [keys[0], keys[1]], [keys[0], keys[2]], [keys[0], keys[3]]]
    # bits of grouping_id: kind, category, day, project; a bit is set where the sum goes over the key
    sums = rows.groupingSets(sets, *keys).agg(F.sum("amount").alias("total"), F.sum(signed).alias("signed"), F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 0b1111, "balance").when(F.col("g") == 0b0111, "total").when(F.col("g") == 0b0011, "category").when(F.col("g") == 0b0101, "month").otherwise("project")
    label = F.when(F.col("g") == 0b0011, F.col("category")).when(F.col("g") == 0b0101, R.month_of(F.col("tx_date")))
    named = sums.select(section.alias("section"), "kind", label.alias("label"), "project_id", F.when(F.col("g") == 0b1111, F.col("signed")).otherwise(F.col("total")).alias("total"), "n", "first_day", "last_day")
    months = named.groupBy("section", "kind", "label", "project_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    full = with_project_name(months, projects).withColumn("label", F.coalesce("label", "project_name"))
    due = R.receivable(invoices).select(F.lit("receivable").alias("section"), F.col("receivable").alias("total"), F.col("invoices").alias("n"))
    out = full.drop("project_name").unionByName(due, allowMissingColumns=True)
    return out.select("section", "kind", "label", "project_id", "total", "n", *(F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")))
