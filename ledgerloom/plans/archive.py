"""Roll-ups of archived documents: reply graph, ageing, alerts, progress, story order, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.operators import sets


def reply_graph(letters: DataFrame) -> DataFrame:
    """src answers dst: edges by canonical number. letters: id, key, ref_key, ref_date, letter_date."""
    refs = letters.filter("ref_key IS NOT NULL").select(F.col("id").alias("src"), F.col("ref_key").alias("key"), "ref_date", "letter_date")
    return sets.reply_edges(letters.select("id", "key", "letter_date"), refs)


def missing(letters: DataFrame) -> DataFrame:
    """References that no letter has."""
    refs = letters.filter("ref_key IS NOT NULL").select(F.col("id").alias("src"), F.col("ref_key").alias("key"))
    return refs.join(letters.select("key").distinct(), "key", "left_anti")


def unanswered(letters: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """Letters that ask and have no reply, with the days they wait."""
    asked = letters.filter("asks AND letter_date IS NOT NULL").select("id", "letter_date")
    answered = edges.select(F.col("dst").alias("id")).distinct()
    return asked.join(answered, "id", "left_anti").select("id", F.greatest(F.lit(0), F.datediff(as_of, "letter_date")).alias("waiting_days"))


def overview(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Each project's documents, letters and last date; projects without documents stay, with zeros."""
    d = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("category") == "letter").alias("letters"), F.max("doc_date").alias("last_date"))
    out = projects.select(F.col("id").alias("project_id"), "name").join(d, "project_id", "left")
    return out.withColumns({"docs": F.coalesce("docs", F.lit(0)), "letters": F.coalesce("letters", F.lit(0))})


def deadline_state(due: Column, as_of: Column, soon: int = 30) -> Column:
    left = F.datediff(due, as_of)
    return F.when(left < 0, "late").when(left <= soon, "soon").otherwise("later")


def deadlines(rows: DataFrame, as_of: Column, n: int = 12) -> DataFrame:
    """The n nearest deadlines: upcoming ones first, soonest first, then late ones, latest first."""
    left = F.datediff("due", as_of)
    return rows.withColumn("days_left", left).orderBy((left < 0).asc(), F.when(left >= 0, left).asc(), F.when(left < 0, left).desc(), "id").limit(n)


def progress(invoices: DataFrame) -> DataFrame:
    """Invoices of a project in order (number, date, id) with their period's work, the total so far and before, and the last marked."""
    order = Window.partitionBy("project_id").orderBy(F.col("no").asc_nulls_last(), F.col("submit_date").asc_nulls_last(), "id")
    so_far = F.sum("work").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seq = F.row_number().over(order)
    out = invoices.withColumns({"seq": seq, "total": so_far}).withColumn("prev", F.coalesce(F.lag("total").over(order), F.lit(0)))
    return out.withColumns({"period": F.col("total") - F.col("prev"), "is_last": F.lead("id").over(order).isNull()})


def s_curve(points: DataFrame) -> DataFrame:
    """x: days since a project's first point; y: work so far."""
    w = Window.partitionBy("project_id")
    y = F.sum("work").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = points.groupBy("project_id", "day").agg(F.sum("work").alias("work"))
    return days.withColumns({"x": F.datediff("day", F.min("day").over(w)), "y": y})


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 1)


def alerts(facts: DataFrame, guarantees: DataFrame, due: DataFrame, letters: DataFrame, as_of: Column) -> DataFrame:
    """Control alerts as (project_id, severity, rule, n, ref), to be shown by by_severity().

    facts, a row a project: start_date, end_date, contract_amount, and of the last invoice work, claimed, approved, check_failed,
    invoice_date, progress; problems of the last report. guarantees: id, project_id, valid_until (an alert each). due: id,
    project_id, due. letters: id, project_id, waiting_days. n is how many, or by how much; ref the first one's id.
    """
    c, none = F.col, F.lit(None)
    total, passed = F.datediff("end_date", "start_date"), F.datediff(as_of, "start_date")
    timed = (total > 0) & (passed > 0)
    spent = F.when(timed, F.least(F.lit(100.0), percent(passed, total)))
    money = F.when((c("work") != 0) & (c("contract_amount") != 0), percent(c("work"), c("contract_amount")))
    gap, age = spent - money, F.datediff(as_of, "invoice_date")
    cut = F.when((c("approved") != 0) & (c("approved") < c("claimed")), percent(c("claimed") - c("approved"), c("claimed")))
    apart = F.when(c("progress") != 0, F.abs(c("progress") - money))
    rules = [
        ("time", F.when(timed & (passed > total), "red").when(timed & (total - passed <= 60), "amber"), F.abs(total - passed)),
        ("work", F.when(gap >= 30, "red").when(gap >= 15, "amber").when(gap <= -10, "info"), gap),
        ("cut", F.when(cut >= 3, "amber"), cut),
        ("sums", F.when(c("check_failed"), "amber"), none),
        ("invoice", F.when(age > 60, "amber"), age),
        ("progress", F.when(apart >= 15, "info"), apart),
        ("problems", F.when(F.size("problems") > 0, "info"), F.size("problems")),
    ]
    row = lambda rule, severity, n, ref: F.struct(severity.alias("severity"), F.lit(rule).alias("rule"), n.cast("double").alias("n"), ref.cast("long").alias("ref"))
    listed = F.filter(F.array(*(row(r, s, n, none) for r, s, n in rules)), lambda x: x["severity"].isNotNull())
    out = [facts.select("project_id", F.explode(listed).alias("a"))]
    left = F.datediff("valid_until", as_of)
    out.append(guarantees.select("project_id", row("guarantee", F.when(left < 0, "red").when(left <= 30, "amber"), left, c("id")).alias("a")).filter("a.severity IS NOT NULL"))
    days = F.datediff("due", as_of)
    late, soon = (days < 0) & (days >= -60), (days >= 1) & (days <= 7)
    counts = due.groupBy("project_id").agg(F.count_if(late).alias("l"), F.max_by("id", F.struct(F.when(late, c("due")), F.when(late, -c("id")))).alias("lid"), F.count_if(soon).alias("s"), F.min_by("id", F.when(soon, F.struct("due", "id"))).alias("sid"))
    for rule, severity, n, ref in (("late", "red", "l", "lid"), ("soon", "amber", "s", "sid")):
        out.append(counts.filter(c(n) > 0).select("project_id", row(rule, F.lit(severity), c(n), c(ref)).alias("a")))
    waits = letters.filter("waiting_days >= 14").groupBy("project_id").agg(F.count(F.lit(1)).alias("w"), F.max_by("id", F.struct("waiting_days", -c("id"))).alias("wid"))
    out.append(waits.select("project_id", row("letters", F.lit("amber"), c("w"), c("wid")).alias("a")))
    return reduce(DataFrame.unionByName, out).select("project_id", "a.*")


SEVERITY = ("red", "amber", "info")
RULES = ("time", "work", "cut", "sums", "invoice", "progress", "guarantee", "late", "soon", "letters", "problems")


def by_severity(alerts_: DataFrame) -> DataFrame:
    """A project's alerts in order: red, amber, info, and within one by rule; with their place."""
    rank = lambda x, values: F.array_position(F.array(*map(F.lit, values)), x)
    w = Window.partitionBy("project_id").orderBy(rank(F.col("severity"), SEVERITY), rank(F.col("rule"), RULES), "ref")
    return alerts_.withColumn("place", F.row_number().over(w))


def library(documents: DataFrame) -> DataFrame:
    """How many documents and pages there are, and how many are still to be read; one row."""
    waiting = F.col("status").isin("queued", "processing")
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if(waiting).alias("pending"))


def letters_by_month(letters: DataFrame) -> DataFrame:
    """Letters by Solar-Hijri month, "—" without a date, with how many are late."""
    month = F.coalesce(F.substring(calendar.jalali_text(F.col("letter_date")), 1, 7), F.lit("—"))
    return letters.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


def derived_work(invoices: DataFrame) -> DataFrame:
    """work_period and work_total of invoices, the missing one of them from the other and work_prev; work_check where all three are
    there and don't fit within 2 percent."""
    prev, period, total = (F.col(x) for x in ("work_prev", "work_period", "work_total"))
    off = F.abs(prev + period - total) > 0.02 * F.abs(total)
    return invoices.withColumns({"work_check": F.coalesce(off, F.lit(False)), "work_period": F.coalesce(period, total - prev), "work_total": F.coalesce(total, period + prev)})


def invoice_records(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Invoices read from documents as records, without those whose number the project has already, or that have no amount.

    The gross amount is the period's work and adjustment, the net amount if these are nothing.
    """
    zero = F.lit(0)
    gross = F.coalesce(F.nullif(F.coalesce("work_period", zero) + F.coalesce("adjustment", zero), zero), F.col("net"))
    rows = found.withColumns({"gross_amount": gross, "number": F.coalesce("invoice_no", "title"), "status": F.lit("submitted"), "deductions": F.coalesce("deductions", zero)})
    fresh = rows.filter("project_id IS NOT NULL AND gross_amount IS NOT NULL AND gross_amount <> 0")
    return fresh.join(stored.select("project_id", "number"), ["project_id", "number"], "left_anti").select("project_id", "number", "gross_amount", "deductions", F.col("net").alias("net_amount"), "status", F.col("doc_date").alias("submit_date"))


def story_order(events: DataFrame) -> DataFrame:
    """Dated events of a month in order, duplicates dropped, each with the connector that its gap to the one before asks for."""
    kept = sets.first_of_each(events, ["project_id", "day", "kind", "subject"], [F.col("id")])
    w = Window.partitionBy("project_id", F.trunc("day", "month")).orderBy("day", "id")
    gap = F.datediff("day", F.lag("day").over(w))
    word = F.when(gap.isNull(), "first").when(gap == 0, "same day").when(gap == 1, "next day").when(gap <= 3, "days later").otherwise("on date")
    return kept.withColumns({"seq": F.row_number().over(w), "gap": gap, "connector": word})


def reconcile(rows: DataFrame, tolerance: int = 10) -> DataFrame:
    """Financial rows with the residual prev + period - total, and the one value that would mend it."""
    rest = F.col("prev") + F.col("period") - F.col("total")
    ok = F.abs(rest) <= tolerance
    return rows.withColumns({"residual": rest, "ok": ok, "total_fixed": F.when(ok, F.col("total")).otherwise(F.col("prev") + F.col("period"))})


def roll_up(rows: DataFrame) -> DataFrame:
    """Sums by role, sum rows left out."""
    return rows.filter("NOT is_sum").groupBy("role").agg(*(F.sum(c).alias(c) for c in ("prev", "period", "total")))


def boilerplate(pages: DataFrame, doc: str, page: str, line: str, share: int = 3) -> DataFrame:
    """Lines of a document on at least max(3, pages // 3) of its pages."""
    n = pages.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    on = pages.filter(F.length(line) > 0).groupBy(doc, line).agg(F.countDistinct(page).alias("on_pages"))
    return on.join(n.hint("merge"), doc).filter(F.col("on_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") / share))).select(doc, line, "on_pages")


def classify(text: Column, rules: list[tuple[str, tuple[str, ...]]], least: int = 2, other: str = "other") -> Column:
    """The category with most keyword hits (of equal ones the first), if it has enough."""
    scores = [(name, reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(w)) for w in words))) for name, words in rules]
    best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores))))
    return F.when(best["s"] >= least, best["n"]).otherwise(other)


def learned(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule of each document's category whose label its text holds: rules are few, and meet documents by category."""
    found = docs.join(rules, "category").filter(F.col("text").contains(F.col("label")))
    return found.groupBy("doc_id").agg(F.min(F.struct("rank", "value")).alias("r")).select("doc_id", "r.rank", "r.value")
