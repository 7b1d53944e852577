"""Dashboard, overview and finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import reports as R
from ledgerloom.queries.book import Book

BOOK = Book()
AS_OF = "1998-06-15"
OPEN = "('todo', 'doing', 'waiting')"


@BOOK.add("task_buckets", f"""
SELECT id, title, priority, CAST(due_date AS VARCHAR) AS due_date, project_id, bucket FROM (SELECT *, CASE WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date = DATE '{AS_OF}' THEN 'today'
  WHEN due_date <= DATE '{AS_OF}' + 7 THEN 'upcoming' WHEN due_date IS NULL AND priority IN ('urgent', 'high') THEN 'undated' END AS bucket FROM tasks WHERE status IN {OPEN}) WHERE bucket IS NOT NULL""", ("tasks",))
def task_buckets(b):
    return R.task_buckets(b.entity("tasks"), AS_OF).select("id", "title", "priority", F.col("due_date").cast("string").alias("due_date"), "project_id", "bucket")


@BOOK.add("project_last_report", f"""
SELECT p.id AS project_id, p.name, p.status, (SELECT count(*) FROM tasks t WHERE t.project_id = p.id AND t.status IN {OPEN}) AS open_tasks,
  CAST((SELECT max(report_date) FROM daily_reports d WHERE d.project_id = p.id) AS VARCHAR) AS last_report FROM projects p""", ("projects", "tasks", "daily_reports"))
def project_last_report(b):
    out = R.activity(b.entity("projects"), b.entity("tasks"), b.entity("daily_reports"))
    return out.withColumn("last_report", F.col("last_report").cast("string"))


@BOOK.add("outstanding_invoices", f"""
SELECT id, number, status, coalesce(nullif(approved_amount, 0), nullif(net_amount, 0), 0) - coalesce(paid_amount, 0) AS outstanding, DATE '{AS_OF}' - submit_date AS days
FROM invoices WHERE status NOT IN ('draft', 'paid') AND coalesce(nullif(approved_amount, 0), nullif(net_amount, 0), 0) - coalesce(paid_amount, 0) > 0""", ("invoices",))
def outstanding_invoices(b):
    rows = b.entity("invoices").filter(~F.col("status").isin("draft", "paid")).withColumn("outstanding", R.outstanding()).filter("outstanding > 0")
    return rows.select("id", "number", "status", "outstanding", F.datediff(R.day(AS_OF), "submit_date").cast("long").alias("days"))


@BOOK.add("project_overview", """
SELECT p.id AS project_id, p.name, p.contract_amount, coalesce(t.tasks, 0) AS tasks, coalesce(t.tasks_done, 0) AS tasks_done, coalesce(i.invoices, 0) AS invoices, coalesce(i.net, 0) AS net,
  coalesce(i.approved, 0) AS approved, coalesce(i.paid, 0) AS paid, coalesce(x.income, 0) AS income, coalesce(x.expense, 0) AS expense,
  round_even(100 * coalesce(i.approved, 0)::DOUBLE / nullif(p.contract_amount, 0), 1) AS billed
FROM projects p LEFT JOIN (SELECT project_id, count(*) AS tasks, count(*) FILTER (status = 'done') AS tasks_done FROM tasks GROUP BY 1) t ON t.project_id = p.id
LEFT JOIN (SELECT project_id, count(*) AS invoices, CAST(coalesce(sum(net_amount), 0) AS BIGINT) AS net, CAST(coalesce(sum(approved_amount), 0) AS BIGINT) AS approved, CAST(coalesce(sum(paid_amount), 0) AS BIGINT) AS paid FROM invoices GROUP BY 1) i ON i.project_id = p.id
LEFT JOIN (SELECT project_id, CAST(coalesce(sum(amount) FILTER (kind = 'income'), 0) AS BIGINT) AS income, CAST(coalesce(sum(amount) FILTER (kind = 'expense'), 0) AS BIGINT) AS expense FROM transactions GROUP BY 1) x ON x.project_id = p.id""", ("projects", "tasks", "invoices", "transactions"))
def project_overview(b):
    return R.overview(b.entity("projects"), b.entity("tasks"), b.entity("invoices"), b.entity("transactions"))


def total(sql_keys: str, where: str = "") -> str:
    keys = f"{sql_keys}, " if sql_keys else ""
    return f"SELECT {keys}kind, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM transactions {where} GROUP BY ALL"


@BOOK.add("finance_totals", total("", "WHERE tx_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"), ("transactions",))
def finance_totals(b):
    return R.by_kind(R.in_period(b.entity("transactions"), "tx_date", "1996-01-01", "1999-12-31"))


@BOOK.add("finance_by_category", total("category"), ("transactions",))
def finance_by_category(b):
    return R.by_kind(b.entity("transactions"), "category")


def jalali(days: str) -> str:
    """SQL of d (days g), and j: g with its Solar-Hijri year, month and day."""
    return f"""d AS ({days}), a AS (SELECT g, (g - DATE '1970-01-01') + 1075195 AS n FROM d), c AS (SELECT g, n // 12053 AS c33, n % 12053 AS r FROM a), f AS (SELECT g, c33, r // 1461 AS c4, r % 1461 AS r FROM c),
y AS (SELECT g, -1595 + 33 * c33 + 4 * c4 + CASE WHEN r > 365 THEN (r - 1) // 365 ELSE 0 END AS jy, CASE WHEN r > 365 THEN (r - 1) % 365 ELSE r END AS r FROM f),
j AS (SELECT g, jy, CASE WHEN r < 186 THEN r // 31 + 1 ELSE (r - 186) // 30 + 7 END AS jm, CASE WHEN r < 186 THEN r % 31 ELSE (r - 186) % 30 END + 1 AS jd FROM y)"""


MONTHS = jalali("SELECT DISTINCT tx_date AS g FROM transactions")


@BOOK.add("finance_by_month", f"WITH {MONTHS} SELECT format('{{:04d}}/{{:02d}}', jy, jm) AS month, kind, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM transactions JOIN j ON g = tx_date GROUP BY ALL", ("transactions",))
def finance_by_month(b):
    return R.by_month(b.entity("transactions"))


@BOOK.add("finance_by_project", """
SELECT t.project_id, p.name AS project, t.kind, CAST(sum(t.amount) AS BIGINT) AS total, count(*) AS n FROM transactions t LEFT JOIN projects p ON p.id = t.project_id GROUP BY t.project_id, p.name, t.kind""", ("transactions", "projects"))
def finance_by_project(b):
    return R.by_project(b.entity("transactions"), b.entity("projects"))


@BOOK.add("finance_span", "SELECT count(*) AS n, CAST(min(tx_date) AS VARCHAR) AS first_day, CAST(max(tx_date) AS VARCHAR) AS last_day FROM transactions", ("transactions",))
def finance_span(b):
    return R.span(b.entity("transactions"))


@BOOK.add("finance_month_to_date", f"""
SELECT k.kind, coalesce(t.total, 0) AS total FROM (VALUES ('income'), ('expense')) k(kind) LEFT JOIN
(SELECT kind, CAST(sum(amount) AS BIGINT) AS total FROM transactions WHERE tx_date BETWEEN date_trunc('month', DATE '{AS_OF}') AND DATE '{AS_OF}' GROUP BY kind) t ON t.kind = k.kind""", ("transactions",))
def finance_month_to_date(b):
    return R.month_to_date(b.entity("transactions"), AS_OF)


@BOOK.add("top_categories", """
WITH s AS (SELECT coalesce(category, '-') AS category, CAST(sum(amount) AS BIGINT) AS total FROM transactions WHERE kind = 'expense' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, category) AS r FROM s)
SELECT CASE WHEN r <= 5 THEN category ELSE 'other' END AS category, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY 1""", ("transactions",))
def top_categories(b):
    return R.top_categories(b.entity("transactions"))


@BOOK.add("month_pivot", f"""
WITH {MONTHS} SELECT format('{{:04d}}/{{:02d}}', jy, jm) AS month, CAST(coalesce(sum(amount) FILTER (kind = 'income'), 0) AS BIGINT) AS income, CAST(coalesce(sum(amount) FILTER (kind = 'expense'), 0) AS BIGINT) AS expense FROM transactions JOIN j ON g = tx_date GROUP BY 1""", ("transactions",))
def month_pivot(b):
    return R.month_pivot(b.entity("transactions"))


@BOOK.add("receivable", """
SELECT CAST(coalesce(sum(coalesce(approved_amount, net_amount, 0) - coalesce(paid_amount, 0)), 0) AS BIGINT) AS receivable, count(*) AS invoices FROM invoices WHERE status NOT IN ('draft', 'paid')""", ("invoices",))
def receivable(b):
    return R.receivable(b.entity("invoices"))


@BOOK.add("due_reminders", f"SELECT id, title FROM tasks WHERE due_date <= DATE '{AS_OF}' AND status IN {OPEN}", ("tasks",))
def due_reminders(b):
    return R.due_reminders(b.entity("tasks"), "due_date", AS_OF).select("id", "title")


@BOOK.add("time_progress", f"""
SELECT o_orderkey, CAST(CASE WHEN t > 0 THEN greatest(0, least(100, round_even(100.0 * p / t, 0))) END AS INT) AS pct FROM
(SELECT o_orderkey, (CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT)) - CAST(o_orderdate AS DATE) AS t, DATE '{AS_OF}' - CAST(o_orderdate AS DATE) AS p FROM orders)""")
def time_progress(b):
    start = F.col("o_orderdate").cast("date")
    return b.table("orders").select("o_orderkey", R.time_progress(start, F.date_add(start, (F.col("o_orderkey") % 900).cast("int")), R.day(AS_OF)).alias("pct"))


@BOOK.add("daily_brief", f"""
WITH a AS (SELECT p.id, p.name, p.status, max(d.report_date) AS last_report FROM projects p LEFT JOIN daily_reports d ON d.project_id = p.id GROUP BY ALL),
r AS (SELECT CASE WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date = DATE '{AS_OF}' THEN 'today' WHEN due_date <= DATE '{AS_OF}' + 7 THEN 'upcoming' WHEN due_date IS NULL AND priority IN ('urgent', 'high') THEN 'undated' END AS section, title AS text, due_date AS moment, id FROM tasks WHERE status IN {OPEN}
UNION ALL SELECT 'stale', name, last_report, id FROM a WHERE status = 'active' AND (last_report IS NULL OR DATE '{AS_OF}' - last_report >= 3)
UNION ALL SELECT 'waiting', number, submit_date, id FROM invoices WHERE status IN ('submitted', 'reviewing') AND DATE '{AS_OF}' - submit_date > 30)
SELECT section, CAST(ord AS INT) AS ord, text FROM (SELECT section, text, row_number() OVER (PARTITION BY section ORDER BY moment ASC NULLS FIRST, id) AS ord FROM r WHERE section IS NOT NULL)
WHERE ord <= CASE WHEN section IN ('stale', 'waiting') THEN 8 ELSE 10 END""", ("tasks", "projects", "daily_reports", "invoices"))
def daily_brief(b):
    act = R.activity(b.entity("projects"), b.entity("tasks"), b.entity("daily_reports"))
    return R.daily_brief(b.entity("tasks"), act, b.entity("invoices"), AS_OF)
