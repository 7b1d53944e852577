"""Dashboard, project sheets and finance, each as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import PRIORITY, TASK_STATUS
from ledgerloom.plans import boards
from ledgerloom.queries.book import Book
from ledgerloom.queries.reports import AS_OF, OPEN, jalali

BOOK = Book()
NOW = f"DATE '{AS_OF}'"
#: Projects with dates and progress, which the fixture's customers lack.
DATED = "SELECT *, CASE WHEN id % 13 = 0 THEN NULL ELSE DATE '1996-01-01' + CAST(id % 500 AS INT) END AS start_date, CASE WHEN id % 11 = 0 THEN NULL ELSE DATE '1997-01-01' + CAST(id % 900 AS INT) END AS end_date, CAST(id % 101 AS INT) AS progress FROM projects"


def dated(b):
    id_ = F.col("id")
    begin = lambda at, days: F.date_add(F.to_date(F.lit(at)), (id_ % days).cast("int"))
    start = F.when(id_ % 13 != 0, begin("1996-01-01", 500))
    end = F.when(id_ % 11 != 0, begin("1997-01-01", 900))
    return b.entity("projects").withColumns({"start_date": start, "end_date": end, "progress": (id_ % 101).cast("int")})


def rank_sql(column: str, values: tuple[str, ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + f" ELSE {len(values)} END"


@BOOK.add("dashboard", f"""
WITH p AS ({DATED}), c AS (SELECT project_id, count(*) AS n FROM tasks WHERE status IN {OPEN} GROUP BY 1), d AS (SELECT project_id, max(report_date) AS day FROM daily_reports GROUP BY 1),
r AS (SELECT CASE WHEN due_date < {NOW} THEN 'overdue' WHEN due_date = {NOW} THEN 'today' WHEN due_date <= {NOW} + 7 THEN 'upcoming' WHEN due_date IS NULL AND priority IN ('urgent', 'high') THEN 'undated' END AS section,
  id, title, project_id, priority AS state, {rank_sql('priority', PRIORITY)} AS rank, due_date AS day, due_date - {NOW} AS days, NULL AS amount FROM tasks WHERE status IN {OPEN}
UNION ALL SELECT 'invoice', id, number, project_id, status, NULL, submit_date, {NOW} - submit_date, coalesce(nullif(approved_amount, 0), nullif(net_amount, 0), 0) - coalesce(paid_amount, 0)
  FROM invoices WHERE status IN {boards.PENDING})
SELECT section, title, r.project_id, p.name AS project_name, state, CAST(rank AS BIGINT) AS rank, CAST(day AS VARCHAR) AS day, CAST(days AS BIGINT) AS days, NULL::BIGINT AS open_tasks, CAST(amount AS BIGINT) AS amount, r.id FROM r LEFT JOIN p ON p.id = r.project_id WHERE section IS NOT NULL
UNION ALL SELECT 'project', name, p.id, name, status, {rank_sql('status', boards.SHOWN)}, CAST(d.day AS VARCHAR), end_date - {NOW}, coalesce(c.n, 0), NULL, p.id FROM p LEFT JOIN c ON c.project_id = p.id LEFT JOIN d ON d.project_id = p.id WHERE status IN {boards.SHOWN}
UNION ALL SELECT 'month', k, NULL, NULL, NULL, NULL, CAST(CAST(date_trunc('month', {NOW}) AS DATE) AS VARCHAR), NULL, NULL, (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) FROM transactions WHERE kind = k AND tx_date BETWEEN date_trunc('month', {NOW}) AND {NOW}), NULL
  FROM (VALUES ('income'), ('expense')) v(k)""", ("projects", "tasks", "daily_reports", "invoices", "transactions"))
def dashboard(b):
    """Everything that the day's board shows: tasks, projects, invoices, the month."""
    return boards.dashboard(dated(b), b.entity("tasks"), b.entity("daily_reports"), b.entity("invoices"), b.entity("transactions"), AS_OF)


STATES = ", ".join(f"count(*) FILTER (status = '{s}') AS tasks_{s}" for s in TASK_STATUS)
COUNTS = ", ".join(f"coalesce(t.{c}, 0) AS {c}" for c in ("tasks", *(f"tasks_{s}" for s in TASK_STATUS), "tasks_other"))


@BOOK.add("project_sheet", f"""
WITH p AS ({DATED}), t AS (SELECT project_id, count(*) AS tasks, {STATES}, count(*) FILTER (coalesce(status NOT IN {TASK_STATUS}, true)) AS tasks_other FROM tasks GROUP BY 1),
i AS (SELECT project_id, count(*) AS invoices, CAST(sum(net_amount) AS BIGINT) AS net, CAST(sum(approved_amount) AS BIGINT) AS approved, CAST(sum(paid_amount) AS BIGINT) AS paid FROM invoices GROUP BY 1),
x AS (SELECT project_id, CAST(sum(amount) FILTER (kind = 'income') AS BIGINT) AS income, CAST(sum(amount) FILTER (kind = 'expense') AS BIGINT) AS expense FROM transactions GROUP BY 1),
o AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY {rank_sql('status', TASK_STATUS)}, due_date NULLS LAST, {rank_sql('priority', PRIORITY)}, id) AS r FROM tasks WHERE coalesce(status NOT IN ('done', 'cancelled'), true)),
o20 AS (SELECT project_id, string_agg(id, ' ' ORDER BY r) AS ids FROM o WHERE r <= 20 GROUP BY 1),
d AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY report_date DESC NULLS LAST, id DESC) AS r FROM daily_reports),
d5 AS (SELECT project_id, string_agg(id, ' ' ORDER BY r) AS ids FROM d WHERE r <= 5 GROUP BY 1)
SELECT p.id AS project_id, p.name, p.status, p.contract_amount, CAST(CASE WHEN end_date > start_date THEN greatest(0, least(100, round_even(100.0 * ({NOW} - start_date) / (end_date - start_date), 0))) END AS INT) AS time_progress, progress, CAST(end_date - {NOW} AS INT) AS days_left,
  {COUNTS}, coalesce(invoices, 0) AS invoices, coalesce(net, 0) AS net, coalesce(approved, 0) AS approved, coalesce(paid, 0) AS paid, coalesce(income, 0) AS income, coalesce(expense, 0) AS expense,
  coalesce(o20.ids, '') AS open_tasks, coalesce(d5.ids, '') AS recent_reports, round_even(100 * coalesce(net, 0)::DOUBLE / nullif(p.contract_amount, 0), 1) AS billed
FROM p LEFT JOIN t ON t.project_id = p.id LEFT JOIN i ON i.project_id = p.id LEFT JOIN x ON x.project_id = p.id LEFT JOIN o20 ON o20.project_id = p.id LEFT JOIN d5 ON d5.project_id = p.id""", ("projects", "tasks", "daily_reports", "invoices", "transactions"))
def project_sheet(b):
    """Every project's overview with its progress, tasks by state, first open tasks and last reports."""
    out = boards.sheet(dated(b), b.entity("tasks"), b.entity("daily_reports"), b.entity("invoices"), b.entity("transactions"), AS_OF)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("open_tasks", "recent_reports")})


PERIOD = ("1993-01-01", "1998-06-15")
SUMS = "CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, CAST(min(tx_date) AS VARCHAR) AS first_day, CAST(max(tx_date) AS VARCHAR) AS last_day"


@BOOK.add("finance_summary", f"""
WITH x AS (SELECT * FROM transactions WHERE tx_date BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'), {jalali('SELECT DISTINCT tx_date AS g FROM x')}
SELECT 'total' AS section, kind, NULL AS label, NULL::BIGINT AS project_id, {SUMS} FROM x GROUP BY kind
UNION ALL SELECT 'category', kind, category, NULL, {SUMS} FROM x GROUP BY kind, category
UNION ALL SELECT 'month', kind, format('{{:04d}}/{{:02d}}', jy, jm), NULL, {SUMS} FROM x JOIN j ON g = tx_date GROUP BY kind, jy, jm
UNION ALL SELECT 'project', kind, p.name, project_id, {SUMS} FROM x LEFT JOIN projects p ON p.id = project_id GROUP BY kind, project_id, p.name
UNION ALL SELECT 'balance', NULL, NULL, NULL, CAST(sum(CASE kind WHEN 'income' THEN amount WHEN 'expense' THEN -amount ELSE 0 END) AS BIGINT), count(*), CAST(min(tx_date) AS VARCHAR), CAST(max(tx_date) AS VARCHAR) FROM x
UNION ALL SELECT 'receivable', NULL, NULL, NULL, CAST(coalesce(sum(coalesce(approved_amount, net_amount, 0) - coalesce(paid_amount, 0)), 0) AS BIGINT), count(*), NULL, NULL FROM invoices WHERE status NOT IN ('draft', 'paid')""", ("transactions", "projects", "invoices"))
def finance_summary(b):
    """The period's finance in all its sections."""
    return boards.finance(b.entity("transactions"), b.entity("projects"), b.entity("invoices"), *PERIOD)
