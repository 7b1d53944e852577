"""Customers as projects, orders as their documents, with facts that differ between documents and pages, some edited."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import summary
from ledgerloom.queries.book import Book

BOOK = Book()
KINDS = ("contract", "invoice", "letter", "guarantee", "amendment")
#: Documents, facts and projects in SQL that Spark and DuckDB both run.
DOCUMENTS = f"""SELECT o_orderkey AS doc_id, o_custkey AS project_id, CASE o_orderkey % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS category, CAST(o_orderdate AS DATE) AS date,
  concat('Order ', CAST(o_orderkey AS VARCHAR(20))) AS title, CASE WHEN o_orderkey % 19 = 0 THEN 'queued' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 7 AS VARCHAR(20)) END AS doc_no FROM orders"""
PART = "SELECT o_orderkey AS doc_id, '{field}' AS field, {value} AS value, {page} AS page, {edited} AS edited FROM orders WHERE {where}"
CENTS = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20))"
FACTS = " UNION ALL ".join(
    PART.format(field=f, value=v, page=p, edited=e, where=w)
    for f, v, p, e, w in (
        ("employer", "concat('Owner ', CAST(o_orderkey % 11 AS VARCHAR(20)))", 1, "false", "o_orderkey % 4 > 0"),
        ("employer", "concat('Named ', CAST(o_orderkey AS VARCHAR(20)))", "NULL", "true", "o_orderkey % 10 = 0"),
        ("consultant", "''", 1, "false", "o_orderkey % 2 = 0"),
        ("consultant", "concat('C', CAST(o_orderkey % 5 AS VARCHAR(20)))", 7, "false", "o_orderkey % 3 = 0"),
        ("consultant", "concat('B', CAST(o_orderkey % 5 AS VARCHAR(20)))", 3, "false", "o_orderkey % 6 = 0"),
        ("amount", CENTS, 2, "false", "o_orderkey % 3 = 0"),
        ("contract_total", CENTS, 4, "false", "o_orderkey % 5 = 1 AND o_orderkey % 2 = 0"),
        ("work_total", "CAST(o_orderkey * 1000 AS VARCHAR(20))", 5, "false", "o_orderkey % 5 = 1"),
        ("duration", "concat(CAST(1 + o_orderkey % 20 AS VARCHAR(20)), ' ماه')", 3, "false", "o_orderkey % 25 > 5"),
        ("start_date", "'1403/02/31'", 3, "false", "o_orderkey % 15 > 5"),
        ("end_date", "'1409/01/01'", 3, "false", "o_orderkey % 35 = 5"),
        ("deadline", "concat('1403/0', CAST(1 + o_orderkey % 9 AS VARCHAR(20)), '/1', CAST(o_orderkey % 7 AS VARCHAR(20)))", 1, "false", "o_orderkey % 4 = 1"),
    )
)
PROJECTS = """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '' END AS employer, CASE WHEN c_custkey % 4 = 0 THEN ' ' END AS consultant, CASE WHEN c_custkey % 2 = 0 THEN '1402/07/15' END AS start_date,
  CASE WHEN c_custkey % 5 = 0 THEN '1410/01/01' END AS end_date, CASE WHEN c_custkey % 7 = 0 THEN 5000000 ELSE 0 END AS contract_amount FROM customer"""
AS_OF = "1403/05/10"


def tables(b):
    """documents, facts, projects."""
    run = lambda sql: b.spark.sql(sql.replace("VARCHAR(20)", "STRING").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}"), **{t: b.table(t) for t in ("orders", "customer") if f"FROM {t}" in sql})
    return run(DOCUMENTS), run(FACTS), run(PROJECTS)


SOURCES = f"""docs AS ({DOCUMENTS}), facts AS ({FACTS}), projects AS ({PROJECTS}),
cur AS (SELECT doc_id, field, value, page, edited FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY edited DESC, coalesce(page, 1000000), value) AS r FROM facts WHERE trim(value) <> '') WHERE r = 1),
ready AS (SELECT * FROM docs WHERE status = 'ready'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date, doc_id) AS r FROM ready WHERE category = 'contract') WHERE r = 1),
own AS (SELECT project_id, CASE field WHEN 'amount' THEN 'contract_amount' ELSE field END AS key, value, f.doc_id, title, page, edited, 0 AS rank FROM first f JOIN cur c ON f.doc_id = c.doc_id WHERE field IN ('employer', 'consultant', 'amount', 'duration', 'start_date', 'end_date')),
term AS (SELECT o.project_id, CAST(regexp_extract(o.value, '[0-9]+') AS INT) AS n, coalesce(s.value, nullif(p.start_date, '')) AS start, o.doc_id, o.title, o.page, o.edited FROM own o LEFT JOIN own s ON s.project_id = o.project_id AND s.key = 'start_date' JOIN projects p ON p.id = o.project_id WHERE o.key = 'duration'),
ymd AS (SELECT *, CAST(substr(start, 1, 4) AS INT) * 12 + CAST(substr(start, 6, 2) AS INT) - 1 + n AS months, CAST(substr(start, 9, 2) AS INT) AS d FROM term WHERE start IS NOT NULL),
computed AS (SELECT project_id, 'end_date' AS key, printf('%04d/%02d/%02d', CAST(months // 12 AS INT), CAST(months % 12 + 1 AS INT), CAST(least(d, CASE WHEN months % 12 < 6 THEN 31 ELSE 30 END) AS INT)) AS value, doc_id, title, page, edited, 1 AS rank FROM ymd),
inv AS (SELECT r.project_id, c.value, r.doc_id, title, page, edited, row_number() OVER (PARTITION BY r.project_id ORDER BY coalesce(CAST(doc_no AS INT), 1000000) DESC, date DESC, r.doc_id DESC) AS k FROM ready r JOIN cur c ON r.doc_id = c.doc_id WHERE category = 'invoice' AND field = 'contract_total'),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY rank) AS k FROM (SELECT * FROM own UNION ALL SELECT * FROM computed UNION ALL SELECT project_id, 'contract_amount', value, doc_id, title, page, edited, 1 FROM inv WHERE k = 1)) WHERE k = 1)"""
EMPTY = " UNION ALL ".join(f"SELECT id AS project_id, '{f}' AS field FROM projects WHERE coalesce(trim(CAST({f} AS VARCHAR)), '') IN ('', '0')" for f in ("employer", "consultant", "contract_amount", "start_date", "end_date"))


@BOOK.add("project_facts", f"WITH {SOURCES} SELECT project_id, key, value, doc_id, page, edited, rank = 1 AS computed FROM picked")
def project_facts(b):
    return summary.project_facts(*tables(b)).select("project_id", "key", "value", "doc_id", "page", "edited", "computed")


@BOOK.add("project_suggestions", f"WITH {SOURCES}, empty AS ({EMPTY}) SELECT project_id, key AS field, value, doc_id FROM picked JOIN empty ON picked.project_id = empty.project_id AND picked.key = empty.field".replace("SELECT project_id, key AS field", "SELECT picked.project_id, key AS field"))
def project_suggestions(b):
    documents, facts, projects = tables(b)
    return summary.suggestions(summary.project_facts(documents, facts, projects), projects)


@BOOK.add("document_briefs", f"""
WITH {SOURCES}, lines AS ({" UNION ALL ".join(f"SELECT {kind} AS invoice, {i + 1} AS ord, '{label}' AS label, '{field}' AS field" for kind, rows in (("true", summary.INVOICE_BRIEF), ("false", summary.OTHER_BRIEF)) for i, (label, field, _) in enumerate(rows))})
SELECT d.doc_id, ord, label, value, page FROM docs d JOIN lines l ON (d.category = 'invoice') = l.invoice JOIN cur c ON c.doc_id = d.doc_id AND c.field = l.field""")
def document_briefs(b):
    documents, facts, _ = tables(b)
    return summary.brief(documents, facts).drop("money")


@BOOK.add("project_summary", f"""
WITH {SOURCES}, amount AS (SELECT p.id, coalesce(nullif(CAST(k.value AS BIGINT), 0), nullif(p.contract_amount, 0)) AS amount FROM projects p LEFT JOIN picked k ON k.project_id = p.id AND k.key = 'contract_amount'),
work AS (SELECT r.project_id, r.doc_id, CAST(c.value AS BIGINT) AS work, row_number() OVER (PARTITION BY r.project_id ORDER BY coalesce(CAST(doc_no AS INT), 1000000) DESC, date DESC, r.doc_id DESC) AS k FROM ready r LEFT JOIN cur c ON r.doc_id = c.doc_id AND c.field = 'work_total' WHERE category = 'invoice'),
due AS (SELECT project_id, r.doc_id, value AS due, row_number() OVER (PARTITION BY project_id ORDER BY value < '{AS_OF}', CASE WHEN value >= '{AS_OF}' THEN value END, CASE WHEN value < '{AS_OF}' THEN value END DESC, r.doc_id) AS k FROM ready r JOIN cur c ON r.doc_id = c.doc_id AND field = 'deadline'),
d AS (SELECT project_id, string_agg(doc_id || ' ' || due, ', ' ORDER BY k) AS deadlines FROM due WHERE k <= 12 GROUP BY 1),
t AS (SELECT project_id, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY k) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date DESC, doc_id DESC) AS k FROM ready) WHERE k <= 15 GROUP BY 1),
n AS (SELECT project_id, string_agg(category || ' ' || c, ', ' ORDER BY category) AS counts FROM (SELECT project_id, category, count(*) AS c FROM ready GROUP BY ALL) GROUP BY 1),
f AS (SELECT project_id, string_agg(key || ' ' || value || ' ' || doc_id, ', ' ORDER BY key) AS facts FROM picked GROUP BY 1),
q AS (SELECT project_id, count(*) AS documents, count(*) FILTER (status = 'queued') AS pending FROM docs GROUP BY 1)
SELECT p.id AS project_id, coalesce(q.documents, 0) AS documents, coalesce(q.pending, 0) AS pending, counts, facts, w.doc_id AS last_invoice, round(CAST(CAST(100 * nullif(work, 0) / amount AS DECIMAL(38, 10)) AS DOUBLE), 1) AS total_pct, deadlines, timeline
FROM projects p LEFT JOIN q ON q.project_id = p.id LEFT JOIN n ON n.project_id = p.id LEFT JOIN f ON f.project_id = p.id LEFT JOIN work w ON w.project_id = p.id AND w.k = 1 LEFT JOIN amount a ON a.id = p.id LEFT JOIN d ON d.project_id = p.id LEFT JOIN t ON t.project_id = p.id""")
def project_summary(b):
    s = summary.summary(*tables(b), F.lit(AS_OF))
    text = lambda a, f: F.nullif(F.array_join(F.transform(a, f), ", "), F.lit(""))
    counts = text(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    by_key = F.array_sort(F.transform("facts", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), x["doc_id"].alias("doc_id"))))
    return s.select(
        "project_id", "documents", "pending", counts.alias("counts"), text(by_key, lambda x: F.concat_ws(" ", x["key"], x["value"], x["doc_id"])).alias("facts"), F.col("last_invoice.doc_id").alias("last_invoice"), F.col("last_invoice.total_pct").alias("total_pct"),
        text(F.col("deadlines"), lambda x: F.concat_ws(" ", x["doc_id"], x["due"])).alias("deadlines"), text(F.col("timeline"), lambda x: x["doc_id"].cast("string")).alias("timeline"),
    )
