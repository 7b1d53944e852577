"""Letters, progress, alerts and story on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import sets
from ledgerloom.plans import archive as A
from ledgerloom.plans import extraction as E
from ledgerloom.plans.reports import day
from ledgerloom.queries.book import Book
from ledgerloom.queries.reports import jalali

BOOK = Book()
AS_OF, LATE = "2024-02-15", "1998-06-15"
LETTERS = "l AS (SELECT id, CAST(id AS VARCHAR) AS key, CAST(ref_no AS VARCHAR) AS ref_key, letter_date, letter_date AS ref_date, contains(text, '?') OR role = 'user' AS asks FROM letters)"
EDGES = """c AS (SELECT a.id AS src, a.ref_key, b.id AS dst, CASE WHEN b.letter_date = a.ref_date THEN 0 ELSE 1 END AS other FROM l a JOIN l b ON a.ref_key = b.key AND a.id <> b.id AND (b.letter_date IS NULL OR a.letter_date IS NULL OR b.letter_date <= a.letter_date)),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src, ref_key ORDER BY other, dst) AS r FROM c) WHERE r = 1)"""


def letters(b):
    d = b.entity("letters")
    asks = F.col("text").contains("?") | (F.col("role") == "user")
    return d.select("id", F.col("id").cast("string").alias("key"), F.col("ref_no").cast("string").alias("ref_key"), "letter_date", F.col("letter_date").alias("ref_date"), asks.alias("asks"))


@BOOK.add("reply_graph", f"WITH {LETTERS}, {EDGES} SELECT src, dst FROM e", ("letters",))
def reply_graph(b):
    return A.reply_graph(letters(b))


@BOOK.add("missing_refs", f"WITH {LETTERS} SELECT ref_key AS key, id AS src FROM l WHERE ref_key IS NOT NULL AND ref_key NOT IN (SELECT key FROM l)", ("letters",))
def missing_refs(b):
    return A.missing(letters(b))


@BOOK.add("unanswered", f"WITH {LETTERS}, {EDGES} SELECT id, CAST(greatest(0, DATE '{AS_OF}' - letter_date) AS INT) AS waiting_days FROM l WHERE asks AND letter_date IS NOT NULL AND id NOT IN (SELECT dst FROM e)", ("letters",))
def unanswered(b):
    rows = letters(b)
    return A.unanswered(rows, A.reply_graph(rows), day(AS_OF))


@BOOK.add("archive_overview", """
SELECT p.id AS project_id, p.name, count(l.id) AS docs, count(l.id) FILTER (l.role = 'user') AS letters, CAST(max(l.letter_date) AS VARCHAR) AS last_date FROM projects p LEFT JOIN letters l ON l.project_id = p.id GROUP BY p.id, p.name""", ("projects", "letters"))
def archive_overview(b):
    docs = b.entity("letters").select("project_id", F.when(F.col("role") == "user", "letter").otherwise("other").alias("category"), F.col("letter_date").alias("doc_date"))
    return A.overview(b.entity("projects"), docs).withColumn("last_date", F.col("last_date").cast("string"))


@BOOK.add("category_counts", """
SELECT coalesce(CASE WHEN n >= 1 THEN 'software' WHEN m >= 3 THEN 'table' END, 'other') AS category, count(*) AS docs FROM
(SELECT len(regexp_extract_all(text, 'License')) + len(regexp_extract_all(text, 'Version')) AS n, len(regexp_extract_all(text, ' \\| ')) AS m FROM documents) GROUP BY 1""")
def category_counts(b):
    licensed = A.classify(F.col("text"), [("software", ("License", "Version"))], least=1, other="")
    kind = F.when(licensed != "", licensed).otherwise(A.classify(F.col("text"), [("table", (r" \| ",))], least=3))
    return b.table("documents").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("docs"))


@BOOK.add("header_vote", """
WITH v AS (SELECT o_custkey, o_orderpriority AS value, sum(1 + o_orderkey % 2) AS votes, min(o_orderkey) AS first FROM orders GROUP BY ALL)
SELECT o_custkey, value, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1""")
def header_vote(b):
    rows = b.table("orders").select("o_custkey", F.col("o_orderpriority").alias("value"), (1 + F.col("o_orderkey") % 2).alias("w"), F.col("o_orderkey").alias("ord"))
    return sets.vote(rows, ["o_custkey"], "value", "w", "ord")


#: Readings of a customer's number and date: zeros stuck to every fifth, a wrong number in every seventh, dates with parts that can't be.
READINGS = """r AS (SELECT o_custkey AS doc_id, o_orderkey AS place, 1400 + o_custkey % 5 AS year, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_custkey + 11 AS VARCHAR(20)), '00') ELSE CAST(o_custkey + 11 AS VARCHAR(20)) END AS seq,
  CASE WHEN o_orderkey % 4 = 0 THEN 'S' WHEN o_orderkey % 4 = 1 THEN 'M' END AS suffix, 1 + o_orderkey % 2 AS weight, CASE WHEN o_orderkey % 3 = 0 THEN 1700 ELSE 1400 + o_custkey % 5 END AS y,
  CASE WHEN o_orderkey % 3 = 1 OR o_custkey % 4 = 0 THEN 60 + o_orderkey % 9 ELSE 1 + o_custkey % 12 END AS m, CASE WHEN o_orderkey % 3 = 2 AND o_custkey % 6 > 0 THEN 0 ELSE 1 + o_custkey % 29 END AS d FROM orders)"""


def readings(b):
    sql = READINGS[READINGS.index("(") + 1 : -1].replace("VARCHAR(20)", "STRING").replace("FROM orders", "FROM {orders}")
    return b.spark.sql(sql, orders=b.table("orders"))


@BOOK.add("number_votes", f"""
WITH {READINGS}, c AS (SELECT doc_id, year, seq, sum(weight) AS own, min(place) AS first FROM r GROUP BY ALL),
v AS (SELECT a.doc_id, a.year, a.seq, a.first, sum(b.own) AS votes FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.year = b.year AND starts_with(b.seq, a.seq) AND regexp_full_match(substr(b.seq, length(a.seq) + 1), '0*') GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, length(seq), first) AS k FROM v) WHERE k = 1),
s AS (SELECT w.doc_id, r.suffix, row_number() OVER (PARTITION BY w.doc_id ORDER BY sum(r.weight) DESC, min(r.place)) AS k FROM w JOIN r ON r.doc_id = w.doc_id AND r.year = w.year AND starts_with(r.seq, w.seq) WHERE r.suffix IS NOT NULL GROUP BY w.doc_id, r.suffix)
SELECT w.doc_id, CAST(w.year AS BIGINT) AS year, w.seq, s.suffix, CAST(votes AS BIGINT) AS votes FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.k = 1""")
def number_votes(b):
    return sets.vote_numbers(readings(b), ["doc_id"]).withColumn("year", F.col("year").cast("long"))


def voted(part: str, ok: str, more: str = "") -> str:
    return f"SELECT doc_id, {part}, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, min(place)) AS k FROM (SELECT doc_id, {part}, weight, place FROM r WHERE {ok}{more}) GROUP BY doc_id, {part}"


@BOOK.add("date_votes", f"""
WITH {READINGS}, f AS (SELECT doc_id, y, m, d, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, min(place)) AS k FROM r WHERE y BETWEEN 1350 AND 1460 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND (m <= 6 OR d <= 30) GROUP BY doc_id, y, m, d),
yy AS ({voted('y', 'y BETWEEN 1350 AND 1460', ' UNION ALL SELECT DISTINCT doc_id, year AS y, 1 AS weight, 1073741824 AS place FROM r')}), mm AS ({voted('m', 'm BETWEEN 1 AND 12')}), dd AS ({voted('d', 'd BETWEEN 1 AND 31')}),
p AS (SELECT yy.doc_id, y, m, d FROM yy JOIN mm ON mm.doc_id = yy.doc_id AND mm.k = 1 JOIN dd ON dd.doc_id = yy.doc_id AND dd.k = 1 WHERE yy.k = 1 AND (m <= 6 OR d <= 30))
SELECT coalesce(f.doc_id, p.doc_id) AS doc_id, CAST(coalesce(f.y, p.y) AS BIGINT) AS year, CAST(coalesce(f.m, p.m) AS BIGINT) AS month, CAST(coalesce(f.d, p.d) AS BIGINT) AS day, f.doc_id IS NOT NULL AS whole
FROM (SELECT * FROM f WHERE k = 1) f FULL JOIN p ON p.doc_id = f.doc_id""")
def date_votes(b):
    rows = readings(b)
    out = sets.vote_dates(rows, ["doc_id"], rows.select("doc_id", F.col("year").alias("y")).distinct())
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("year", "month", "day")), "whole")


@BOOK.add("boilerplate_lines", """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
o AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM l WHERE length(line) > 0 GROUP BY ALL)
SELECT o.source, line, on_pages FROM o JOIN n ON o.source = n.source WHERE on_pages >= greatest(3, pages // 3)""")
def boilerplate_lines(b):
    rows = b.table("documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return A.boilerplate(rows, "source", "doc_id", "line")


DUE = "SELECT id, project_id, CAST(due_date + CAST(id % 90 AS INT) AS DATE) AS due FROM tasks WHERE due_date IS NOT NULL AND status <> 'done'"


def dues(b):
    t = b.entity("tasks").filter("due_date IS NOT NULL AND status <> 'done'")
    return t.select("id", "project_id", F.date_add("due_date", (F.col("id") % 90).cast("int")).alias("due"))


@BOOK.add("deadlines", f"""
WITH d AS ({DUE}) SELECT id, CAST(due AS VARCHAR) AS due, CAST(due - DATE '{LATE}' AS INT) AS days_left FROM d
ORDER BY due < DATE '{LATE}', CASE WHEN due >= DATE '{LATE}' THEN due - DATE '{LATE}' END, CASE WHEN due < DATE '{LATE}' THEN due - DATE '{LATE}' END DESC, id LIMIT 12""", ("tasks",))
def deadlines(b):
    return A.deadlines(dues(b), day(LATE)).select("id", F.col("due").cast("string").alias("due"), "days_left")


@BOOK.add("guarantees", f"WITH d AS ({DUE}) SELECT CASE WHEN due < DATE '{LATE}' THEN 'late' WHEN due - DATE '{LATE}' <= 30 THEN 'soon' ELSE 'later' END AS state, count(*) AS n FROM d GROUP BY 1", ("tasks",))
def guarantees(b):
    return dues(b).groupBy(A.deadline_state(F.col("due"), day(LATE)).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("invoice_progress", """
WITH i AS (SELECT id, project_id, submit_date, coalesce(net_amount, gross_amount - deductions) AS work, CASE WHEN id % 6 <> 0 THEN id % 50 END AS no FROM invoices),
o AS (SELECT *, row_number() OVER w AS seq, sum(work) OVER (w ROWS UNBOUNDED PRECEDING) AS total, lead(id) OVER w IS NULL AS is_last FROM i WINDOW w AS (PARTITION BY project_id ORDER BY no NULLS LAST, submit_date NULLS LAST, id))
SELECT id, project_id, CAST(seq AS INT) AS seq, CAST(total AS BIGINT) AS total, CAST(total - work AS BIGINT) AS prev, CAST(work AS BIGINT) AS period, is_last FROM o""", ("invoices",))
def invoice_progress(b):
    i = b.entity("invoices").select("id", "project_id", "submit_date", F.coalesce("net_amount", F.col("gross_amount") - F.col("deductions")).alias("work"), F.when(F.col("id") % 6 != 0, F.col("id") % 50).alias("no"))
    return A.progress(i).select("id", "project_id", "seq", "total", "prev", "period", "is_last")


@BOOK.add("s_curve", """
WITH d AS (SELECT project_id, submit_date AS day, sum(gross_amount) AS work FROM invoices GROUP BY ALL)
SELECT project_id, CAST(day AS VARCHAR) AS day, CAST(day - min(day) OVER (PARTITION BY project_id) AS INT) AS x, CAST(sum(work) OVER (PARTITION BY project_id ORDER BY day) AS BIGINT) AS y FROM d""", ("invoices",))
def s_curve(b):
    points = b.entity("invoices").select("project_id", F.col("submit_date").alias("day"), F.col("gross_amount").alias("work"))
    return A.s_curve(points).select("project_id", F.col("day").cast("string").alias("day"), "x", "y")


FACTS = f"""li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY submit_date DESC, id DESC) AS r FROM invoices WHERE submit_date <= DATE '{LATE}') WHERE r = 1),
w AS (SELECT project_id, min(submit_date) AS s, max(submit_date) AS e, CAST(sum(gross_amount - deductions) AS DOUBLE) AS work FROM invoices GROUP BY project_id),
f AS (SELECT w.project_id, w.s, CAST(w.e - CAST(w.project_id % 2000 AS INT) AS DATE) AS e, w.work, CAST(p.contract_amount AS DOUBLE) * 40 AS amount, CAST(li.gross_amount AS DOUBLE) AS claimed, CAST(li.approved_amount AS DOUBLE) AS approved,
  li.id % 6 = 0 AS bad, li.submit_date AS li, CAST(li.id % 90 AS DOUBLE) AS prog, w.project_id % 4 AS probs FROM w LEFT JOIN li USING (project_id) LEFT JOIN projects p ON p.id = w.project_id)"""
DUES = f"d AS ({DUE}), x AS (SELECT *, CAST(due - DATE '{LATE}' AS INT) AS days FROM d)"


@BOOK.add("control_alerts", f"""
WITH {FACTS}, {DUES}, g AS (SELECT *, e - s AS total, DATE '{LATE}' - s AS passed FROM f),
h AS (SELECT *, CASE WHEN total > 0 AND passed > 0 THEN least(100.0, round(100.0 * passed / total, 1)) END AS spent, CASE WHEN work <> 0 AND amount <> 0 THEN round(100 * work / amount, 1) END AS fin FROM g),
a AS (SELECT project_id, 'time' AS rule, CASE WHEN passed > total THEN 'red' WHEN total - passed <= 60 THEN 'amber' END AS severity, CAST(abs(total - passed) AS DOUBLE) AS n, NULL AS ref FROM h WHERE total > 0 AND passed > 0
UNION ALL SELECT project_id, 'work', CASE WHEN spent - fin >= 30 THEN 'red' WHEN spent - fin >= 15 THEN 'amber' WHEN spent - fin <= -10 THEN 'info' END, spent - fin, NULL FROM h
UNION ALL SELECT project_id, 'cut', CASE WHEN round(100 * (claimed - approved) / claimed, 1) >= 3 THEN 'amber' END, round(100 * (claimed - approved) / claimed, 1), NULL FROM h WHERE approved <> 0 AND approved < claimed
UNION ALL SELECT project_id, 'sums', 'amber', NULL, NULL FROM h WHERE bad UNION ALL SELECT project_id, 'invoice', 'amber', CAST(DATE '{LATE}' - li AS DOUBLE), NULL FROM h WHERE DATE '{LATE}' - li > 60
UNION ALL SELECT project_id, 'progress', 'info', abs(prog - fin), NULL FROM h WHERE prog <> 0 AND abs(prog - fin) >= 15 UNION ALL SELECT project_id, 'problems', 'info', CAST(probs AS DOUBLE), NULL FROM h WHERE probs > 0
UNION ALL SELECT project_id, 'guarantee', CASE WHEN days < 0 THEN 'red' ELSE 'amber' END, CAST(days AS DOUBLE), id FROM x WHERE days <= 30
UNION ALL SELECT project_id, 'late', 'red', CAST(count(*) AS DOUBLE), arg_max(id, (due, -id)) FROM x WHERE days BETWEEN -60 AND -1 GROUP BY project_id
UNION ALL SELECT project_id, 'soon', 'amber', CAST(count(*) AS DOUBLE), arg_min(id, (due, id)) FROM x WHERE days BETWEEN 1 AND 7 GROUP BY project_id
UNION ALL SELECT project_id, 'letters', 'amber', CAST(count(*) AS DOUBLE), arg_max(id, (wait, -id)) FROM (SELECT id, project_id, CAST(DATE '{AS_OF}' - letter_date AS INT) AS wait FROM letters) WHERE wait >= 14 GROUP BY project_id)
SELECT project_id, rule, severity, round(n, 4) AS n, CAST(ref AS BIGINT) AS ref,
  CAST(row_number() OVER (PARTITION BY project_id ORDER BY list_position(['red', 'amber', 'info'], severity), list_position(['time', 'work', 'cut', 'sums', 'invoice', 'progress', 'guarantee', 'late', 'soon', 'letters', 'problems'], rule), ref NULLS FIRST) AS INT) AS place
FROM a WHERE severity IS NOT NULL""", ("invoices", "projects", "tasks", "letters"))
def control_alerts(b):
    i, now = b.entity("invoices"), day(LATE)
    last = sets.first_of_each(i.filter(F.col("submit_date") <= now), ["project_id"], [F.desc("submit_date"), F.desc("id")])
    last = last.select("project_id", F.col("gross_amount").cast("double").alias("claimed"), F.col("approved_amount").cast("double").alias("approved"), (F.col("id") % 6 == 0).alias("check_failed"), F.col("submit_date").alias("invoice_date"), (F.col("id") % 90).cast("double").alias("progress"))
    work = i.groupBy("project_id").agg(F.min("submit_date").alias("start_date"), F.max("submit_date").alias("_e"), F.sum(F.col("gross_amount") - F.col("deductions")).cast("double").alias("work"))
    p = b.entity("projects").select(F.col("id").alias("project_id"), (F.col("contract_amount").cast("double") * 40).alias("contract_amount"))
    number = (F.col("project_id") % 2000).cast("int")
    facts = work.join(last, "project_id", "left").join(p, "project_id", "left").withColumns({"end_date": F.date_sub("_e", number), "problems": F.array_repeat(F.lit("x"), (F.col("project_id") % 4).cast("int"))})
    waiting = b.entity("letters").select("id", "project_id", F.datediff(day(AS_OF), "letter_date").alias("waiting_days"))
    out = A.by_severity(A.alerts(facts, dues(b).withColumnRenamed("due", "valid_until"), dues(b), waiting, now))
    return out.select("project_id", "rule", "severity", F.round("n", 4).alias("n"), "ref", "place")


@BOOK.add("letters_by_month", f"""
WITH {jalali("SELECT DISTINCT letter_date AS g FROM letters")} SELECT CASE WHEN l.id % 9 = 0 THEN '—' ELSE format('{{:04d}}/{{:02d}}', jy, jm) END AS month, count(*) AS n, count(*) FILTER (role = 'user') AS late
FROM letters l JOIN j ON g = l.letter_date GROUP BY 1""", ("letters",))
def letters_by_month(b):
    rows = b.entity("letters").select(F.when(F.col("id") % 9 != 0, F.col("letter_date")).alias("letter_date"), (F.col("role") == "user").alias("late"))
    return A.letters_by_month(rows)


@BOOK.add("library_stats", "SELECT count(*) AS documents, CAST(sum(n_chars % 7) AS BIGINT) AS pages, count(*) FILTER (lang IN ('fr', 'de')) AS pending FROM documents")
def library_stats(b):
    state = F.when(F.col("lang") == "fr", "queued").when(F.col("lang") == "de", "processing").otherwise("ready")
    return A.library(b.table("documents").select(state.alias("status"), (F.col("n_chars") % 7).alias("pages")))


WORK = "SELECT id, project_id, CASE WHEN id % 3 <> 0 THEN gross_amount END AS work_period, deductions AS work_prev, CASE WHEN id % 4 <> 0 THEN gross_amount + deductions + CASE WHEN id % 5 = 0 THEN gross_amount // 10 ELSE 0 END END AS work_total FROM invoices"


@BOOK.add("invoice_work", f"WITH w AS ({WORK}) SELECT id, coalesce(work_period, work_total - work_prev) AS work_period, coalesce(work_total, work_period + work_prev) AS work_total, coalesce(abs(work_prev + work_period - work_total) > 0.02 * abs(work_total), false) AS work_check FROM w", ("invoices",))
def invoice_work(b):
    i, n = b.entity("invoices"), F.col("id")
    more = F.when(n % 5 == 0, F.floor(F.col("gross_amount") / 10)).otherwise(0)
    rows = i.select("id", F.when(n % 3 != 0, F.col("gross_amount")).alias("work_period"), F.col("deductions").alias("work_prev"), F.when(n % 4 != 0, F.col("gross_amount") + F.col("deductions") + more).alias("work_total"))
    return A.derived_work(rows).select("id", "work_period", "work_total", "work_check")


@BOOK.add("invoice_records", """
SELECT project_id, number, gross_amount, deductions, net_amount, 'submitted' AS status, CAST(submit_date AS VARCHAR) AS submit_date FROM (SELECT project_id, CASE WHEN id % 8 <> 0 THEN number ELSE 'untitled' END AS number,
  CASE WHEN id % 3 <> 0 THEN gross_amount ELSE net_amount END AS gross_amount, deductions, net_amount, submit_date, id FROM invoices) WHERE gross_amount IS NOT NULL AND gross_amount <> 0 AND (id % 2 = 1 OR id % 8 = 0)""", ("invoices",))
def invoice_records(b):
    """Every second invoice is stored already, under its number; the untitled ones are not."""
    i, n = b.entity("invoices"), F.col("id")
    found = i.select("project_id", F.when(n % 8 != 0, F.col("number")).alias("invoice_no"), F.lit("untitled").alias("title"), F.when(n % 3 != 0, F.col("gross_amount")).alias("work_period"), F.lit(None).cast("long").alias("adjustment"), "deductions", F.col("net_amount").alias("net"), F.col("submit_date").alias("doc_date"))
    return A.invoice_records(found, i.filter(n % 2 == 0)).withColumn("submit_date", F.col("submit_date").cast("string"))


@BOOK.add("story_timeline", """
WITH e AS (SELECT id, project_id, report_date AS day, work_done AS kind, CAST(amount % 3 AS VARCHAR) AS subject FROM daily_reports),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, day, kind, subject ORDER BY id) AS r FROM e) WHERE r = 1),
g AS (SELECT *, row_number() OVER w AS seq, day - lag(day) OVER w AS gap FROM k WINDOW w AS (PARTITION BY project_id, date_trunc('month', day) ORDER BY day, id))
SELECT id, CAST(seq AS INT) AS seq, CAST(gap AS INT) AS gap, CASE WHEN gap IS NULL THEN 'first' WHEN gap = 0 THEN 'same day' WHEN gap = 1 THEN 'next day' WHEN gap <= 3 THEN 'days later' ELSE 'on date' END AS connector FROM g""", ("daily_reports",))
def story_timeline(b):
    e = b.entity("daily_reports").select("id", "project_id", F.col("report_date").alias("day"), F.col("work_done").alias("kind"), (F.col("amount") % 3).cast("string").alias("subject"))
    return A.story_order(e).select("id", "seq", "gap", "connector")


SHEET = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS role, CAST(round(l_extendedprice) AS BIGINT) AS prev, CAST(round(l_quantity * 100) AS BIGINT) AS period, CAST(round(l_extendedprice) AS BIGINT) + CAST(round(l_quantity * 100) AS BIGINT) + CASE WHEN l_linenumber = 4 THEN 1000 ELSE l_linenumber END AS total, l_linenumber = 7 AS is_sum FROM lineitem"


def sheet(b):
    li, n = b.table("lineitem"), F.col("l_linenumber")
    prev, period = F.round("l_extendedprice").cast("long"), F.round(F.col("l_quantity") * 100).cast("long")
    return li.select((F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_returnflag").alias("role"), prev.alias("prev"), period.alias("period"), (prev + period + F.when(n == 4, 1000).otherwise(n)).alias("total"), (n == 7).alias("is_sum"))


@BOOK.add("sheet_rollup", f"WITH s AS ({SHEET}) SELECT role, CAST(sum(prev) AS BIGINT) AS prev, CAST(sum(period) AS BIGINT) AS period, CAST(sum(total) AS BIGINT) AS total FROM s WHERE NOT is_sum GROUP BY role")
def sheet_rollup(b):
    return A.roll_up(sheet(b))


@BOOK.add("sheet_residuals", f"WITH s AS ({SHEET}) SELECT id, prev, period, total, prev + period - total AS residual, abs(prev + period - total) <= 10 AS ok, CASE WHEN abs(prev + period - total) <= 10 THEN total ELSE prev + period END AS total_fixed FROM s")
def sheet_residuals(b):
    return A.reconcile(sheet(b)).select("id", "prev", "period", "total", "residual", "ok", "total_fixed")


RULES = [("en", "License", "license", 1), ("en", "Version", "version", 2), ("fr", "License", "licence", 1), ("de", " | ", "tabelle", 3)]


@BOOK.add("learned_rules", f"""
WITH r(category, label, value, rank) AS (VALUES {', '.join(map(str, RULES))})
SELECT doc_id, CAST(rank AS INT) AS rank, value FROM (SELECT d.doc_id, r.rank, r.value, row_number() OVER (PARTITION BY doc_id ORDER BY rank, value) AS n FROM documents d JOIN r ON r.category = d.lang AND contains(d.text, r.label)) WHERE n = 1""")
def learned_rules(b):
    rules = b.spark.createDataFrame(RULES, "category string, label string, value string, rank int")
    return A.learned(b.table("documents").select("doc_id", "text", F.col("lang").alias("category")), rules)


@BOOK.add("document_facts")
def document_facts(b):
    docs = b.table("documents").select("doc_id", F.concat(F.lit("page "), "source").alias("title"), "text", F.lit("pdf").alias("kind"), F.lit(1).alias("pages"))
    return E.analyze(docs).select("doc_id", "info.category", "info.doc_date", "info.amount", F.size("info.refs").alias("refs"))


@BOOK.add("sheet_mend")
def sheet_mend(b):
    """Order sheets whose last digit was misread in some totals."""
    row = sheet(b).select((F.col("id") / 10).cast("long").alias("sheet"), F.col("id").alias("row"), F.col("role").alias("section"), F.lit("a").alias("role"), "prev", "period", (F.col("prev") + F.col("period") + F.when(F.col("id") % 10 == 4, 90).otherwise(0)).alias("total"), "is_sum")
    return E.mend_sheets(row)
