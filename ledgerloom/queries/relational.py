"""Listing, search, validation and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import CATALOG
from ledgerloom.functions import calendar, numbers
from ledgerloom.functions import text as T
from ledgerloom.operators import listing, sets
from ledgerloom.plans import matching, reports
from ledgerloom.queries.book import Book

BOOK = Book()
AS_OF = "1998-06-15"


@BOOK.add("entity_list_filter", """
SELECT t.id, t.title, t.status, t.priority, CAST(t.due_date AS VARCHAR) AS due_date, p.name AS project_name FROM tasks t LEFT JOIN projects p ON p.id = t.project_id
WHERE t.priority IN ('urgent', 'high') AND t.due_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND t.status NOT IN ('done')
ORDER BY CASE t.status WHEN 'doing' THEN 0 WHEN 'todo' THEN 1 WHEN 'waiting' THEN 2 WHEN 'done' THEN 3 WHEN 'cancelled' THEN 4 ELSE 5 END, t.due_date NULLS LAST,
  CASE t.priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, t.id LIMIT 500""", ("tasks", "projects"))
def entity_list_filter(b):
    joined = listing.with_project_name(b.entity("tasks"), b.entity("projects"))
    found = listing.list_records(joined, CATALOG["tasks"], {"priority": ["urgent", "high"], "status": ""}, date_from=F.to_date(F.lit("1997-01-01")), date_to=F.to_date(F.lit("1999-12-31")), exclude_status=("done",), limit=500)
    return found.select("id", "title", "status", "priority", F.col("due_date").cast("string").alias("due_date"), "project_name")


@BOOK.add("entity_search_like", """
SELECT id, title, status FROM tasks WHERE lower(title) LIKE '%1%urgent%' OR lower(title) LIKE '%99_3-%'""", ("tasks",))
def entity_search_like(b):
    return b.entity("tasks").filter(listing.free_text(("title",), "1%URGENT") | listing.free_text(("title",), "99_3-")).select("id", "title", "status")


@BOOK.add("date_range_scan", "SELECT id, amount, CAST(report_date AS VARCHAR) AS report_date FROM daily_reports WHERE report_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'", ("daily_reports",))
def date_range_scan(b):
    rows = reports.in_period(b.entity("daily_reports"), "report_date", "2024-01-10", "2024-01-19")
    return rows.select("id", "amount", F.col("report_date").cast("string").alias("report_date"))


@BOOK.add("validation_report", """
WITH raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 3 THEN '' ELSE strftime(l_shipdate, '%Y/%m/%d') END AS tx_date,
  CASE WHEN l_returnflag = 'N' THEN 'income' WHEN l_returnflag = 'R' THEN 'expense' ELSE 'other' END AS kind,
  CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',000') END AS amount,
  CASE WHEN l_linenumber = 2 THEN '  ' ELSE 'work' END AS description FROM lineitem),
e AS (SELECT *, tx_date = '' AS no_date, tx_date <> '' AND TRY_CAST(substr(tx_date, 9, 2) AS INT) > CASE WHEN TRY_CAST(substr(tx_date, 6, 2) AS INT) <= 6 THEN 31 ELSE 30 END AS bad_date,
  kind = 'other' AS bad_kind, amount = 'n/a' AS bad_amount, trim(description) = '' AS no_text FROM raw)
SELECT error, count(*) AS n, min(id) AS first_id FROM (
  SELECT id, 'tx_date: required' AS error FROM e WHERE no_date UNION ALL SELECT id, 'tx_date: date' FROM e WHERE bad_date UNION ALL
  SELECT id, 'kind: choice' FROM e WHERE bad_kind UNION ALL SELECT id, 'amount: money' FROM e WHERE bad_amount UNION ALL
  SELECT id, 'description: required' FROM e WHERE no_text) GROUP BY error""")
def validation_report(b):
    li = b.table("lineitem")
    n = F.col("l_linenumber")
    raw = li.select(
        (F.col("l_orderkey") * 10 + n).alias("id"),
        F.when(n == 3, "").otherwise(F.date_format("l_shipdate", "yyyy/MM/dd")).alias("tx_date"),
        F.when(F.col("l_returnflag") == "N", "income").when(F.col("l_returnflag") == "R", "expense").otherwise("other").alias("kind"),
        F.when(n == 5, "n/a").otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",000"))).alias("amount"),
        F.when(n == 2, "  ").otherwise("work").alias("description"),
    )
    found = raw.select("id", F.explode(numbers.errors(CATALOG["transactions"], raw.columns)).alias("error"))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@BOOK.add("invoice_net_rules", """
SELECT id, coalesce(net_amount, gross_amount - coalesce(deductions, 0)) AS net, coalesce(nullif(approved_amount, 0), nullif(net_amount, 0), 0) - coalesce(paid_amount, 0) AS outstanding FROM invoices""", ("invoices",))
def invoice_net_rules(b):
    return b.entity("invoices").select("id", reports.net_rule().alias("net"), reports.outstanding().alias("outstanding"))


@BOOK.add("delete_set_null", """
WITH gone AS (SELECT id FROM projects WHERE status = 'closed')
SELECT CASE WHEN t.project_id IN (SELECT id FROM gone) THEN NULL ELSE t.project_id END AS project_id, count(*) AS n FROM tasks t GROUP BY 1""", ("projects", "tasks"))
def delete_set_null(b):
    gone = b.entity("projects").filter("status = 'closed'").select("id")
    return listing.set_null(b.entity("tasks"), gone).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("upsert_patch", """
WITH patch AS (SELECT id, 'on_hold' AS status FROM projects WHERE id % 3 = 0 UNION ALL SELECT 100000000 + id, 'active' FROM projects WHERE id % 100 = 0)
SELECT coalesce(p.id, q.id) AS id, p.name, coalesce(q.status, p.status) AS status, p.contract_amount FROM projects p FULL JOIN patch q ON p.id = q.id""", ("projects",))
def upsert_patch(b):
    p = b.entity("projects")
    patch = p.filter("id % 3 = 0").select("id", F.lit("on_hold").alias("status")).unionByName(p.filter("id % 100 = 0").select((F.col("id") + 100000000).alias("id"), F.lit("active").alias("status")))
    return listing.upsert(p, patch).select("id", "name", "status", "contract_amount")


@BOOK.add("kv_last_wins", """
SELECT user_id AS k, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id""")
def kv_last_wins(b):
    rows = b.table("events").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("version"), F.col("event_id").alias("_v"))
    return listing.last_wins(rows, "k", "_v").select("k", "value", "version")


@BOOK.add("chat_tail", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def chat_tail(b):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return b.table("conversations").select("conv_id", "turn", "role", rank.alias("r")).filter("r <= 3").drop("r")


JALALI = """
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS g FROM orders), a AS (SELECT g, (g - DATE '1970-01-01') + 1075195 AS n FROM d),
c AS (SELECT g, n // 12053 AS c33, n % 12053 AS r FROM a), f AS (SELECT g, c33, r // 1461 AS c4, r % 1461 AS r FROM c),
y AS (SELECT g, -1595 + 33 * c33 + 4 * c4 + CASE WHEN r > 365 THEN (r - 1) // 365 ELSE 0 END AS jy, CASE WHEN r > 365 THEN (r - 1) % 365 ELSE r END AS r FROM f),
j AS (SELECT g, jy, CASE WHEN r < 186 THEN r // 31 + 1 ELSE (r - 186) // 30 + 7 END AS jm, CASE WHEN r < 186 THEN r % 31 ELSE (r - 186) % 30 END + 1 AS jd FROM y)"""


@BOOK.add("month_calendar", f"""
WITH {JALALI}, z AS (SELECT jy, jm, jd, g, (jy + 1595) AS b FROM j),
k AS (SELECT *, (365 * (b + 1) + ((b + 1) // 33) * 8 + ((b + 1) % 33 + 3) // 4) - (365 * b + (b // 33) * 8 + (b % 33 + 3) // 4) AS days FROM z)
SELECT CAST(g AS VARCHAR) AS g, format('{{:04d}}/{{:02d}}/{{:02d}}', jy, jm, jd) AS jalali, CAST(isodow(g) - 1 AS INT) AS weekday,
  CAST(CASE WHEN jm <= 6 THEN 31 WHEN jm <= 11 THEN 30 WHEN days = 366 THEN 30 ELSE 29 END AS INT) AS month_end, CAST(g AS VARCHAR) AS back FROM k""")
def month_calendar(b):
    d = b.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    y, m, _ = calendar.jalali_parts(F.col("d"))
    text = calendar.jalali_text(F.col("d"))
    return d.select(F.col("d").cast("string").alias("g"), text.alias("jalali"), F.weekday("d").alias("weekday"), calendar.month_end(y, m).alias("month_end"), calendar.parse(text).cast("string").alias("back"))


@BOOK.add("add_months_end_date", f"""
WITH {JALALI}, m AS (SELECT g, (jy * 12 + jm - 1 + 18) AS t, jd FROM j), e AS (SELECT g, t // 12 AS y, t % 12 + 1 AS m, jd FROM m)
SELECT CAST(g AS VARCHAR) AS g, format('{{:04d}}/{{:02d}}/{{:02d}}', y, m, least(jd, CASE WHEN m <= 6 THEN 31 ELSE 30 END)) AS ends FROM e""")
def add_months_end_date(b):
    d = b.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    y, m, k = calendar.add_months(*calendar.jalali_parts(F.col("d")), F.lit(18))
    return d.select(F.col("d").cast("string").alias("g"), F.format_string("%04d/%02d/%02d", y, m, k).alias("ends"))


@BOOK.add("content_dedup", """
SELECT sha256(text) AS sha, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY text""")
def content_dedup(b):
    return b.table("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


@BOOK.add("project_matcher", """
WITH d AS (SELECT o_orderkey AS doc_id, o_custkey AS p, concat('Re: works at site ', CAST(o_orderkey % 50 AS VARCHAR), ', ', CASE o_orderkey % 4 WHEN 0 THEN concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) WHEN 1 THEN concat('project no. C-', CAST(o_custkey AS VARCHAR), '/X.')
    WHEN 2 THEN concat('CUSTOMER ', lpad(CAST(o_custkey AS VARCHAR), 9, '0'), ' and C-', CAST(o_custkey + 1 AS VARCHAR), '/X') ELSE 'nothing of C 7' END, ' as agreed') AS t FROM orders),
n AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ') AS t FROM d),
k AS (SELECT id, concat(' customer ', lpad(CAST(id AS VARCHAR), 9, '0'), ' ') AS k FROM projects UNION ALL SELECT id, concat(' c ', CAST(id AS VARCHAR), ' x ') FROM projects),
h AS (SELECT DISTINCT doc_id, id FROM n JOIN k ON contains(t, k))
SELECT doc_id, min(id) AS project_id FROM h GROUP BY doc_id HAVING count(*) = 1""", ("projects",))
def project_matcher(b):
    """Names share their first word, and codes their first and last: the number is the rarest."""
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    code = lambda i: F.concat(F.lit("C-"), i.cast("string"), F.lit("/X"))
    n = F.col("o_orderkey") % 4
    said = F.when(n == 0, F.concat(F.lit("Customer#"), number)).when(n == 1, F.concat(F.lit("project no. "), code(F.col("o_custkey")), F.lit("."))).when(n == 2, F.concat(F.lit("CUSTOMER "), number, F.lit(" and "), code(F.col("o_custkey") + 1))).otherwise("nothing of C 7")
    docs = b.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Re: works at site "), (F.col("o_orderkey") % 50).cast("string"), F.lit(", "), said, F.lit(" as agreed")).alias("text"))
    return matching.match_projects(docs, b.entity("projects").select("id", "name", code(F.col("id")).alias("code")))


@BOOK.add("passages_held", """
WITH k AS (SELECT item_id, CAST(n AS INT) AS n, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')[1:n], ' ') AS k FROM benchmark, (SELECT unnest([1, 2, 3, 5]) AS n)),
t AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ') AS t FROM documents)
SELECT item_id, n, count(DISTINCT doc_id) AS docs FROM k JOIN t ON contains(t, concat(' ', k, ' ')) GROUP BY ALL""")
def passages_held(b):
    """The first words of each benchmark text, one to five of them, as keys in all documents."""
    n = F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("n")
    keys = b.table("benchmark").select("item_id", T.normalize_plain(F.col("text")).alias("t"), n).select(F.struct("item_id", "n").alias("key_id"), F.array_join(F.slice(T.tokens(F.col("t")), 1, F.col("n")), " ").alias("k"))
    texts = b.table("documents").select(F.col("doc_id").alias("text_id"), T.normalize_plain(F.col("text")).alias("t"))
    return matching.held(texts, keys).groupBy(F.col("key_id.item_id").alias("item_id"), F.col("key_id.n").alias("n")).agg(F.count(F.lit(1)).alias("docs"))


@BOOK.add("number_keys", """
WITH x AS (SELECT o_orderkey, concat('0', CAST(o_orderkey % 97 AS VARCHAR), '/A-', CAST(o_orderkey AS VARCHAR), '/00', CAST(o_custkey % 7 AS VARCHAR)) AS no FROM orders),
g AS (SELECT o_orderkey, list_sort(list_transform(regexp_extract_all(no, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS l FROM x)
SELECT o_orderkey, CASE WHEN length(array_to_string(l, '')) >= 3 THEN array_to_string(l, '-') END AS key FROM g""")
def number_keys(b):
    o = b.table("orders")
    no = F.concat(F.lit("0"), (F.col("o_orderkey") % 97).cast("string"), F.lit("/A-"), F.col("o_orderkey").cast("string"), F.lit("/00"), (F.col("o_custkey") % 7).cast("string"))
    return o.select("o_orderkey", numbers.number_key(no).alias("key"))


@BOOK.add("first_of_each_day", """
SELECT * FROM (SELECT project_id, CAST(report_date AS VARCHAR) AS report_date, id, row_number() OVER (PARTITION BY project_id, report_date ORDER BY id) AS r FROM daily_reports) WHERE r = 1""", ("daily_reports",))
def first_of_each_day(b):
    rows = sets.first_of_each(b.entity("daily_reports"), ["project_id", "report_date"], [F.col("id")])
    return rows.select("project_id", F.col("report_date").cast("string").alias("report_date"), "id", F.lit(1).alias("r"))
