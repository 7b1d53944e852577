"""Records as they are written, pages as they are read, the letter register, rules learned from corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import CATALOG
from ledgerloom.functions import text as T
from ledgerloom.operators import records
from ledgerloom.plans import learning, letters, pages
from ledgerloom.plans.reports import day
from ledgerloom.queries.book import Book

BOOK = Book()
NOW, AS_OF = "2024-02-15 10:00", "2024-02-15"


@BOOK.add("record_labels", """
SELECT CASE status WHEN 'todo' THEN 'انجام‌نشده' WHEN 'doing' THEN 'در حال انجام' WHEN 'done' THEN 'انجام‌شده' ELSE status END AS status,
  CASE priority WHEN 'urgent' THEN 'فوری' WHEN 'high' THEN 'زیاد' WHEN 'medium' THEN 'متوسط' WHEN 'low' THEN 'کم' ELSE priority END AS priority, count(*) AS n FROM tasks GROUP BY ALL""", ("tasks",))
def record_labels(b):
    named = b.entity("tasks").select(records.label_of(F.col("status"), records.TASK_LABELS).alias("status"), records.label_of(F.col("priority"), records.PRIORITY_LABELS).alias("priority"))
    return named.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("record_payloads", """
SELECT id, CASE id % 5 WHEN 0 THEN 'colour: unknown' WHEN 1 THEN 'gross_amount: money' WHEN 2 THEN 'gross_amount: required' WHEN 3 THEN 'status: choice' ELSE '' END AS errors,
  CASE WHEN id % 5 IN (0, 3, 4) THEN gross_amount END AS gross_amount, CAST(0 AS BIGINT) AS deductions, CASE WHEN id % 5 = 3 THEN 'draft' ELSE 'submitted' END AS status FROM invoices""", ("invoices",))
def record_payloads(b):
    i, n = b.entity("invoices"), F.col("id") % 5
    amount = F.when(n == 1, "much").when(n == 2, " ").otherwise(F.col("gross_amount").cast("string"))
    names = ("project_id", "number", "gross_amount", "status")
    own = (F.col("project_id").cast("string"), F.col("number"), amount, F.when(n == 3, "lost").otherwise("submitted"))
    whole = F.create_map(*(x for k, v in zip(names, own) for x in (F.lit(k), v)))
    payload = F.when(n == 0, F.map_concat(whole, F.create_map(F.lit("colour"), F.lit("red")))).otherwise(whole)
    read = records.read_payload(i.select("id", payload.alias("payload")), CATALOG["invoices"])
    return read.select("id", F.array_join("errors", ", ").alias("errors"), "gross_amount", F.col("deductions").cast("long").alias("deductions"), "status")


@BOOK.add("record_update", f"""
SELECT id, CASE WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'todo' ELSE status END AS status, CASE WHEN id % 4 = 2 THEN NULL ELSE priority END AS priority,
  CASE WHEN id % 4 = 0 AND status = 'done' THEN '2020-01-01 08:00' WHEN id % 4 = 0 THEN '{NOW}' WHEN id % 4 = 1 THEN NULL WHEN status = 'done' THEN '2020-01-01 08:00' END AS completed_at FROM tasks""", ("tasks",))
def record_update(b):
    """Of four tasks one gets done, one begins anew, one loses its priority, and one has a patch with an error."""
    n = F.col("id") % 4
    tasks = b.entity("tasks").withColumn("completed_at", F.when(F.col("status") == "done", "2020-01-01 08:00"))
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    patch = F.when(n == 0, one("status", "done")).when(n == 1, one("status", "todo")).when(n == 2, one("priority", "")).otherwise(one("status", "lost"))
    return records.update(tasks, tasks.select("id", patch.alias("payload")), CATALOG["tasks"], NOW).select("id", "status", "priority", "completed_at")


@BOOK.add("record_net", """
SELECT id, CASE WHEN id % 3 = 0 THEN 1000 ELSE deductions END AS deductions, CASE WHEN id % 3 = 0 THEN gross_amount - 1000 WHEN id % 3 = 1 THEN 77 ELSE net_amount END AS net_amount FROM invoices""", ("invoices",))
def record_net(b):
    i = b.entity("invoices")
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    patch = F.when(F.col("id") % 3 == 0, one("deductions", "1,000")).otherwise(one("net_amount", "77"))
    return records.update(i, i.filter("id % 3 < 2").select("id", patch.alias("payload")), CATALOG["invoices"], NOW).select("id", "deductions", "net_amount")


@BOOK.add("record_insert", """
WITH n AS (SELECT o_orderkey AS key, o_orderkey % 1024 AS b FROM orders)
SELECT key, (SELECT max(id) FROM projects) + row_number() OVER (ORDER BY b, key) AS id FROM n""", ("projects",))
def record_insert(b):
    return records.insert(b.entity("projects"), b.table("orders").select(F.col("o_orderkey").alias("key")), "key").select("key", "id")


@BOOK.add("client_filter", "SELECT id, title FROM tasks WHERE status <> 'done' AND priority = 'high' AND contains(regexp_replace(lower(concat_ws(' ', title, status)), '[^\\p{L}\\p{N}_]+', ' ', 'g'), '1 2 high')", ("tasks",))
def client_filter(b):
    return records.narrowed(b.entity("tasks"), ["title", "status"], "1-2-HIGH", {"priority": "high", "project_id": ""}, ("done",)).select("id", "title")


@BOOK.add("recent_reports", "SELECT id, project_id, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY report_date DESC, id DESC) AS r FROM daily_reports) WHERE r <= 5", ("daily_reports",))
def recent_reports(b):
    return records.tail(b.entity("daily_reports"), [F.desc("report_date"), F.desc("id")], 5).select("id", "project_id", "place")


WORDS = """SELECT l_orderkey AS page, l_linenumber // 3 AS line, l_linenumber AS word, CAST(l_linenumber % 3 * 40 AS INT) AS x, CAST(l_linenumber // 3 * 30 + l_suppkey % 5 AS INT) AS y,
  CAST(30 + l_partkey % 8 AS INT) AS w, 20 AS h, CASE WHEN l_linenumber = 6 THEN -1 ELSE CAST(l_quantity AS DOUBLE) END AS conf, concat(l_returnflag, CASE WHEN l_linenumber = 5 THEN ' ' ELSE '' END) AS text FROM lineitem"""


def words(b):
    n, div = F.col("l_linenumber"), F.floor(F.col("l_linenumber") / 3).cast("int")
    return b.table("lineitem").select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), div.alias("line"), n.alias("word"),
        (n % 3 * 40).cast("int").alias("x"), (div * 30 + F.col("l_suppkey") % 5).cast("int").alias("y"), (30 + F.col("l_partkey") % 8).cast("int").alias("w"), F.lit(20).alias("h"),
        F.when(n == 6, F.lit(-1.0)).otherwise(F.col("l_quantity").cast("double")).alias("conf"), F.concat("l_returnflag", F.when(n == 5, " ").otherwise("")).alias("text"),
    )


@BOOK.add("ocr_lines", f"""
WITH w AS ({WORDS}) SELECT page, line, string_agg(trim(text), ' ' ORDER BY word, trim(text)) AS text, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, round(avg(conf) / 100, 6) AS confidence
FROM w WHERE conf >= 0 GROUP BY page, line""")
def ocr_lines(b):
    out = pages.lines_of_words(words(b))
    return out.select("page", F.col("line").cast("long").alias("line"), "text", "x0", "y0", "x1", "y1", F.round("confidence", 6).alias("confidence"))


READINGS = """r AS (SELECT l_orderkey AS page, l_linenumber + 8 * (l_partkey * 100000 + l_suppkey) AS ord, l_returnflag AS text, CAST(l_discount * 10 AS DOUBLE) AS score, CAST(l_suppkey % 40 AS INT) AS x0, CAST(l_linenumber * 25 + l_partkey % 20 AS INT) AS y0, CAST(l_suppkey % 40 + 30 AS INT) AS x1,
  CAST(l_linenumber * 25 + l_partkey % 20 + 22 AS INT) AS y1, l_orderkey % 2 AS half FROM lineitem),
a AS (SELECT * FROM r WHERE ord % 2 = 1), b AS (SELECT * FROM r WHERE ord % 2 = 0)"""


@BOOK.add("ocr_merge", f"""
WITH {READINGS}, p AS (SELECT a.page, a.ord AS a, b.ord AS b, b.score AS bs FROM a JOIN b ON a.page = b.page AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.3 * least(a.x1 - a.x0, b.x1 - b.x0)),
best AS (SELECT page, a, max(bs) AS s FROM p GROUP BY ALL), o AS (SELECT a.*, coalesce(best.s > a.score + 0.05, false) AS lost FROM a LEFT JOIN best ON a.page = best.page AND a.ord = best.a),
t AS (SELECT p.page, p.b, min(p.a) AS a FROM p JOIN o ON o.page = p.page AND o.ord = p.a AND o.lost GROUP BY ALL),
k AS (SELECT page, 0 AS late, ord AS spot, 0 AS then_, '' AS word, text FROM o WHERE NOT lost UNION ALL SELECT t.page, 0, t.a, t.b, '', b.text FROM t JOIN b ON b.page = t.page AND b.ord = t.b
UNION ALL SELECT b.page, 1, b.y0, 0, b.text, b.text FROM b LEFT JOIN p ON p.page = b.page AND p.b = b.ord WHERE p.page IS NULL AND b.score >= 0.5)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY late, spot, then_, word) AS INT) AS place, text FROM k""")
def ocr_merge(b):
    """Every second line of an order's items stands for another reading of the same page."""
    n = F.col("l_linenumber")
    x, y = (F.col("l_suppkey") % 40).cast("int"), (n * 25 + F.col("l_partkey") % 20).cast("int")
    lines = b.table("lineitem").select(F.col("l_orderkey").alias("page"), (n + 8 * (F.col("l_partkey") * 100000 + F.col("l_suppkey"))).alias("ord"), F.col("l_returnflag").alias("text"), (F.col("l_discount") * 10).cast("double").alias("score"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 22).alias("y1"))
    return pages.merged(lines.filter("ord % 2 = 1"), lines.filter("ord % 2 = 0"))


@BOOK.add("cell_covering", """
WITH cells AS (SELECT l_orderkey AS sheet, l_linenumber AS cell, l_linenumber AS r0, l_linenumber + l_partkey % 3 AS r1, l_suppkey % 4 AS c0, l_suppkey % 4 + 2 AS c1 FROM lineitem), points AS (SELECT DISTINCT sheet, r0 AS r, 3 AS c FROM cells)
SELECT sheet, r, c, (SELECT min(cell) FROM cells x WHERE x.sheet = p.sheet AND p.r BETWEEN r0 AND r1 AND p.c BETWEEN c0 AND c1) AS cell FROM points p""")
def cell_covering(b):
    n, c0 = F.col("l_linenumber"), F.col("l_suppkey") % 4
    cells = b.table("lineitem").select(F.col("l_orderkey").alias("sheet"), n.alias("cell"), n.cast("long").alias("r0"), (n + F.col("l_partkey") % 3).cast("long").alias("r1"), c0.alias("c0"), (c0 + 2).alias("c1"))
    points = cells.select("sheet", F.col("r0").alias("r"), F.lit(3).alias("c")).distinct()
    return pages.covering(points, cells)


@BOOK.add("page_positions", """
WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, 100 + 400 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS start FROM orders),
p AS (SELECT o_custkey AS doc_id, o_orderkey AS fact, o_orderkey % 4000 AS pos FROM orders)
SELECT doc_id, fact, pos, coalesce((SELECT max(page) FROM s WHERE s.doc_id = p.doc_id AND start <= pos), 1) AS page FROM p""")
def page_positions(b):
    from pyspark.sql import Window

    o = b.table("orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    starts = o.select(F.col("o_custkey").alias("doc_id"), page.alias("page")).withColumn("start", 100 + 400 * F.col("page"))
    return pages.page_of(o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 4000).cast("long").alias("pos"), F.col("o_orderkey").alias("fact")), starts)


CELLS = ["نام كارفزما", "پيمانکار اصلی", "مهندس  مشاور", "برگ مالی ۳", "خلاصه وضعیت", "پیشرفت کار", "مبلغ کارکرد"]
PARTY = ["کارفرما", "پیمانکار", "مشاور", None, None, None, None]
MONEY = [False, False, False, True, True, False, True]
TITLE = [None, None, None, "برگ مالی 3", None, None, None]


def choice(values) -> str:
    quoted = ", ".join("NULL" if v is None else "true" if v is True else "false" if v is False else f"'{v}'" for v in values)
    return f"([{quoted}])[1 + l_linenumber % 7]"


@BOOK.add("sheet_words", f"SELECT {choice(PARTY)} AS party, {choice(MONEY)} AS financial, {choice(TITLE)} AS title, count(*) AS n FROM lineitem GROUP BY ALL")
def sheet_words(b):
    cell = F.element_at(F.array(*map(F.lit, CELLS)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    read = b.table("lineitem").select(cell.alias("t")).select(pages.party_of(F.col("t")).alias("party"), pages.looks_financial(F.col("t")).alias("financial"), pages.sheet_title(F.col("t")).alias("title"))
    return read.groupBy("party", "financial", "title").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("best_sheets", """
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber + 8 * (l_partkey * 100000 + l_suppkey) AS ord, CASE WHEN l_partkey % 9 = 0 THEN 'برگ خلاصه' WHEN l_partkey % 2 = 0 THEN 'برگ' END AS title, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_quantity AS BIGINT) END AS contract, l_suppkey % 3 AS parties FROM lineitem)
SELECT doc_id, ord, title, contract, parties FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contains(coalesce(title, ''), 'خلاصه') DESC, coalesce(contract, 0) DESC, parties DESC, ord) AS r FROM s) WHERE r = 1""")
def best_sheets(b):
    title = F.when(F.col("l_partkey") % 9 == 0, "برگ خلاصه").when(F.col("l_partkey") % 2 == 0, "برگ")
    contract = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity").cast("long"))
    return pages.best_sheet(b.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 8 * (F.col("l_partkey") * 100000 + F.col("l_suppkey"))).alias("ord"), title.alias("title"), contract.alias("contract"), (F.col("l_suppkey") % 3).alias("parties")))


POINTS = ("به پیوست مدارک ارسال می‌گردد", "خواهشمند است بررسی شود", "تاخیر در کار دیده شد")


def register(b):
    n = F.col("id")
    second = F.when(n % 3 == 0, POINTS[1]).when(n % 3 == 1, POINTS[2])
    points = F.array_compact(F.array(F.when(n % 2 == 0, POINTS[0]).otherwise(F.lit("نامه  ( شماره ) رسید")), second))
    docs = b.entity("letters").select(
        "id", "project_id", F.when(n % 5 == 0, "drawing").when(n % 5 == 1, "order").otherwise("letter").alias("category"), F.when(n % 7 != 0, F.col("letter_date")).alias("doc_date"),
        n.cast("string").alias("key"), F.col("ref_no").cast("string").alias("ref_key"), F.col("letter_date").alias("ref_date"), (F.col("role") == "user").alias("asks"), points.alias("points"),
        F.when(n % 11 == 0, day("2024-01-20")).alias("due_date"), F.when(n % 4 == 0, n % 60).alias("due_days"),
    )
    return letters.register(docs, day(AS_OF))


REGISTER = f"""d AS (SELECT id, project_id, ref_no, role = 'user' AS asks, letter_date AS ref_date, CASE WHEN id % 7 <> 0 THEN letter_date END AS doc_date, CASE WHEN id % 2 = 0 THEN '{POINTS[0]}' ELSE 'نامه (شماره) رسید' END AS p,
  CASE WHEN id % 3 = 0 THEN '{POINTS[1]}' WHEN id % 3 = 1 THEN '{POINTS[2]}' END AS q, CASE WHEN id % 11 = 0 THEN DATE '2024-01-20' END AS due_date, CASE WHEN id % 4 = 0 THEN id % 60 END AS due_days FROM letters WHERE id % 5 <> 0),
c AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN b.doc_date = a.ref_date THEN 0 ELSE 1 END, b.id) AS r FROM d a JOIN d b ON a.ref_no = b.id AND a.id <> b.id AND (b.doc_date IS NULL OR a.doc_date IS NULL OR b.doc_date <= a.doc_date)),
e AS (SELECT dst, min(src) AS src FROM c WHERE r = 1 GROUP BY dst),
g AS (SELECT id, project_id, concat_ws(' ', p, q) AS summary, coalesce(due_date, CAST(doc_date + CAST(due_days AS INT) AS DATE)) AS due, e.src AS answered_by, CASE WHEN asks AND doc_date IS NOT NULL AND e.src IS NULL THEN CAST(greatest(0, DATE '{AS_OF}' - doc_date) AS INT) END AS waiting_days FROM d LEFT JOIN e ON e.dst = d.id)"""


@BOOK.add("letter_register", f"WITH {REGISTER} SELECT id, project_id, summary, CAST(due AS VARCHAR) AS deadline, coalesce(due < DATE '{AS_OF}', false) AS late, answered_by, waiting_days FROM g", ("letters",))
def letter_register(b):
    return register(b).select("id", "project_id", "summary", F.col("deadline").cast("string").alias("deadline"), "late", "answered_by", "waiting_days")


@BOOK.add("letter_counts", f"WITH {REGISTER} SELECT project_id, count(*) AS letters, count(waiting_days) AS unanswered, count(*) FILTER (due < DATE '{AS_OF}') AS late FROM g GROUP BY 1", ("letters",))
def letter_counts(b):
    return letters.register_counts(register(b))


LABELS = ("our file ref", "number of the plan", "registered as")


def corrections(b):
    """Orders as letters that name their number behind one of three labels, and corrections of every fourth's number."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("o_custkey") % 3 + 1).cast("int"))
    number = F.concat((F.col("o_orderkey") + 1000).cast("string"), F.lit("/"), (F.col("o_custkey") % 90 + 10).cast("string"))
    docs = b.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("To whom it concerns\nwith "), label, F.lit(": "), number, F.lit(" of today")).alias("text"), F.lower("o_orderpriority").alias("category"), number.alias("number"))
    edits = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("doc_no").alias("field"), F.col("number").alias("value"), F.col("doc_id").alias("at"))
    return docs.drop("number"), edits


LETTER = """d AS (SELECT o_orderkey AS doc_id, lower(o_orderpriority) AS category, (['our file ref', 'of the plan', 'with registered as'])[1 + o_custkey % 3] AS label, concat(CAST(o_orderkey + 1000 AS VARCHAR), '/', CAST(o_custkey % 90 + 10 AS VARCHAR)) AS number FROM orders),
r AS (SELECT category, label, count(*) AS n, max(doc_id) AS last FROM d WHERE doc_id % 4 = 0 GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (ORDER BY last DESC) AS INT) AS rank FROM r)"""


@BOOK.add("learned_labels", f"WITH {LETTER} SELECT category, label, n, rank FROM k WHERE rank <= 60")
def learned_labels(b):
    docs, edits = corrections(b)
    return learning.rules(learning.labels_of(edits, docs)).select("category", "label", "n", "rank")


@BOOK.add("learned_values", f"WITH {LETTER} SELECT d.doc_id, d.number AS value FROM d JOIN k USING (category, label) WHERE rank <= 60")
def learned_values(b):
    docs, edits = corrections(b)
    return learning.apply(docs, learning.rules(learning.labels_of(edits, docs))).select("doc_id", "value")


#: Letters as some programs write them: digits of a run mirrored, a ligature the wrong way round.
EASTERN = "٠١٢٣٤٥٦٧٨٩"
PLAIN = "'نامه ' || {c} || ' رسید'"
RIGHT = "'با سلام شماره ' || {a} || '/' || {c} || ' مورخ ' || {y} || '/{m}/{d} لازم است اعلام گردد'"
TURNED = {"a": "reverse(a)", "c": "reverse(c)", "y": "reverse(y)", "m": "50", "d": "60"}
READ = {"a": "a", "c": "c", "y": "y", "m": "05", "d": "06"}
YEARS = "len(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda r: regexp_full_match(r, '1[34][0-9][0-9]')))"


@BOOK.add("repaired_letters", f"""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 > 0 AS letter, o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 AS mirrored, CAST(1300 + o_orderkey % 150 AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS c, CAST(1390 + o_custkey % 20 AS VARCHAR) AS y FROM orders),
t AS (SELECT doc_id, letter, mirrored, CASE WHEN letter THEN {RIGHT.format(**READ)} ELSE {PLAIN.format(**READ)} END AS good, CASE WHEN letter THEN {RIGHT.format(**TURNED)} ELSE {PLAIN.format(**TURNED)} END AS back FROM o),
s AS (SELECT doc_id, letter, CASE WHEN mirrored THEN back ELSE good END AS shown, CASE WHEN mirrored THEN good ELSE back END AS other FROM t),
n AS (SELECT *, {YEARS.format(t="other")} > {YEARS.format(t="shown")} AS turn FROM s)
SELECT doc_id, CASE WHEN letter AND doc_id % 5 = 0 THEN replace(CASE WHEN turn THEN other ELSE shown END, 'لا', 'ال') WHEN turn THEN other ELSE shown END AS text, turn OR letter AND doc_id % 5 > 0 AND doc_id % 2 = 0 AS repaired
FROM n""")
def repaired_letters(b):
    """Every third letter has mirrored digits; of those with a ligature every second is broken, and every fifth shows no sign of it, for
    another page of it has the ligature as it should be. Every seventh has no year. Digits are turned where that makes more years of
    them, whatever the numbers are: a customer's number may be read as a year too."""
    year = lambda x, n: (x + n).cast("string")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    good = F.concat(F.lit("با سلام شماره "), year(o % 150, 1300), F.lit("/"), c.cast("string"), F.lit(" مورخ "), year(c % 20, 1390), F.lit("/05/06 لازم است اعلام گردد"))
    plain = F.concat(F.lit("نامه "), c.cast("string"), F.lit(" رسید"))
    broken = (o % 5 == 0) | (o % 2 == 0)
    text = F.when(o % 7 == 0, plain).when(broken, F.replace(good, F.lit("لا"), F.lit("ال"))).otherwise(good)
    turned = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1), lambda x: F.when(x.rlike("^[0-9]"), F.reverse(x)).otherwise(x)), "")
    shown = F.translate(F.when((o % 3 == 0) & (o % 7 > 0), turned).otherwise(text), "0123456789", EASTERN)
    first = b.table("orders").select(o.alias("doc_id"), F.lit(1).alias("page"), shown.alias("text"))
    second = b.table("orders").filter("o_orderkey % 5 = 0").select(o.alias("doc_id"), F.lit(2).alias("page"), F.lit("بالا").alias("text"))
    return T.repair(first.unionByName(second)).filter("page = 1").select("doc_id", "text", "repaired")
