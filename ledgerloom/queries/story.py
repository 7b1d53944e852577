"""The story of projects, told from the fixture's invoices as documents of four categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.plans import story as S
from ledgerloom.queries.book import Book
from ledgerloom.queries.reports import jalali

BOOK = Book()
CONTRACT = 2_000_000_000


def rials(x: str) -> str:
    """SQL of an amount in words; null for nothing."""
    scaled = lambda u: f"(({x} + {u // 200}) // {u // 100})"
    short = lambda u, name: f"WHEN {x} >= {u} THEN concat(regexp_replace(concat(CAST({scaled(u)} // 100 AS VARCHAR), '٫', lpad(CAST({scaled(u)} % 100 AS VARCHAR), 2, '0')), '٫?0*$', ''), ' {name} ریال')"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN NULL {short(10**12, 'هزار میلیارد')} {short(10**9, 'میلیارد')} {short(10**6, 'میلیون')} ELSE concat(format('{{:,}}', {x}), ' ریال') END"


TENTHS = f"((work_total * 2000 + {CONTRACT}) // {2 * CONTRACT})"
DOCS = f"""docs AS (SELECT id AS doc_id, project_id, number, CASE WHEN id % 9 = 0 THEN NULL ELSE submit_date END AS day, (['financial', 'invoice', 'amendment', 'guarantee'])[1 + id % 4] AS category,
  CASE WHEN id % 3 = 0 THEN concat('as ', status) END AS subject, gross_amount AS amount, gross_amount AS work_total, deductions, net_amount AS net FROM invoices),
w AS (SELECT *, concat('«', number, '»') AS title, coalesce(concat('«', nullif(subject, ''), '»'), '') AS q, {rials('amount')} AS ra, {rials('deductions')} AS rd, {rials('net')} AS rn,
  regexp_replace(concat(CAST({TENTHS} // 10 AS VARCHAR), '٫', CAST({TENTHS} % 10 AS VARCHAR)), '٫?0*$', '') AS share FROM docs),
p AS (SELECT *, CASE WHEN subject IS NULL THEN title ELSE q END AS name, list_filter(['جمع کارکرد تا این مرحله ' || ra || ' (حدود ' || share || '٪ مبلغ قرارداد)', 'کسورات ' || rd, 'خالص قابل پرداخت ' || rn], lambda x: x IS NOT NULL) AS parts FROM w),
s AS (SELECT *, CASE category
  WHEN 'invoice' THEN concat('صورت‌وضعیت شماره‌ی ', number, ' تهیه شد', CASE WHEN len(parts) = 0 THEN '' WHEN len(parts) = 1 THEN '؛ ' || parts[1] || ' است' ELSE '؛ ' || array_to_string(parts[:-2], '، ') || ' و ' || parts[-1] || ' است' END, coalesce('؛ مبلغ آن ' || ra || ' خوانده شد', ''), '.')
  WHEN 'amendment' THEN concat('الحاقیه / تمدیدی با موضوع ', name, ' به قرارداد اضافه شد', coalesce('؛ مبلغ آن ' || ra || ' است', ''), '.')
  WHEN 'guarantee' THEN concat('ضمانت‌نامه‌ی ', name, coalesce(' به مبلغ ' || ra, ''), ' صادر شد.')
  ELSE concat('سند مالی ', title, coalesce(' به مبلغ ' || ra, ''), ' ثبت شد.') END AS sentence FROM p)"""


def documents(b):
    n = F.col("id")
    category = F.element_at(F.array(*map(F.lit, ("financial", "invoice", "amendment", "guarantee"))), (n % 4 + 1).cast("int"))
    return b.entity("invoices").select(
        n.alias("doc_id"), "project_id", F.col("number").alias("title"), F.when(n % 9 != 0, calendar.jalali_text(F.col("submit_date"))).alias("doc_date"), category.alias("category"),
        F.when(n % 3 == 0, F.concat(F.lit("as "), "status")).alias("subject"), F.when(n % 4 == 1, F.col("number")).alias("invoice_no"), F.col("gross_amount").alias("amount"),
        F.col("gross_amount").alias("work_total"), "deductions", F.col("net_amount").alias("net"), F.lit(CONTRACT).cast("long").alias("contract_amount"),
    )


@BOOK.add("story_sentences", f"WITH {DOCS} SELECT doc_id, sentence FROM s", ("invoices",))
def story_sentences(b):
    return S.with_sentence(documents(b)).select("doc_id", "sentence")


NAMES = ", ".join(f"'{m}'" for m in calendar.MONTHS)


@BOOK.add("story_told", f"""WITH {DOCS}, {jalali('SELECT DISTINCT day AS g FROM docs WHERE day IS NOT NULL')},
k AS (SELECT * FROM (SELECT s.*, format('{{:04d}}/{{:02d}}', jy, jm) AS month, jm, jd, row_number() OVER (PARTITION BY project_id, day, category, coalesce(subject, CAST(doc_id AS VARCHAR)) ORDER BY doc_id) AS copy FROM s JOIN j ON g = day) WHERE copy = 1),
o AS (SELECT *, row_number() OVER m AS seq, day - lag(day) OVER m AS gap FROM k WINDOW m AS (PARTITION BY project_id, month ORDER BY day, doc_id))
SELECT project_id, month, CAST(seq AS INT) AS seq, doc_id, concat(CASE gap WHEN 0 THEN 'در همان روز' WHEN 1 THEN 'فردای آن روز' WHEN 2 THEN 'دو روز بعد' WHEN 3 THEN 'سه روز بعد'
  ELSE concat(CASE WHEN seq = 1 THEN 'در' ELSE (['سپس در', 'پس از آن، در', 'و در'])[1 + (seq - 2) % 3] END, ' ', CAST(jd AS VARCHAR), ' ', ([{NAMES}])[jm]) END, '، ', sentence) AS text FROM o
UNION ALL SELECT project_id, NULL, CAST(row_number() OVER (PARTITION BY project_id ORDER BY doc_id) AS INT), doc_id, sentence FROM s WHERE day IS NULL""", ("invoices",))
def story_told(b):
    return S.told(documents(b))


FA = {"financial": "سند مالی", "invoice": "صورت‌وضعیت", "amendment": "الحاقیه", "guarantee": "ضمانت‌نامه"}


@BOOK.add("story_sums", f"""WITH {DOCS}, c AS (SELECT project_id, category, count(*) AS n, min(doc_id) AS first FROM docs GROUP BY ALL),
l AS (SELECT project_id, list(concat(CAST(n AS VARCHAR), ' ', CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FA.items())} END) ORDER BY n DESC, first) AS parts FROM c GROUP BY project_id),
t AS (SELECT project_id, count(*) AS n, count(*) FILTER (category = 'invoice') AS i, count(*) FILTER (category = 'invoice' AND net <> 0) AS k, CAST(sum(net) FILTER (category = 'invoice') AS BIGINT) AS net,
  count(*) FILTER (category = 'amendment') AS m, CAST(sum(amount) FILTER (category = 'amendment') AS BIGINT) AS worth FROM docs GROUP BY project_id)
SELECT t.project_id, n, CASE WHEN i > 0 THEN concat('تاکنون ', CAST(i AS VARCHAR), ' صورت‌وضعیت در بایگانی این پروژه ثبت شده است.', CASE WHEN k >= 2 THEN concat(' جمع خالص قابل پرداخت ', CAST(k AS VARCHAR), ' صورت‌وضعیتی که مبلغشان خوانده شد ', {rials('net')}, ' است.') ELSE '' END) END AS invoices,
  CASE WHEN m > 0 THEN concat(CAST(m AS VARCHAR), ' الحاقیه / تمدید به قرارداد اضافه شده', coalesce(' که جمع مبالغ خوانده‌شده‌ی آن‌ها ' || ({rials('worth')}) || ' است.', '.')) END AS amendments,
  concat('در مجموع ', CAST(n AS VARCHAR), ' سند در بایگانی این پروژه هست (', CASE WHEN len(parts) = 1 THEN parts[1] ELSE concat(array_to_string(parts[:-2], '، '), ' و ', parts[-1]) END, ').') AS tally
FROM t JOIN l USING (project_id)""", ("invoices",))
def story_sums(b):
    return S.summed(documents(b))
