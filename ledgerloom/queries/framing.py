"""What frames the stories of projects: glance, introduction, money and today."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import framing
from ledgerloom.queries.boards import DATED, dated
from ledgerloom.queries.book import Book
from ledgerloom.queries.reports import AS_OF, jalali
from ledgerloom.queries.story import DOCS, FA, documents, rials

BOOK = Book()
NOW = f"DATE '{AS_OF}'"
# what the fixture's customers lack, in SQL that Spark and DuckDB both run
LACKING = {
    "location": "CASE WHEN id % 4 <> 0 THEN concat('site ', CAST(id % 7 AS VARCHAR(20))) END",
    "subject": "CASE WHEN id % 3 <> 0 THEN concat('works of ', name) END",
    "contract": "CASE WHEN id % 2 = 0 THEN id END",
    "contract_no": "CASE WHEN id % 5 <> 0 THEN concat('C-', CAST(id AS VARCHAR(20))) END",
    "contract_date": "CASE WHEN id % 7 = 0 THEN '1375/01/01' END",
    "employer": "CASE WHEN id % 3 = 0 THEN 'E' END",
    "contractor": "CASE WHEN id % 5 = 1 THEN 'C' END",
    "consultant": "CASE WHEN id % 6 = 0 THEN 'M' END",
    "contract_amount": "abs(contract_amount)",
    "duration": "CASE WHEN id % 2 = 1 THEN '12 months' END",
    "role": "CASE id % 4 WHEN 0 THEN 'supervisor' WHEN 1 THEN 'contractor' WHEN 2 THEN 'other' END",
    "progress": "CAST(CASE WHEN id % 3 = 0 THEN id % 101 END AS DOUBLE)",
    "work_total": "CASE WHEN id % 10 <> 0 THEN id * 100000 END",
    "last_no": "CASE WHEN id % 8 <> 0 THEN CAST(id % 8 AS VARCHAR(20)) END",
    "last_period": "CASE WHEN id % 3 = 1 THEN 'P' END",
}
FACTS = f"SELECT id AS project_id, name, start_date, end_date, {', '.join(f'{v} AS {k}' for k, v in LACKING.items())} FROM ({DATED})"


def share(part: str, whole: str) -> str:
    """SQL of a share in percent with one digit."""
    tenths = f"(({part}) * 2000 + {whole}) // (2 * {whole})"
    return f"CASE WHEN {whole} > 0 THEN concat(regexp_replace(concat(CAST({tenths} // 10 AS VARCHAR), '٫', CAST({tenths} % 10 AS VARCHAR)), '٫?0*$', ''), '٪') END"


def hijri(day: str) -> str:
    return f"(SELECT format('{{:04d}}/{{:02d}}/{{:02d}}', jy, jm, jd) FROM j WHERE g = {day})"


def joined(parts: str) -> str:
    return f"CASE WHEN len({parts}) = 0 THEN NULL WHEN len({parts}) = 1 THEN {parts}[1] ELSE concat(array_to_string({parts}[:-2], '، '), ' و ', {parts}[-1]) END"


WAITS = "list_filter([CASE WHEN coming > 0 THEN concat(coming, ' مهلت پیش رو') END, CASE WHEN late > 0 THEN concat(late, ' مهلت گذشته') END, CASE WHEN expired > 0 THEN concat(expired, ' ضمانت‌نامه‌ی منقضی') END, CASE WHEN soon > 0 THEN concat(soon, ' ضمانت‌نامه‌ی نزدیک سررسید') END], lambda x: x IS NOT NULL)"
TERMS = f"list_filter(['مبلغ قرارداد ' || ({rials('contract_amount')}) || ' (' || format('{{:,}}', contract_amount) || ' ریال) است', 'مدت اجرای آن ' || duration || ' تعیین شده'], lambda x: x IS NOT NULL)"
ROLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in framing.ROLES.items())


@BOOK.add("story_frame", f"""
WITH fact AS ({FACTS}), {DOCS}, due AS (SELECT project_id, id, due_date AS due, title AS text FROM tasks WHERE status <> 'done'), kept AS (SELECT project_id, id, submit_date + 365 AS valid_until FROM invoices WHERE id % 4 = 3),
{jalali("SELECT DISTINCT g FROM (SELECT due AS g FROM due UNION ALL SELECT valid_until FROM kept UNION ALL SELECT day FROM docs UNION ALL SELECT start_date FROM fact UNION ALL SELECT end_date FROM fact) WHERE g IS NOT NULL")},
du AS (SELECT project_id, count(*) FILTER (due >= {NOW}) AS coming, count(*) FILTER (due < {NOW}) AS late, min((due, id, text)) FILTER (due >= {NOW}) AS nx, max(due) FILTER (due < {NOW}) AS last_late FROM due WHERE due IS NOT NULL GROUP BY 1),
gu AS (SELECT project_id, count(*) AS guarantees, count(*) FILTER (valid_until < {NOW}) AS expired, count(*) FILTER (valid_until BETWEEN {NOW} AND {NOW} + 30) AS soon, min(valid_until) FILTER (valid_until BETWEEN {NOW} AND {NOW} + 30) AS first_soon FROM kept GROUP BY 1),
ca AS (SELECT project_id, category, count(*) AS n, min(doc_id) AS first FROM docs GROUP BY ALL),
li AS (SELECT project_id, list(concat(n, ' ', CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FA.items())} END) ORDER BY n DESC, first) AS parts FROM ca GROUP BY 1),
to_ AS (SELECT project_id, count(*) AS n, count(*) FILTER (category = 'invoice') AS i, count(*) FILTER (category = 'invoice' AND net <> 0) AS k, CAST(sum(net) FILTER (category = 'invoice') AS BIGINT) AS net,
  count(*) FILTER (category = 'amendment') AS m, CAST(sum(amount) FILTER (category = 'amendment') AS BIGINT) AS worth FROM docs GROUP BY 1),
la AS (SELECT project_id, max((day, doc_id, category, coalesce(nullif(subject, ''), number))) AS last FROM docs WHERE day IS NOT NULL AND doc_id NOT IN (SELECT contract FROM fact WHERE contract IS NOT NULL) GROUP BY 1),
a0 AS (SELECT fact.*, coming, late, nx, last_late, guarantees, expired, soon, first_soon, parts, n, i, k, net, m, worth, last, end_date - start_date AS total, {NOW} - start_date AS passed,
  coalesce(nullif(progress, 0), 100 * nullif(work_total, 0) / nullif(contract_amount, 0)::DOUBLE) AS done, nullif(progress, 0) IS NOT NULL AS physical
  FROM fact LEFT JOIN du USING (project_id) LEFT JOIN gu USING (project_id) LEFT JOIN li USING (project_id) LEFT JOIN to_ USING (project_id) LEFT JOIN la USING (project_id)),
a1 AS (SELECT *, least(100.0::DOUBLE * passed / total, 100.0::DOUBLE) - done AS gap, {WAITS} AS waits, {TERMS} AS terms FROM a0),
t AS (SELECT project_id, 'glance' AS section, [nullif(concat_ws(' ',
    CASE WHEN total > 0 THEN CASE WHEN passed < 0 THEN concat('کار هنوز شروع نشده و ', -passed, ' روز تا آغاز آن مانده است.') WHEN passed <= total THEN concat({share('passed', 'total')}, ' از مدت قرارداد گذشته و ', total - passed, ' روز باقی مانده است.') ELSE concat('مدت قرارداد ', passed - total, ' روز پیش به پایان رسیده است.') END END,
    CASE WHEN total > 0 AND passed >= 0 AND done IS NOT NULL THEN concat(CASE WHEN physical THEN 'پیشرفت فیزیکی' ELSE 'پیشرفت مالی (کارکرد)' END, ' ', CAST(round_even(done, 0) AS BIGINT), '٪ است',
      CASE WHEN gap > 10 THEN concat('، یعنی حدود ', CAST(round_even(gap, 0) AS BIGINT), ' درصد از برنامه‌ی زمانی عقب‌تر.') WHEN gap < -10 THEN ' و کار از برنامه‌ی زمانی جلوتر است.' ELSE ' و با برنامه‌ی زمانی هماهنگ است.' END) END,
    'نیازمند توجه: ' || ({joined('waits')}) || '.'), '')] AS l FROM a1
UNION ALL SELECT project_id, 'intro', [concat('پروژه‌ی «', name, '»', ' در ' || location, coalesce(' با موضوع «' || subject || '» تعریف شده است.', ' در این بایگانی پیگیری می‌شود.')),
    CASE WHEN contract IS NOT NULL OR employer IS NOT NULL OR contractor IS NOT NULL THEN concat('قرارداد این کار', ' به شماره‌ی ' || contract_no, ' در تاریخ ' || contract_date, ' میان ' || nullif(concat_ws(' و ', employer || ' به‌عنوان کارفرما', contractor || ' به‌عنوان پیمانکار'), ''), ' منعقد شده است', ' و ' || consultant || ' مشاور (دستگاه نظارت) آن است', '.') END,
    ({joined('terms')}) || '.', coalesce('کار از ' || {hijri('start_date')} || ' آغاز شده و باید تا ' || {hijri('end_date')} || ' به پایان برسد.', 'تاریخ شروع کار ' || {hijri('start_date')} || '.', 'کار باید تا ' || {hijri('end_date')} || ' به پایان برسد.'),
    'نقش شما در این پروژه «' || CASE role {ROLES} END || '» است.'] FROM a1
UNION ALL SELECT project_id, 'money', [CASE WHEN i > 0 THEN concat('تاکنون ', i, ' صورت‌وضعیت در بایگانی این پروژه ثبت شده است.', CASE WHEN k >= 2 THEN concat(' جمع خالص قابل پرداخت ', k, ' صورت‌وضعیتی که مبلغشان خوانده شد ', {rials('net')}, ' است.') END) END,
    CASE WHEN i > 0 THEN 'بر اساس آخرین صورت‌وضعیت' || coalesce(' (' || nullif(concat_ws('، ', 'شماره‌ی ' || last_no, 'دوره‌ی ' || last_period), '') || ')', '') || '، جمع کارکرد به ' || ({rials('work_total')}) || ' رسیده'
      || coalesce(' که حدود ' || ({share('work_total', 'contract_amount')}) || ' مبلغ قرارداد است' || CASE WHEN work_total > contract_amount THEN '؛ یعنی کارکرد از مبلغ اولیه‌ی قرارداد گذشته و باید الحاقیه یا افزایش مبلغ پیگیری شود' ELSE '' END, '') || '.' END,
    CASE WHEN m > 0 THEN concat(m, ' الحاقیه / تمدید به قرارداد اضافه شده', coalesce(' که جمع مبالغ خوانده‌شده‌ی آن‌ها ' || ({rials('worth')}) || ' است.', '.')) END,
    CASE WHEN guarantees > 0 THEN concat(guarantees, ' ضمانت‌نامه / بیمه‌نامه در بایگانی هست', CASE WHEN expired > 0 THEN concat('؛ ', expired, ' مورد منقضی شده') END, CASE WHEN soon > 0 THEN concat('؛ ', soon, ' مورد تا یک ماه دیگر (', {hijri('first_soon')}, ') سررسید می‌شود و باید تمدید شود') END, '.') END] FROM a1
UNION ALL SELECT project_id, 'now', ['نزدیک‌ترین مهلت ' || {hijri('nx[1]')} || ' است: «' || nx[3] || '»', CASE WHEN late > 0 THEN concat('مهلت ', late, ' مورد از نامه‌ها و صورتجلسه‌ها گذشته است (آخرین آن‌ها ', {hijri('last_late')}, ')؛ اگر انجام شده‌اند جای نگرانی نیست، وگرنه پیگیری کنید.') END,
    CASE WHEN n > 0 THEN concat('در مجموع ', n, ' سند در بایگانی این پروژه هست (', {joined('parts')}, ').', ' آخرین رویداد ثبت‌شده، ' || CASE last[3] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FA.items())} END || ' «' || last[4] || '» مورخ ' || {hijri('last[1]')} || ' است.') END] FROM a1),
v AS (SELECT project_id, section, list_filter(l, lambda x: x IS NOT NULL) AS l FROM t)
SELECT project_id, section, CAST(unnest(range(len(l))) + 1 AS INT) AS seq, unnest(l) AS text FROM v""", ("projects", "tasks", "invoices"))
def story_frame(b):
    """Every project's frame; deadlines are open tasks, guarantees run a year from an invoice's day."""
    made = {k: F.expr(v.replace("VARCHAR(20)", "STRING")) for k, v in LACKING.items()}
    facts = dated(b).select(F.col("id").alias("project_id"), "name", "start_date", "end_date", *(v.alias(k) for k, v in made.items()))
    due = b.entity("tasks").filter("status <> 'done'").select("project_id", "id", F.col("due_date").alias("due"), F.col("title").alias("text"))
    kept = b.entity("invoices").filter("id % 4 = 3").select("project_id", "id", F.date_add("submit_date", 365).alias("valid_until"))
    return framing.frame(facts, documents(b), due, kept, AS_OF)
