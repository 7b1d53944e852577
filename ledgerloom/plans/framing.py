"""What frames a project's story: a glance, its introduction, its money and the state of today.

A row of facts stands for a project; deadlines, guarantees and documents are summed by project before they meet it, so a project with
very many is no large group. Texts are made of columns alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import calendar, nested
from ledgerloom.plans.archive import deadline_state
from ledgerloom.plans.story import CATEGORIES, category_name, list_of, maybe, percent, quoted, rials, summed

FACTS = dict(
    x.split(":")
    for x in """name:string location:string subject:string contract:bigint contract_no:string contract_date:string employer:string contractor:string consultant:string
    contract_amount:bigint duration:string start_date:date end_date:date role:string points:array<string> progress:double work_total:bigint last_no:string last_period:string""".split()
)

# Names of roles, and what a contract's points repeat of its facts.
ROLES = {"supervisor": "ناظر / مشاور", "contractor": "پیمانکار", "employer": "کارفرما", "designer": "طراح", "site_manager": "رئیس کارگاه"}
REPEATED = r"نامیده|مبلغ\s*کل|مدت\s*قرارداد|مبلغ\s*قرارداد"
#: Percentage points between time and progress that are worth a word.
APART = 10


def number(x: Column) -> Column:
    """A whole number as text; null for 0, so that maybe() leaves its words out."""
    return F.when(x != 0, x.cast("string"))


def glance(now: Column) -> Column:
    """Time against progress, and what waits; null where there is nothing to say."""
    c = F.col
    total, passed = F.datediff("end_date", "start_date"), F.datediff(now, "start_date")
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    time = (
        F.when(passed < 0, F.concat(F.lit("کار هنوز شروع نشده و "), (-passed).cast("string"), F.lit(" روز تا آغاز آن مانده است.")))
        .when(passed <= total, F.concat(percent(passed, total), F.lit(" از مدت قرارداد گذشته و "), (total - passed).cast("string"), F.lit(" روز باقی مانده است.")))
        .otherwise(F.concat(F.lit("مدت قرارداد "), (passed - total).cast("string"), F.lit(" روز پیش به پایان رسیده است.")))
    )
    real = F.nullif("progress", F.lit(0.0))
    done = F.coalesce(real, 100 * F.nullif("work_total", F.lit(0)) / F.nullif("contract_amount", F.lit(0)))
    gap = F.least(100 * passed / total, F.lit(100.0)) - done
    kind = F.when(real.isNotNull(), "پیشرفت فیزیکی").otherwise("پیشرفت مالی (کارکرد)")
    verdict = F.when(gap > APART, F.concat(F.lit("، یعنی حدود "), whole(gap), F.lit(" درصد از برنامه‌ی زمانی عقب‌تر."))).when(gap < -APART, " و کار از برنامه‌ی زمانی جلوتر است.").otherwise(" و با برنامه‌ی زمانی هماهنگ است.")
    pace = F.when((passed >= 0) & done.isNotNull(), F.concat(kind, F.lit(" "), whole(done), F.lit("٪ است"), verdict))
    waits = list_of(*(maybe(number(c(k)), f" {words}") for k, words in (("coming", "مهلت پیش رو"), ("late", "مهلت گذشته"), ("expired", "ضمانت‌نامه‌ی منقضی"), ("soon", "ضمانت‌نامه‌ی نزدیک سررسید"))))
    said = F.concat_ws(" ", F.when(total > 0, time), F.when(total > 0, pace), F.concat(F.lit("نیازمند توجه: "), waits, F.lit(".")))
    return F.nullif(said, F.lit(""))


def introduction() -> list[Column]:
    """The sentences that introduce a project, null where a fact lacks."""
    c = F.col
    lead = F.concat(F.lit("پروژه‌ی «"), F.coalesce("name", F.lit("")), F.lit("»"), maybe(" در ", c("location")), F.coalesce(F.concat(F.lit(" با موضوع "), quoted(c("subject"), 200), F.lit(" تعریف شده است.")), F.lit(" در این بایگانی پیگیری می‌شود.")))
    parties = F.nullif(F.concat_ws(" و ", F.concat("employer", F.lit(" به‌عنوان کارفرما")), F.concat("contractor", F.lit(" به‌عنوان پیمانکار"))), F.lit(""))
    signed = F.concat(
        F.lit("قرارداد این کار"), maybe(" به شماره‌ی ", c("contract_no")), maybe(" در تاریخ ", c("contract_date")), maybe(" میان ", parties), F.lit(" منعقد شده است"),
        maybe(" و ", c("consultant"), " مشاور (دستگاه نظارت) آن است"), F.lit("."),
    )
    known = c("contract").isNotNull() | c("employer").isNotNull() | c("contractor").isNotNull()
    terms = list_of(maybe("مبلغ قرارداد ", rials(c("contract_amount")), " (", F.format_number("contract_amount", 0), " ریال) است"), maybe("مدت اجرای آن ", c("duration"), " تعیین شده"))
    start, end = calendar.jalali_text(c("start_date")), calendar.jalali_text(c("end_date"))
    period = F.coalesce(
        F.concat(F.lit("کار از "), start, F.lit(" آغاز شده و باید تا "), end, F.lit(" به پایان برسد.")),
        F.concat(F.lit("تاریخ شروع کار "), start, F.lit(".")), F.concat(F.lit("کار باید تا "), end, F.lit(" به پایان برسد.")),
    )
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.coalesce("role", F.lit("")))
    role = F.concat(F.lit("نقش شما در این پروژه «"), named, F.lit("» است."))
    points = F.filter(F.transform(F.slice(F.filter("points", lambda p: ~p.rlike(REPEATED)), 1, 2), lambda p: quoted(p, 220)), lambda p: p.isNotNull())
    also = F.when(c("contract").isNotNull() & (F.size(points) > 0), F.concat(F.lit("در متن قرارداد همچنین آمده است: "), nested.joined(points), F.lit(".")))
    return [lead, F.when(known, signed), F.concat(terms, F.lit(".")), period, role, also]


def money() -> list[Column]:
    """Invoices, the work that the last one tells, amendments, guarantees."""
    c = F.col
    which = F.nullif(F.concat_ws("، ", F.concat(F.lit("شماره‌ی "), c("last_no")), F.concat(F.lit("دوره‌ی "), c("last_period"))), F.lit(""))
    over = F.when(c("work_total") > c("contract_amount"), "؛ یعنی کارکرد از مبلغ اولیه‌ی قرارداد گذشته و باید الحاقیه یا افزایش مبلغ پیگیری شود").otherwise("")
    work = F.concat(F.lit("بر اساس آخرین صورت‌وضعیت"), maybe(" (", which, ")"), F.lit("، جمع کارکرد به "), rials(c("work_total")), F.lit(" رسیده"), maybe(" که حدود ", percent(c("work_total"), c("contract_amount")), " مبلغ قرارداد است", over), F.lit("."))
    kept = F.concat(
        number(c("guarantees")), F.lit(" ضمانت‌نامه / بیمه‌نامه در بایگانی هست"), maybe("؛ ", number(c("expired")), " مورد منقضی شده"),
        maybe("؛ ", number(c("soon")), " مورد تا یک ماه دیگر (", calendar.jalali_text(c("first_soon")), ") سررسید می‌شود و باید تمدید شود"), F.lit("."),
    )
    return [c("invoices"), F.when(c("invoices").isNotNull(), work), c("amendments"), kept]


def today() -> list[Column]:
    """The next deadline, how many have passed, and what the archive holds with its last event."""
    c = F.col
    nearest = F.concat(F.lit("نزدیک‌ترین مهلت "), calendar.jalali_text(c("next.due")), F.lit(" است: "), F.coalesce(quoted(c("next.text"), 160), F.lit("")))
    passed = F.concat(F.lit("مهلت "), number(c("late")), F.lit(" مورد از نامه‌ها و صورتجلسه‌ها گذشته است (آخرین آن‌ها "), calendar.jalali_text(c("last_late")), F.lit(")؛ اگر انجام شده‌اند جای نگرانی نیست، وگرنه پیگیری کنید."))
    kind = F.when(c("last.category").isin(*CATEGORIES), category_name(c("last.category"))).otherwise("سند")
    event = maybe(" آخرین رویداد ثبت‌شده، ", kind, " ", F.coalesce(quoted(c("last.name"), 100), F.lit("")), " مورخ ", c("last.doc_date"), " است.")
    return [nearest, passed, F.concat("tally", event)]


def frame(facts: DataFrame, docs: DataFrame, deadlines: DataFrame, guarantees: DataFrame, as_of: str) -> DataFrame:
    """project_id, section (glance, intro, money or now), seq and text, for each project of facts.

    facts: project_id and columns of FACTS (contract: the id of the contract's document); those that a table lacks, and empty texts,
    count as null. docs: as for told(). deadlines: project_id, id, due and text; guarantees: project_id, id and valid_until.
    A project has an introduction at least. The last event is the last dated document but the contract itself; of equals the larger id.
    """
    now = F.to_date(F.lit(as_of))
    lacking = {k: F.lit(None).cast(t) for k, t in FACTS.items() if k not in facts.columns}
    texts = {k: F.nullif(F.col(k), F.lit("")) for k, t in FACTS.items() if t == "string" and k in facts.columns}
    base = facts.withColumns(lacking | texts).select("project_id", *FACTS)
    left = F.col("due") >= now
    due = deadlines.filter("due IS NOT NULL").groupBy("project_id").agg(F.count_if(left).alias("coming"), F.count_if(~left).alias("late"), F.min(F.when(left, F.struct("due", "id", "text"))).alias("next"), F.max(F.when(~left, F.col("due"))).alias("last_late"))
    state = deadline_state(F.col("valid_until"), now)
    kept = guarantees.groupBy("project_id").agg(F.count(F.lit(1)).alias("guarantees"), F.count_if(state == "late").alias("expired"), F.count_if(state == "soon").alias("soon"), F.min(F.when(state == "soon", F.col("valid_until"))).alias("first_soon"))
    known = docs.withColumn("subject", F.col("subject") if "subject" in docs.columns else F.lit(None).cast("string"))
    name = F.coalesce(F.nullif("subject", F.lit("")), "title")
    contracts = facts.select(F.col("contract").alias("doc_id")) if "contract" in facts.columns else None
    dated = known.filter("doc_date IS NOT NULL")
    dated = dated.join(contracts.filter("doc_id IS NOT NULL"), "doc_id", "left_anti") if contracts is not None else dated
    last = dated.groupBy("project_id").agg(F.max(F.struct("doc_date", "doc_id", "category", name.alias("name"))).alias("last"))
    out = reduce(lambda a, b: a.join(b, "project_id", "left"), (due, kept, summed(docs).select("project_id", "invoices", "amendments", "tally"), last), base)
    parts = {"glance": [glance(now)], "intro": introduction(), "money": money(), "now": today()}
    listed = lambda section, texts: F.transform(F.filter(F.array(*texts), lambda t: t.isNotNull()), lambda t, i: F.struct(F.lit(section).alias("section"), (i + 1).alias("seq"), t.alias("text")))
    numbered = F.flatten(F.array(*(listed(section, texts) for section, texts in parts.items())))
    return out.select("project_id", F.explode(numbered).alias("x")).select("project_id", "x.section", "x.seq", "x.text")
