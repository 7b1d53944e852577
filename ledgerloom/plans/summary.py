"""A project's summary from its documents: facts with their sources, merged by precedence; what they suggest for empty fields; briefs.

A fact is a row (doc_id, field, value, page, edited): what a document says in a field, as text, where, and whether by hand. Within a
document what was edited stands before what was read. Documents are rows (doc_id, project_id, category, date, title, status, doc_no).

Scale: facts meet documents by doc_id; of a project's documents only its first contract and its last invoice with a contract's amount go
into the facts, by one aggregate each, and lists that have a length (deadlines, timeline) are cut while they are ranked. A project with
many documents has as many rows of invoices, not one long array. Null projects are a group of their own, documents without a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.functions.nested import once
from ledgerloom.plans import archive

# Facts of a contract with their labels, in order, the project's field that each may fill, and whether it is money.
CONTRACT = (
    ("contract_no", "شماره‌ی قرارداد", "code", False),
    ("contract_date", "تاریخ قرارداد", None, False),
    ("subject", "موضوع قرارداد", None, False),
    ("employer", "کارفرما", "employer", False),
    ("contractor", "پیمانکار", "contractor", False),
    ("consultant", "مشاور", "consultant", False),
    ("contract_amount", "مبلغ قرارداد", "contract_amount", True),
    ("duration", "مدت قرارداد", None, False),
    ("start_date", "تاریخ شروع", "start_date", False),
    ("end_date", "تاریخ پایان", "end_date", False),
)
OTHER_LABELS = {"end_date": "تاریخ پایان (محاسبه از مدت)", "contract_amount": "مبلغ قرارداد (طبق صورت‌وضعیت)"}
#: What a contract's document calls these.
SOURCES = {"contract_no": "doc_no", "contract_date": "doc_date", "contract_amount": "amount"}
UNITS = {"روز": "day", "هفته": "week", "ماه": "month", "سال": "year"}
# Lines of a brief by category: label, field, whether it is money.
INVOICE_BRIEF = (("نوع صورت‌وضعیت", "invoice_kind", False), ("شماره‌ی صورت‌وضعیت", "invoice_no", False), ("دوره‌ی کارکرد", "period", False), ("کارکرد قبلی", "work_prev", True), ("کارکرد این دوره", "work_period", True), ("جمع کارکرد", "work_total", True), ("مبلغ قرارداد", "contract_total", True), ("درصد پیشرفت", "progress", False))
REPORT_BRIEF = (("شماره‌ی گزارش", "doc_no", False), ("دوره‌ی گزارش", "period", False), ("تاریخ", "doc_date", False), ("نیروی انسانی", "manpower", False), ("کارفرما", "employer", False), ("پیمانکار", "contractor", False), ("مشاور", "consultant", False))
OTHER_BRIEF = (
    ("شماره", "doc_no", False), ("تاریخ", "doc_date", False), ("موضوع", "subject", False), ("گیرنده", "to", False), ("فرستنده", "from", False), ("کارفرما", "employer", False), ("پیمانکار", "contractor", False),
    ("مشاور", "consultant", False), ("مبلغ", "amount", True), ("مدت", "duration", False), ("تاریخ شروع", "start_date", False), ("تاریخ پایان", "end_date", False), ("اعتبار تا", "valid_until", False), ("مهلت", "deadline", False),
)
DEADLINES, TIMELINE = 12, 15

C = F.col


def current(facts: DataFrame) -> DataFrame:
    """Of each document and field one fact: the edited one, else the first page's. Empty values say nothing."""
    some = facts.withColumn("edited", F.coalesce("edited", F.lit(False))).filter("trim(value) <> ''")
    rank = F.struct((~C("edited")).cast("int"), F.coalesce("page", F.lit(1 << 30)), "value")
    return some.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "page", "edited"), rank).alias("f")).select("doc_id", "field", "f.*")


def brief(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, ord, label, value, money and page: the lines of each document's brief, by its category, those that have a value."""
    lists = {"invoice": INVOICE_BRIEF, "report": REPORT_BRIEF}
    line = lambda i, x: F.struct(F.lit(i).alias("ord"), F.lit(x[0]).alias("label"), F.lit(x[1]).alias("field"), F.lit(x[2]).alias("money"))
    table = lambda rows: F.array(*(line(i + 1, x) for i, x in enumerate(rows)))
    lines = F.lit(None)
    for category, rows in lists.items():
        lines = F.when(C("category") == category, table(rows)).otherwise(lines)
    known = F.when(C("category").isin(*lists), lines).otherwise(table(OTHER_BRIEF))
    asked = documents.select("doc_id", F.explode(known).alias("x")).select("doc_id", "x.*")
    return asked.join(current(facts), ["doc_id", "field"]).select("doc_id", "ord", "label", "value", "money", "page")


def project_facts(documents: DataFrame, facts: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, key, label, value, money, doc_id, title, page, edited and computed: one row for each fact that is known of a project.

    The first contract says them; an end that it doesn't say follows from its duration and its start, or else the project's; an amount
    that it doesn't say is that of the last invoice with one. projects: id and the fields, as texts.
    """
    ready, known = documents.filter("status = 'ready'"), current(facts)
    first = ready.filter("category = 'contract'").groupBy("project_id").agg(F.min_by(F.struct("doc_id", "title"), F.struct("date", "doc_id")).alias("d")).select("project_id", "d.*")
    names = F.create_map(*(x for key, _, _, _ in CONTRACT for x in (F.lit(SOURCES.get(key, key)), F.lit(key))))
    said = first.join(known, "doc_id").withColumn("key", names[C("field")]).filter("key IS NOT NULL")
    own = said.select("project_id", "key", "value", "doc_id", "title", "page", "edited", F.lit(0).alias("rank"))
    # an end that follows
    one = lambda k: F.max(F.when(C("key") == k, C("value")))
    terms = own.groupBy("project_id").agg(one("duration").alias("duration"), one("start_date").alias("start"), F.max(F.when(C("key") == "duration", F.struct("doc_id", "title", "page", "edited"))).alias("src"))
    start = F.coalesce("start", F.nullif("start_date", F.lit("")))
    given = terms.filter("duration IS NOT NULL").join(projects.select(C("id").alias("project_id"), "start_date"), "project_id", "left")
    given = once(given, "start", calendar.normalize_date(start))
    plain = calendar.fold_digits(C("duration"))
    n = F.nullif(F.regexp_extract(plain, r"(\d+)", 1), F.lit("")).try_cast("int")
    unit = F.coalesce(*(F.when(plain.contains(word), name) for word, name in UNITS.items()))
    given = once(once(given, "n", n), "unit", unit)
    ends = once(given, "value", calendar.end_of(C("start"), C("n"), C("unit"))).select("project_id", F.lit("end_date").alias("key"), "value", "src.doc_id", "src.title", "src.page", "src.edited", F.lit(1).alias("rank")).filter("value IS NOT NULL")
    # an amount by the invoices
    number = F.coalesce(C("doc_no").try_cast("int"), F.lit(10**6))
    totals = ready.filter("category = 'invoice'").join(known.filter("field = 'contract_total'"), "doc_id")
    last = totals.groupBy("project_id").agg(F.max_by(F.struct("value", "doc_id", "title", "page", "edited"), F.struct(number, "date", "doc_id")).alias("d"))
    amounts = last.select("project_id", F.lit("contract_amount").alias("key"), "d.value", "d.doc_id", "d.title", "d.page", "d.edited", F.lit(1).alias("rank"))
    both = own.unionByName(ends).unionByName(amounts).groupBy("project_id", "key").agg(F.min_by(F.struct("value", "doc_id", "title", "page", "edited", "rank"), "rank").alias("f"))
    plain_label, other = F.create_map(*(F.lit(x) for k, label, _, _ in CONTRACT for x in (k, label))), F.create_map(*(F.lit(x) for kv in OTHER_LABELS.items() for x in kv))
    money = C("key").isin(*(k for k, _, _, m in CONTRACT if m))
    return both.select("project_id", "key", F.when(C("f.rank") == 0, plain_label[C("key")]).otherwise(other[C("key")]).alias("label"), "f.value", money.alias("money"), "f.doc_id", "f.title", "f.page", "f.edited", (C("f.rank") > 0).alias("computed"))


def suggestions(found: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, field, value and doc_id: facts for fields of a project that are empty. found: of project_facts()."""
    fields = {k: f for k, _, f, _ in CONTRACT if f}
    columns = [f for f in fields.values() if f in projects.columns]
    empty = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), C(f).cast("string").alias("now")) for f in columns)), lambda x: F.coalesce(F.trim(x["now"]), F.lit("")).isin("", "0"))
    open_ = projects.select(C("id").alias("project_id"), F.explode(empty).alias("x")).select("project_id", "x.field")
    names = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    return found.withColumn("field", names[C("key")]).join(open_, ["project_id", "field"]).select("project_id", "field", "value", "doc_id")


def amount_of(found: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id and contract_amount: as the facts have it, or else the project."""
    told = found.filter("key = 'contract_amount'").select("project_id", C("value").try_cast("long").alias("told"))
    own = projects.select(C("id").alias("project_id"), C("contract_amount").cast("string").try_cast("long").alias("own"))
    return own.join(told, "project_id", "full").select("project_id", F.coalesce(F.nullif("told", F.lit(0)), F.nullif("own", F.lit(0))).alias("contract_amount"))


def invoices(documents: DataFrame, facts: DataFrame, found: DataFrame, projects: DataFrame) -> DataFrame:
    """Invoices in order (number, date, id) with work_total, its percent of the contract's amount, and the page that says it."""
    ready = documents.filter("status = 'ready' AND category = 'invoice'")
    work = current(facts).filter("field = 'work_total'").select("doc_id", C("value").try_cast("long").alias("work_total"), "page")
    rows = ready.select("project_id", "doc_id", "doc_no", "date").join(work, "doc_id", "left").join(amount_of(found, projects), "project_id", "left")
    order = Window.partitionBy("project_id").orderBy(F.coalesce(C("doc_no").try_cast("int"), F.lit(10**6)), "date", "doc_id")
    pct = archive.percent(F.nullif("work_total", F.lit(0)), C("contract_amount"))
    return rows.withColumns({"seq": F.row_number().over(order), "total_pct": pct}).drop("contract_amount")


def guarantees(documents: DataFrame, facts: DataFrame, as_of: Column, soon: int = 30) -> DataFrame:
    """Guarantees with their last day and whether it has passed, comes soon, or not. as_of: a canonical text."""
    ready = documents.filter("status = 'ready' AND category = 'guarantee'")
    until = once(current(facts).filter("field = 'valid_until'"), "valid_until", calendar.normalize_date(C("value"))).select("doc_id", "valid_until", "page")
    left = calendar.days_until(C("valid_until"), as_of)
    return ready.select("project_id", "doc_id", "title", "date").join(until, "doc_id", "left").withColumn("state", F.when(left < 0, "expired").when(left <= soon, "soon").when(left.isNotNull(), "ok"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each project, numbered; partitions cut before they meet."""
    w = Window.partitionBy("project_id").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(C("place") <= n)


def summary(documents: DataFrame, facts: DataFrame, projects: DataFrame, as_of: Column) -> DataFrame:
    """One row for each project: counts by category, facts, suggestions, the last invoice, deadlines, timeline and what is pending.

    Facts stand in their order, each with its document and page. Deadlines: upcoming ones first, soonest first, then late ones, latest
    first. as_of: a canonical text. Arrays have a fixed length: as many as there are fields, DEADLINES and TIMELINE.
    """
    found = project_facts(documents, facts, projects)
    ready = documents.filter("status = 'ready'")
    by_category = ready.groupBy("project_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    counts = by_category.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))
    place = F.array_position(F.array(*(F.lit(k) for k, *_ in CONTRACT)), C("key"))
    told = found.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), *(c for c in found.columns if c != "project_id")))).alias("facts"))
    hints = suggestions(found, projects).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "doc_id"))).alias("suggestions"))
    last = invoices(documents, facts, found, projects).groupBy("project_id").agg(F.max_by(F.struct("doc_id", "doc_no", "work_total", "total_pct", "page"), "seq").alias("last_invoice"), F.count(F.lit(1)).alias("invoices"))
    days = once(current(facts).filter("field = 'deadline'"), "due", calendar.normalize_date(C("value"))).select("doc_id", "due", "page")
    due = ready.join(days, "doc_id").filter("due IS NOT NULL").withColumn("late", C("due") < as_of)
    near = top(due, DEADLINES, C("late"), F.when(~C("late"), C("due")), F.when(C("late"), C("due")).desc(), C("doc_id"))
    deadlines = near.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("place", "due", "late", "doc_id", "page"))).alias("deadlines"))
    recent = top(ready, TIMELINE, C("date").desc_nulls_last(), C("doc_id").desc())
    timeline = recent.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("place", "date", "category", "title", "doc_id"))).alias("timeline"))
    pending = documents.groupBy("project_id").agg(F.count_if(C("status").isin("queued", "processing")).alias("pending"), F.count(F.lit(1)).alias("documents"))
    out = projects.select(C("id").alias("project_id"), "name")
    for part in (pending, counts, told, hints, last, deadlines, timeline):
        out = out.join(part, "project_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pending", "documents", "invoices")})
