"""A project's story: a sentence for each document, joined month by month, and the sentences that sum a project up.

Documents are rows (project_id, doc_id, doc_date, category, title); doc_date is a canonical Solar-Hijri text. What else is known of
them are the columns of KNOWN; those that a table lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import calendar, nested
from ledgerloom.operators import sets
from ledgerloom.plans.retrieval import cut_short

KNOWN = dict(
    x.split(":")
    for x in """subject:string doc_no:string sent_to:string points:array<string> gist:string deadline:string items:array<string> invoice_kind:string invoice_no:string
    period:string work_period:bigint work_total:bigint adjustment:bigint deductions:bigint net:bigint progress:double claimed:bigint approved:bigint
    amount:bigint duration:string valid_until:string done:array<string> problems:array<string> next:array<string> man_days:bigint man_avg:int contract_amount:bigint""".split()
)

# Names of the categories, and units of large amounts.
CATEGORIES = {
    "letter": "نامه", "minutes": "صورتجلسه", "invoice": "صورت‌وضعیت", "contract": "قرارداد", "amendment": "الحاقیه", "order": "دستور کار",
    "guarantee": "ضمانت‌نامه", "financial": "سند مالی", "report": "گزارش", "drawing": "نقشه", "photo": "عکس", "other": "سند دیگر",
}
UNITS = ((10**12, "هزار میلیارد"), (10**9, "میلیارد"), (10**6, "میلیون"))
BEGINNINGS = ("سپس در", "پس از آن، در", "و در")


def maybe(*parts: Column | str) -> Column:
    """The parts together, or an empty text where one of them is null."""
    return F.coalesce(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), F.lit(""))


def whole_times(a: Column, b: Column) -> Column:
    """How often b goes into a, both 0 or more, in whole numbers: a quotient of doubles or decimals may be rounded up to the next one."""
    return F.call_function("div", a, b)


def decimals(scaled: Column, digits: int) -> Column:
    """A whole number of 1/10^digits as a text, without zeros at the end."""
    n = 10**digits
    whole = whole_times(scaled, F.lit(n))
    return F.regexp_replace(F.concat(whole.cast("string"), F.lit("٫"), F.lpad((scaled - whole * n).cast("string"), digits, "0")), "٫?0*$", "")


def rials(amount: Column) -> Column:
    """An amount in words, null for nothing; two digits behind the point, halves up."""
    sign, size = F.when(amount < 0, "-").otherwise(""), F.abs(amount)
    text = F.concat(F.format_number(size, 0), F.lit(" ریال"))
    for unit, name in reversed(UNITS):
        hundredths = whole_times(size + unit // 200, F.lit(unit // 100))
        text = F.when(size >= unit, F.concat(decimals(hundredths, 2), F.lit(f" {name} ریال"))).otherwise(text)
    return F.when(amount != 0, F.concat(sign, text))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one digit, halves up; null without a whole. Both are 0 or more."""
    tenths = whole_times(part.cast("decimal(30,0)") * 2000 + whole, F.nullif(whole.cast("decimal(30,0)") * 2, F.lit(0)))
    return F.when((whole > 0) & part.isNotNull(), F.concat(decimals(tenths, 1), F.lit("٪")))


def quoted(text: Column, most: int = 140) -> Column:
    """A text in quotation marks, cut at a word; null for an empty one."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(" .،:؛"))
    return F.when(s != "", F.concat(F.lit("«"), cut_short(s, most), F.lit("»")))


def firsts(texts: Column, n: int) -> Column:
    """The first n texts without the marks at their ends."""
    return F.transform(F.slice(texts, 1, n), lambda x: F.rtrim(x, F.lit(".؛ ")))


def said(prefix: str) -> Column:
    """What a document says: its first point, and the second behind a short first one."""
    one, two = (F.try_element_at("points", F.lit(i)) for i in (1, 2))
    return maybe(f"؛ {prefix}: ", quoted(one, 220), F.when(F.length(one) < 120, maybe(" و ", quoted(two, 160))).otherwise(""))


def list_of(*parts: Column) -> Column:
    """The parts that are there, joined; null if none is."""
    there = F.filter(F.array(*parts), lambda x: x != "")
    return F.when(F.size(there) > 0, nested.joined(there))


def sentence() -> Column:
    """The sentence of a document, by its category."""
    c = F.col
    no, title, subject = c("doc_no"), quoted(c("title"), 80), quoted(c("subject"))
    name = F.coalesce(subject, title, F.lit(""))
    titled = F.coalesce(title, F.lit(""))
    worth = maybe(" به مبلغ ", rials(c("amount")))

    about = F.coalesce(F.concat(F.lit(" با موضوع "), subject), F.when(no.isNull() & c("sent_to").isNull(), F.concat(F.lit(" با عنوان "), titled)), F.lit(""))
    letter = F.concat(F.lit("نامه‌ای"), maybe(" به شماره‌ی ", no), maybe(" خطاب به ", c("sent_to")), about, F.lit(" نوشته شد"), said("در این نامه آمده است"), maybe(" و برای انجام آن مهلت ", c("deadline"), " تعیین شد"), F.lit("."))

    order = F.concat(F.lit("دستور کار / ابلاغیه‌ای"), maybe(" به شماره‌ی ", no), F.lit(" با موضوع "), name, F.lit(" صادر شد"), said("در آن آمده است"), F.lit("."))

    decided = F.when(F.size("items") > 0, maybe(" و در آن مقرر شد: ", F.array_join(firsts(c("items"), 4), "؛ "))).otherwise(said("در صورتجلسه‌ی آن آمده است"))
    minutes = F.concat(F.lit("جلسه‌ای"), maybe(" با موضوع ", subject), F.lit(" برگزار شد"), decided, F.lit("."))

    total = maybe("جمع کارکرد تا این مرحله ", rials(c("work_total")), maybe(" (حدود ", percent(c("work_total"), c("contract_amount")), " مبلغ قرارداد)"))
    figures = list_of(
        maybe("کارکرد این دوره ", rials(c("work_period"))), total, maybe("تعدیل ", rials(c("adjustment"))), maybe("کسورات ", rials(c("deductions"))),
        maybe("خالص قابل پرداخت ", rials(c("net"))), maybe("پیشرفت فیزیکی ", F.translate(decimals(F.round(F.when(c("progress") != 0, c("progress")) * 100).cast("long"), 2), "٫", "."), "٪"),
    )
    less = F.when(c("approved") < c("claimed"), maybe(" (حدود ", percent(c("claimed") - c("approved"), c("claimed")), " کمتر)")).otherwise("")
    cut = (c("claimed") != 0) & (c("approved") != 0) & (c("claimed") != c("approved"))
    judged = F.when(cut, maybe(". پیمانکار برای این دوره ", rials(c("claimed")), " درخواست کرده و مشاور ", rials(c("approved")), " را تأیید کرده است", less)).otherwise(maybe("؛ مبلغ آن ", rials(c("amount")), " خوانده شد"))
    numbered = F.coalesce(F.concat(F.lit(" شماره‌ی "), c("invoice_no")), F.concat(F.lit(" "), titled))
    invoice = F.concat(F.lit("صورت‌وضعیت"), maybe(" ", c("invoice_kind")), numbered, maybe(" برای دوره‌ی ", c("period")), F.lit(" تهیه شد"), maybe("؛ ", figures, " است"), judged, F.lit("."))

    extra = list_of(maybe("مبلغ آن ", rials(c("amount"))), maybe("مدت آن ", c("duration")))
    amendment = F.concat(F.lit("الحاقیه / تمدیدی با موضوع "), name, F.lit(" به قرارداد اضافه شد"), maybe("؛ ", extra, " است"), said("در آن آمده است"), F.lit("."))
    guarantee = F.concat(F.lit("ضمانت‌نامه‌ی "), name, worth, maybe(" با اعتبار تا ", c("valid_until")), F.lit(" صادر شد."))
    contract = F.concat(F.lit("قرارداد"), maybe(" شماره‌ی ", no), F.lit(" "), name, worth, F.lit(" منعقد شد"), said("در آن آمده است"), F.lit("."))

    some = {k: F.size(k) > 0 for k in ("done", "problems", "next")}
    men = maybe(" و در مجموع ", F.format_number("man_days", 0), " نفر-روز در کارگاه کار کردند", maybe(" (به‌طور میانگین ", c("man_avg").cast("string"), " نفر در روز)"))
    trouble = nested.joined(F.transform(F.slice("problems", 1, 3), lambda x: F.coalesce(quoted(x, 140), F.lit(""))))
    monthly = F.concat(
        F.coalesce(F.concat(F.lit("گزارش ماهانه‌ی "), c("period")), F.concat(F.lit("گزارش "), name)), maybe(" (شماره‌ی ", no, ")"), F.lit(" تهیه شد"),
        F.when(some["done"], F.concat(F.lit("؛ در این ماه "), nested.joined(firsts(c("done"), 4)), F.lit(" انجام شد"))).otherwise(""), men, F.lit("."),
        F.when(some["problems"], F.concat(F.when(F.size("problems") == 1, " مهم‌ترین مشکل گزارش‌شده ").otherwise(" مشکلات گزارش‌شده: "), trouble, F.lit(" بود."))).otherwise(""),
        F.when(some["next"], F.concat(F.lit(" برای ماه بعد "), nested.joined(firsts(c("next"), 3)), F.when(F.size("next") > 3, " و کارهای دیگر").otherwise(""), F.lit(" برنامه‌ریزی شده است."))).otherwise(""),
    )
    plain = F.concat(F.lit("گزارش "), name, F.lit(" تهیه شد"), said("در این گزارش آمده است"), F.lit("."))
    report = F.when(F.coalesce(some["done"], F.lit(False)) | F.coalesce(some["problems"], F.lit(False)) | F.coalesce(some["next"], F.lit(False)), monthly).otherwise(plain)

    financial = F.concat(F.lit("سند مالی "), titled, worth, F.lit(" ثبت شد."))
    kept = F.concat(category_name(c("category")), F.lit(" "), titled, F.lit(" به بایگانی اضافه شد."))
    other = F.concat(F.lit("سند "), name, F.lit(" بایگانی شد"), said("در آن آمده است"), F.lit("."))
    kinds = {"letter": letter, "order": order, "minutes": minutes, "invoice": invoice, "amendment": amendment, "guarantee": guarantee, "contract": contract, "report": report, "financial": financial, "drawing": kept, "photo": kept}
    return F.coalesce(*(F.when(c("category") == kind, text) for kind, text in kinds.items()), other)


def category_name(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), F.coalesce(category, F.lit("other"))), category)


def with_sentence(docs: DataFrame) -> DataFrame:
    """docs with ``sentence``; empty texts count as null."""
    lacking = {k: F.lit(None).cast(t) for k, t in KNOWN.items() if k not in docs.columns}
    texts = {k: F.nullif(F.col(k), F.lit("")) for k, t in KNOWN.items() if t == "string" and k in docs.columns}
    full = docs.withColumns(lacking | texts)
    points = F.when(F.size("points") > 0, F.col("points")).when(F.col("gist").isNotNull(), F.array("gist"))
    return full.withColumn("points", points).withColumn("sentence", sentence()).select(*docs.columns, "sentence")


def told(docs: DataFrame) -> DataFrame:
    """project_id, month, seq, doc_id and text: dated documents by month, each behind the words that its gap to the one before asks for.

    Of documents of one day, category and number (or subject) the first stays. Those without a date follow with a null month,
    contracts left out. No task holds more than a project's month, and the undated of a project.
    """
    lacking = {k: F.lit(None).cast("string") for k in ("doc_no", "subject") if k not in docs.columns}
    keyed = with_sentence(docs).withColumns(lacking).withColumn("_k", F.coalesce("doc_no", "subject", F.col("doc_id").cast("string")))
    dated = sets.first_of_each(keyed.filter("doc_date IS NOT NULL"), ["project_id", "doc_date", "category", "_k"], [F.col("doc_id")])
    w = Window.partitionBy("project_id", "month").orderBy("doc_date", "doc_id")
    rows = dated.withColumn("month", F.substring("doc_date", 1, 7))
    rows = rows.withColumns({"seq": F.row_number().over(w), "before": F.lag("doc_date").over(w)})
    gap = calendar.days_until(F.col("doc_date"), F.col("before"))
    months = F.array(*map(F.lit, calendar.MONTHS))
    day = F.concat_ws(" ", F.substring("doc_date", 9, 2).cast("int").cast("string"), F.element_at(months, F.substring("doc_date", 6, 2).cast("int")))
    start = F.when(F.col("seq") == 1, "در").otherwise(F.element_at(F.array(*map(F.lit, BEGINNINGS)), ((F.col("seq") - 2) % 3 + 1).cast("int")))
    word = F.when(gap == 0, "در همان روز").when(gap == 1, "فردای آن روز").when(gap == 2, "دو روز بعد").when(gap == 3, "سه روز بعد").otherwise(F.concat_ws(" ", start, day))
    first = rows.select("project_id", "month", "seq", "doc_id", F.concat(word, F.lit("، "), "sentence").alias("text"))
    loose = keyed.filter("doc_date IS NULL AND coalesce(category, '') <> 'contract'")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("doc_id"))
    return first.unionByName(loose.select("project_id", F.lit(None).cast("string").alias("month"), place.alias("seq"), "doc_id", F.col("sentence").alias("text")))


def summed(docs: DataFrame) -> DataFrame:
    """project_id, n, invoices, amendments and tally: sentences on a project's invoices, amendments and documents; null where there are none.

    Documents are counted by project and category first, so a large project is no large group.
    """
    lacking = {k: F.lit(None).cast("bigint") for k in ("net", "amount") if k not in docs.columns}
    kind = docs.withColumns(lacking).withColumn("category", F.coalesce("category", F.lit("other")))
    read = F.col("net") != 0
    counts = kind.groupBy("project_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.count_if(read).alias("nets"), F.coalesce(F.sum("net"), F.lit(0)).alias("net"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount")
    )
    of = lambda name, column: F.coalesce(F.max(F.when(F.col("category") == name, F.col(column))), F.lit(0)).alias(f"{name}_{column}")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "category"))).alias("by")
    one = counts.groupBy("project_id").agg(F.sum("n").alias("n"), ordered, *(of("invoice", x) for x in ("n", "nets", "net")), *(of("amendment", x) for x in ("n", "amount")))
    c = F.col
    text = lambda name: c(name).cast("string")
    invoices = F.concat(
        F.lit("تاکنون "), text("invoice_n"), F.lit(" صورت‌وضعیت در بایگانی این پروژه ثبت شده است."),
        F.when(c("invoice_nets") >= 2, maybe(" جمع خالص قابل پرداخت ", text("invoice_nets"), " صورت‌وضعیتی که مبلغشان خوانده شد ", rials(c("invoice_net")), " است.")).otherwise(""),
    )
    amendments = F.concat(text("amendment_n"), F.lit(" الحاقیه / تمدید به قرارداد اضافه شده"), F.coalesce(F.concat(F.lit(" که جمع مبالغ خوانده‌شده‌ی آن‌ها "), rials(c("amendment_amount")), F.lit(" است.")), F.lit(".")))
    parts = nested.joined(F.transform("by", lambda x: F.concat((-x["o"]).cast("string"), F.lit(" "), category_name(x["category"]))))
    tally = F.concat(F.lit("در مجموع "), text("n"), F.lit(" سند در بایگانی این پروژه هست ("), parts, F.lit(")."))
    return one.select("project_id", "n", F.when(c("invoice_n") > 0, invoices).alias("invoices"), F.when(c("amendment_n") > 0, amendments).alias("amendments"), tally.alias("tally"))
