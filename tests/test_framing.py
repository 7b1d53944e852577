"""The frame of a story: glance, introduction, money, today; texts as they must read."""

from ledgerloom.plans import framing

AS_OF = "2024-05-10"
FACTS = "project_id long, name string, location string, subject string, contract long, contract_no string, contract_date string, employer string, contractor string, consultant string, contract_amount long, duration string, start_date string, end_date string, role string, points array<string>, progress double, work_total long, last_no string, last_period string, extra int"


def told(spark, rows, docs=(), deadlines=(), guarantees=()):
    dates = lambda df, *names: df.withColumns({n: df[n].cast("date") for n in names})
    facts = dates(spark.createDataFrame(rows, FACTS), "start_date", "end_date")
    d = spark.createDataFrame(list(docs), "project_id long, doc_id long, doc_date string, category string, title string, subject string, net long, amount long")
    due = dates(spark.createDataFrame(list(deadlines), "project_id long, id long, due string, text string"), "due")
    kept = dates(spark.createDataFrame(list(guarantees), "project_id long, id long, valid_until string"), "valid_until")
    out = {}
    for r in framing.frame(facts, d, due, kept, AS_OF).orderBy("project_id", "section", "seq").collect():
        out.setdefault((r.project_id, r.section), []).append(r.text)
    return out


BARE = (None,) * 18


def test_a_bare_project_is_introduced(spark):
    assert told(spark, [(1, "P", *BARE, 5)]) == {(1, "intro"): ["پروژه‌ی «P» در این بایگانی پیگیری می‌شود."]}
    assert told(spark, []) == {}
    assert told(spark, [(1, None, *BARE, None)])[1, "intro"] == ["پروژه‌ی «» در این بایگانی پیگیری می‌شود."]


def test_a_whole_frame(spark):
    rows = [
        (1, "P", "Q", "road works", 9, "77", "1402/10/11", "E", "C", "M", 45_250_000_000, "12 ماه", "2024-01-01", "2024-12-31", "supervisor", ["مبلغ کل قرارداد", "first.", "second", "third"], 0.0, 50_000_000_000, "3", None, 1),
        (2, "P", "", None, None, None, None, None, "C", None, 0, None, None, "2024-12-31", "other", None, 80.0, None, None, None, 1),
        (3, "R", *BARE[:10], "2024-06-01", "2024-07-01", *BARE[12:], 1),
    ]
    docs = [
        (1, 9, "1403/03/01", "contract", "the contract", None, None, None), (1, 5, "1403/02/01", "invoice", "i", None, 100, None), (1, 6, "1403/02/01", "letter", "L", "about", None, None), (1, 7, None, "invoice", "i", None, None, None),
        (2, 20, "1403/01/01", "strange", "T", None, None, None),
    ]
    due = [(1, 1, "2024-05-09", "late"), (1, 2, "2024-05-10", "now"), (1, 3, "2024-05-10", "too"), (1, 4, None, "x"), (8, 5, "2024-05-11", "nobody")]
    kept = [(1, 1, "2024-05-01"), (1, 2, "2024-06-09"), (1, 3, "2024-06-10"), (1, 4, None)]
    out = told(spark, rows, docs, due, kept)
    assert out[1, "glance"] == ["35٫6٪ از مدت قرارداد گذشته و 235 روز باقی مانده است. پیشرفت مالی (کارکرد) 110٪ است و کار از برنامه‌ی زمانی جلوتر است. نیازمند توجه: 2 مهلت پیش رو، 1 مهلت گذشته، 1 ضمانت‌نامه‌ی منقضی و 1 ضمانت‌نامه‌ی نزدیک سررسید."]
    assert out[1, "intro"] == [
        "پروژه‌ی «P» در Q با موضوع «road works» تعریف شده است.",
        "قرارداد این کار به شماره‌ی 77 در تاریخ 1402/10/11 میان E به‌عنوان کارفرما و C به‌عنوان پیمانکار منعقد شده است و M مشاور (دستگاه نظارت) آن است.",
        "مبلغ قرارداد 45٫25 میلیارد ریال (45,250,000,000 ریال) است و مدت اجرای آن 12 ماه تعیین شده.",
        "کار از 1402/10/11 آغاز شده و باید تا 1403/10/11 به پایان برسد.",
        "نقش شما در این پروژه «ناظر / مشاور» است.",
        "در متن قرارداد همچنین آمده است: «first» و «second».",
    ]
    assert out[1, "money"] == [
        "تاکنون 2 صورت‌وضعیت در بایگانی این پروژه ثبت شده است.",
        "بر اساس آخرین صورت‌وضعیت (شماره‌ی 3)، جمع کارکرد به 50 میلیارد ریال رسیده که حدود 110٫5٪ مبلغ قرارداد است؛ یعنی کارکرد از مبلغ اولیه‌ی قرارداد گذشته و باید الحاقیه یا افزایش مبلغ پیگیری شود.",
        "4 ضمانت‌نامه / بیمه‌نامه در بایگانی هست؛ 1 مورد منقضی شده؛ 1 مورد تا یک ماه دیگر (1403/03/20) سررسید می‌شود و باید تمدید شود.",
    ]
    assert out[1, "now"][0] == "نزدیک‌ترین مهلت 1403/02/21 است: «now»"
    assert out[1, "now"][1].startswith("مهلت 1 مورد از نامه‌ها و صورتجلسه‌ها گذشته است (آخرین آن‌ها 1403/02/20)؛")
    assert out[1, "now"][2] == "در مجموع 4 سند در بایگانی این پروژه هست (2 صورت‌وضعیت، 1 نامه و 1 قرارداد). آخرین رویداد ثبت‌شده، نامه «about» مورخ 1403/02/01 است."
    assert out[2, "intro"] == ["پروژه‌ی «P» در این بایگانی پیگیری می‌شود.", "قرارداد این کار میان C به‌عنوان پیمانکار منعقد شده است.", "کار باید تا 1403/10/11 به پایان برسد."]
    assert out[2, "now"] == ["در مجموع 1 سند در بایگانی این پروژه هست (1 strange). آخرین رویداد ثبت‌شده، سند «T» مورخ 1403/01/01 است."]
    assert (2, "glance") not in out and (8, "now") not in out
    assert out[3, "glance"] == ["کار هنوز شروع نشده و 22 روز تا آغاز آن مانده است."]
