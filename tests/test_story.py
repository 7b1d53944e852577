"""Sentences of documents."""

from ledgerloom.plans import story


def test_sentences_of_each_category(spark):
    rows = [
        (1, "letter", "file", "road works", "12/3", "the employer", ["please send the drawings", "and the maps"], None, None, None),
        (2, "letter", "file", None, None, None, [], None, None, None),
        (3, "minutes", "file", None, None, None, None, ["dig.", "fill؛"], None, None),
        (4, "report", "monthly", None, "R-1", None, None, None, ["dug", "filled"], ["rain"]),
        (5, None, "  loose   leaf. ", None, None, None, None, None, None, None),
    ]
    schema = "doc_id int, category string, title string, subject string, doc_no string, sent_to string, points array<string>, items array<string>, done array<string>, problems array<string>"
    found = {r.doc_id: r.sentence for r in story.with_sentence(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        1: "نامه‌ای به شماره‌ی 12/3 خطاب به the employer با موضوع «road works» نوشته شد؛ در این نامه آمده است: «please send the drawings» و «and the maps».",
        2: "نامه‌ای با عنوان «file» نوشته شد.",
        3: "جلسه‌ای برگزار شد و در آن مقرر شد: dig؛ fill.",
        4: "گزارش «monthly» (شماره‌ی R-1) تهیه شد؛ در این ماه dug و filled انجام شد. مهم‌ترین مشکل گزارش‌شده «rain» بود.",
        5: "سند «loose leaf» بایگانی شد.",
    }


def test_an_invoice_that_was_cut(spark):
    rows = [(1, "invoice", "file", "7", 2_500_000_000, 1_234_000_000, 100, 75, 45.5)]
    schema = "doc_id int, category string, title string, invoice_no string, work_total long, deductions long, claimed long, approved long, progress double"
    text = story.with_sentence(spark.createDataFrame(rows, schema)).first().sentence
    assert text == (
        "صورت‌وضعیت شماره‌ی 7 تهیه شد؛ جمع کارکرد تا این مرحله 2٫5 میلیارد ریال، کسورات 1٫23 میلیارد ریال و پیشرفت فیزیکی 45.5٪ است"
        ". پیمانکار برای این دوره 100 ریال درخواست کرده و مشاور 75 ریال را تأیید کرده است (حدود 25٪ کمتر)."
    )


def test_empty_and_undated(spark):
    docs = spark.createDataFrame([(1, 1, None, "other", "a"), (1, 2, None, "contract", "b"), (1, 3, "1403/01/31", "photo", "c"), (1, 4, "1403/02/01", "photo", "d"), (1, 5, "1403/02/03", "photo", "e")], "project_id int, doc_id int, doc_date string, category string, title string")
    found = {r.doc_id: (r.month, r.seq, r.text) for r in story.told(docs).collect()}
    assert found == {1: (None, 1, "سند «a» بایگانی شد."), 3: ("1403/01", 1, "در 31 فروردین، عکس «c» به بایگانی اضافه شد."), 4: ("1403/02", 1, "در 1 اردیبهشت، عکس «d» به بایگانی اضافه شد."), 5: ("1403/02", 2, "دو روز بعد، عکس «e» به بایگانی اضافه شد.")}
    assert story.told(docs.limit(0)).count() == 0 and story.summed(docs.limit(0)).count() == 0


def test_shares_and_amounts_just_below_a_half(spark):
    from pyspark.sql import functions as F

    rows = [(8_999_999, 2_000_000_000), (9_000_000, 2_000_000_000), (5, 0), (None, 7), (10**18, 10**18)]
    df = spark.createDataFrame(rows, "part long, whole long")
    assert [r[0] for r in df.select(story.percent(F.col("part"), F.col("whole"))).collect()] == ["0٫4٪", "0٫5٪", None, None, "100٪"]
    amounts = spark.createDataFrame([(9_004_994_999_999_999_999,), (9_004_995_000_000_000_000,)], "a long")
    assert [r[0] for r in amounts.select(story.rials(F.col("a"))).collect()] == ["9004995 هزار میلیارد ریال", "9004995 هزار میلیارد ریال"]
