import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import CATALOG
from ledgerloom.operators import records
from ledgerloom.plans import learning, letters, pages
from ledgerloom.queries import QUERIES
from tests.oracle import DATA


def test_queries_have_rows(spark):
    for name in ("client_filter", "learned_labels", "learned_values", "ocr_merge"):
        assert QUERIES[name](spark, DATA).count() > 0, name


def test_look_up_and_labels(spark):
    df = spark.createDataFrame([(1, "todo"), (2, "odd"), (3, None)], "id long, status string")
    assert records.get(df, 2).status == "odd"
    with pytest.raises(LookupError):
        records.get(df, 9)
    assert [r[0] for r in df.select(records.label_of(F.col("status"), records.TASK_LABELS)).collect()] == ["انجام‌نشده", "odd", None]


def test_payloads(spark):
    df = spark.createDataFrame([({"title": "a", "priority": ""},), ({"x": "1", "y": "2"},), (None,)], "payload map<string,string>")
    rows = records.read_payload(df, CATALOG["tasks"]).select("title", "priority", "status", "errors").collect()
    assert tuple(rows[0]) == ("a", "medium", "todo", [])
    assert rows[1].errors == ["x: unknown", "y: unknown", "title: required"]
    assert rows[2].errors == ["title: required"]
    part = records.read_payload(df, CATALOG["tasks"], partial=True).select("priority", "errors").collect()
    assert tuple(part[0]) == (None, []) and part[2].errors == []


def test_update_of_reminders(spark):
    stored = spark.createDataFrame([(1, "todo", "1403/01/01 09:00", 1, None), (2, "todo", None, 1, "old")], "id long, status string, remind_at string, reminded int, updated_at string")
    patches = spark.createDataFrame([(1, {"remind_at": "1403/01/02 9:00"})], "id long, payload map<string,string>")
    out = {r.id: r for r in records.update(stored, patches, CATALOG["tasks"], "now").collect()}
    assert (out[1].remind_at, out[1].reminded, out[1].updated_at) == ("1403/01/02 09:00", 0, "now")
    assert (out[2].reminded, out[2].updated_at) == (1, "old")


def test_insert_without_stored_records(spark):
    none = spark.createDataFrame([], "id long")
    new = spark.createDataFrame([(i * 7,) for i in range(50)], "key long")
    assert sorted(r.id for r in records.insert(none, new, "key", 8).collect()) == list(range(1, 51))


def test_scored_lines(spark):
    rows = [(1, 1, 1, 1, i, 10 * i, 0, 8, 9, 90.0, w) for i, w in enumerate(["the", "work", "of", "contractors"])]
    rows += [(1, 1, 1, 2, i, 10 * i, 20, 8, 9, 90.0, w) for i, w in enumerate(["gy", "yo", "pl"])]
    words = spark.createDataFrame(rows, "page int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string")
    score = {r.text: r.score for r in pages.scored(pages.lines_of_words(words)).collect()}
    assert score["the work of contractors"] == pytest.approx(0.9) and score["gy yo pl"] == 0


def test_merged_readings(spark):
    box = "page int, ord int, text string, score double, x0 int, y0 int, x1 int, y1 int"
    first = spark.createDataFrame([(1, 0, "good", 0.9, 0, 0, 100, 20), (1, 1, "bad", 0.1, 0, 40, 100, 60), (1, 2, "worse", 0.1, 0, 45, 100, 65)], box)
    second = spark.createDataFrame([(1, 0, "x", 0.5, 0, 0, 100, 20), (1, 1, "left", 0.8, 0, 41, 45, 61), (1, 2, "right", 0.2, 55, 41, 100, 61), (1, 3, "new", 0.7, 0, 300, 100, 320), (1, 4, "weak", 0.4, 0, 200, 100, 220)], box)
    out = pages.merged(first, second).orderBy("place").collect()
    assert [r.text for r in out] == ["good", "left", "right", "new"]


def test_points_and_pages(spark):
    starts = spark.createDataFrame([(1, 1, 0), (1, 2, 100), (2, 1, 50)], "doc_id int, page int, start int")
    where = spark.createDataFrame([(1, 99, "a"), (1, 100, "b"), (2, 3, "c"), (3, 7, None)], "doc_id int, pos int, name string")
    assert sorted(tuple(r) for r in pages.page_of(where, starts).collect()) == [(1, 99, "a", 1), (1, 100, "b", 2), (2, 3, "c", 1), (3, 7, None, 1)]


def test_summary_of_letters(spark):
    long = "متن " * 80
    points = [[], None, ["یک"], [long], ["به پیوست " + long, "چیزی", "عدم پرداخت مطالبات"], [long, "لازم است اقدام شود"], ["کوتاه", None, "دوم"]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, points array<string>")
    out = [r.summary for r in letters.with_summary(df).orderBy("id").collect()]
    assert out[:3] == ["", "", "یک"] and out[6] == "کوتاه دوم"
    assert out[3].endswith("متن…") and len(out[3]) <= 231
    assert out[4].endswith("… عدم پرداخت مطالبات") and out[4].startswith("به پیوست")
    assert out[5].endswith("… لازم است اقدام شود") and len(out[5]) <= 231


def test_learning(spark):
    docs = [(1, "شرکت نمونه ساختمان\nشماره ثبت نامه: 12/345\nمتن", "letter"), (2, "شرکت نمونه ساختمان\nشماره  ثبت نامه: 77/881 و", "letter"), (3, "تاریخ صدور برگه\n1403/5/7", "order"), (4, "تاریخ صدور برگه\n1402/11/02", "order"), (5, "", None)]
    d = spark.createDataFrame(docs, "doc_id int, text string, category string")
    edits = spark.createDataFrame([(1, "doc_no", "345/12", 1), (3, "doc_date", "1403/05/07", 2), (2, "doc_no", "9", 3)], "doc_id int, field string, value string, at int")
    rules = learning.rules(learning.labels_of(edits, d))
    assert {(r.field, r.label, r.category, r.n) for r in rules.collect()} == {("doc_no", "شماره ثبت نامه", "letter", 1), ("doc_date", "تاریخ صدور برگه", "order", 1)}
    found = {(r.doc_id, r.value) for r in learning.apply(d, rules).collect()}
    assert found == {(1, "12/345"), (2, "77/881"), (3, "1403/5/7"), (4, "1402/11/02")}
    kinds = learning.category_rules(spark.createDataFrame([(1, "minutes", 1)], "doc_id int, category string, at int"), d)
    assert {(r.doc_id, r.category) for r in learning.category_for(d, kinds).collect()} == {(1, "minutes"), (2, "minutes")}


def test_generic_labels_leave_what_is_known(spark):
    docs = spark.createDataFrame([(i, f"شماره: {i}111\nکد پرونده: {i}222\n" + "x" * 7000 + f"\nشناسه قرارداد {i}333", "letter") for i in (1, 2, 3)], "doc_id long, text string, category string")
    rule = lambda *labels: spark.createDataFrame([("letter", "doc_no", x, i + 1) for i, x in enumerate(labels)], "category string, field string, label string, rank int")
    known = spark.createDataFrame([(1, "doc_no", False), (2, "doc_no", True), (3, "doc_date", False)], "doc_id long, field string, guessed boolean")
    found = lambda r, **o: {x.doc_id: x.value for x in learning.apply(docs, r, **o).collect()}
    assert found(rule("شماره"), known=known) == {2: "2111", 3: "3111"}
    assert found(rule("شماره", "کد پرونده"), known=known) == {1: "1222", 2: "2111", 3: "3111"}
    assert found(rule("شماره")) == {1: "1111", 2: "2111", 3: "3111"}
    assert found(rule("شناسه قرارداد")) == {} and found(rule("شناسه قرارداد"), head=None) == {1: "1333", 2: "2333", 3: "3333"}
