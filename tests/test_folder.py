"""A folder of delimited files, each with its own encoding, delimiter and header; words marked in a text."""

from ledgerloom.functions import text as T
from ledgerloom.plans import importing
from ledgerloom.sources import tables

A = 'تاریخ;شرح;مبلغ (تومان);ردیف\n1403/01/05;"سیمان، دو خط\nو یک; نقطه";1200;1\n\n;بی تاریخ;50;2\n1403/01/09;جمع;9;3\n'
B = "گزارش ماه,,,\nبخش مالی,,,\nتاریخ,بابت,واریز,برداشت\n1403/02/01,فروش,700,\n1403/02/02,خرید,,30\n"
C = "عنوان\tتوضیحات\nیادداشت\tمتن آن\n"
D = "day,total\n1,2\n"


def folder(tmp_path):
    for name, text, encoding in (("a", A, "utf-8"), ("b", B, "cp1256"), ("b2", B + " ", "cp1256"), ("c", C, "utf-16"), ("d", D, "ascii"), ("e", "", "ascii")):
        (tmp_path / f"{name}.csv").write_bytes(text.replace("ی", "ي").encode(encoding) if encoding == "cp1256" else text.encode(encoding))
    return str(tmp_path)


def test_each_file_by_itself(spark, tmp_path):
    cells = tables.read_cells(spark, folder(tmp_path)).cache()
    name = lambda r: r.path.rsplit("/", 1)[1][:-4]
    rows = {(name(r), r.row): r["cells"] for r in cells.collect()}
    assert rows["a", 1] == ["1403/01/05", "سیمان، دو خط\nو یک; نقطه", "1200", "1"] and ("a", 2) not in rows
    assert rows["c", 1] == ["یادداشت", "متن آن"] and rows["d", 1] == ["1", "2"]
    found = {name(r): (r["head"], r.kind) for r in importing.layouts(cells).collect()}
    assert found == {"a": (0, "transactions"), "b": (2, "transactions"), "b2": (2, "transactions"), "c": (0, "notes"), "d": (None, "skipped")}
    got = sorted((name(r), r.tx_date, r.kind, r.amount, r.guessed) for r in importing.read_folder(cells).collect())
    b = [("1403/02/01", "income", 700, False), ("1403/02/02", "expense", 30, False)]
    assert got == sorted([("a", "1403/01/04", "expense", 500, True), ("a", "1403/01/05", "expense", 12000, False), *(("b", *x) for x in b), *(("b2", *x) for x in b)])
    said = [r.description for r in importing.read_folder(cells).filter("amount = 12000").collect()]
    assert said == ["سیمان، دو خط و یک; نقطه — ردیف: 1"]
    assert [(r.title, r.content) for r in importing.read_folder(cells, "notes").collect()] == [("یادداشت", "متن آن")]
    assert importing.read_folder(cells.filter("path LIKE '%d.csv'")).count() == 0


def test_words_are_marked(spark):
    df = spark.createDataFrame([(1, 'The  <tender>, and "tenders"\nextend'), (2, None), (3, ""), (4, "قراردادِ ۱۲ كار")], "id long, text string")
    got = {r.id: r.t for r in df.select("id", T.highlight(df.text, ["tend", "قرارداد", "کار"]).alias("t")).collect()}
    assert got == {1: "The  <mark>&lt;tender&gt;,</mark> and <mark>&quot;tenders&quot;</mark>\nextend", 2: None, 3: "", 4: "<mark>قراردادِ</mark> ۱۲ <mark>كار</mark>"}
    assert df.filter("id = 1").select(T.highlight(df.text, []).alias("t")).first().t == 'The  &lt;tender&gt;, and &quot;tenders&quot;\nextend'


def test_cells_are_read_once(spark):
    """Days and amounts are used in many places, and read from their cells in one of each plan's two passes over the rows."""
    from pyspark.sql import functions as F

    from ledgerloom.functions import calendar
    from ledgerloom.plans import importing

    raw = spark.createDataFrame([("1400 / 1 - 2", "a", "5"), ("x 1400/13/1", "b", "6"), ("", "c", "-7"), (None, "جمع", "8")], "`تاریخ` string, `شرح` string, `مبلغ` string")
    rows = importing.read_rows(raw)
    assert sorted((r.tx_date, r.kind, r.amount, r.description, r.guessed) for r in rows.collect()) == [
        ("1400/01/01", "expense", 6, "b — تاریخ در فایل: x 1400/13/1", True), ("1400/01/01", "income", 7, "c", True), ("1400/01/02", "expense", 5, "a", False),
    ]
    # a day and an amount have three patterns to extract, in each of the two passes
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 6
    dates = spark.createDataFrame([("1403-1.5",), ("1403/12/31",), ("1403/07/31",), ("",), (None,), ("1403/0/1",)], "t string").select(calendar.normalize_date(F.col("t")))
    assert [r[0] for r in dates.collect()] == ["1403/01/05", None, None, None, None, None]
