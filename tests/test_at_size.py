"""What keeps queries within their limits on large tables: the plans' shape, and results on odd rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_highlight_makes_the_normal_form_once_for_a_text(spark):
    rows = [(1, "The  <Tender>,\r\nΟΔΟΣ \x0bend "), (2, None), (3, ""), (4, " \n"), (5, "كتاب‌ها کتَاب$1"), (6, "x tend")]
    df = spark.createDataFrame(rows, "id int, t string")
    marked = df.select("id", T.highlight(df.t, ["tend", "the", "οδο", "کتاب"], "<$1>", "</\\>").alias("m"))
    assert {r.id: r.m for r in marked.collect()} == {1: "<$1>The</\\>  <$1>&lt;Tender&gt;,</\\>\r\n<$1>ΟΔΟΣ</\\> \x0bend ", 2: None, 3: "", 4: " \n", 5: "<$1>كتاب‌ها</\\> <$1>کتَاب$1</\\>", 6: "x <$1>tend</\\>"}
    assert plan(marked).count("translate(") == 1


def test_quality_counts_words_in_one_pass(spark):
    rows = [(1, "قراردادAbc and 12 ۱۲3 café, a1 _ Ⅷ of IT it x 1234_567"), (2, None), (3, " \n")]
    df = T.with_quality(spark.createDataFrame(rows, "id int, t string"), "t", "q")
    assert "lambda" not in plan(df)
    assert [(r.q.score, r.q.bad, r.q.words, r.q.fa) for r in df.orderBy("id").collect()] == [(0.328, 0.2, 10, 0.1), (0.0, 0.0, 0, 0.0), (0.0, 0.0, 0, 0.0)]
    assert T.text_counts("قراردادAbc and 12 ۱۲3 café, a1 _ Ⅷ of IT it x 1234_567")[:4] == [14, 4, 1, 1]


def test_summary_takes_no_windows(spark):
    from ledgerloom.plans import retrieval

    text = "The contractor shall finish the northern retaining wall before winter. " * 2 + "The employer pays the contractor for the finished wall after approval. The weather of the region was mild and dry this year."
    found = retrieval.summary(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), 2)
    assert "Window" not in plan(found)
    assert [(r.doc_id, r.pos) for r in found.orderBy("pos").collect()] == [(1, 0), (1, 1)]


def test_a_surplus_is_counted_in_one_shuffle(spark):
    from ledgerloom.operators import sets

    new = spark.createDataFrame([(1, None), (1, None), (1, "x"), (2, "y"), (2, "y"), (2, "y"), (3, "z")], "k int, v string")
    stored = spark.createDataFrame([(1, None), (2, "y"), (3, "z"), (3, "z"), (9, "q")], "k int, v string")
    found = sets.surplus(new, stored, ["k", "v"])
    assert {(r.k, r.v): r.n for r in found.collect()} == {(1, None): 1, (1, "x"): 1, (2, "y"): 2}
    assert "Join" not in plan(found) and "Window" not in plan(found)


@pytest.mark.parametrize("own", ["10000", "7000"])
def test_whole_texts_go_to_python_in_small_batches(spark, own):
    from ledgerloom import catalog

    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, own)
    catalog.Bound(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name)) == (500 if own == "10000" else 7000)
    spark.conf.set(name, before)


def test_streaks_go_by_day_first(spark):
    from ledgerloom.operators import running

    rows = [("a", d, i, r) for d, rs in enumerate(["WWL", "LL", "L", "LWL", "LWW", "W", "WLW", "WBW"]) for i, r in enumerate(rs)] + [("b", 0, 0, None), ("b", 1, 0, None), ("b", 1, 1, "W")]
    found = running.streaks(spark.createDataFrame(rows, "g string, day int, i int, r string"), ["g"], [F.col("day"), F.col("i")], "r")
    assert {(x.g, x.r): x.longest for x in found.collect()} == {("a", "W"): 4, ("a", "L"): 5, ("a", "B"): 1, ("b", None): 2, ("b", "W"): 1}
    windows = [line for line in plan(found).split("\n") if "Window [row_number" in line]
    assert windows and all("_at" in line for line in windows)


def test_the_deepest_fall_reads_its_events_twice(spark):
    from ledgerloom.operators import running

    rows = [(d, i, a, a if i == 0 else 0, i == 0) for d, day in enumerate([[100, 50, -30], [-20, -60], [500, 10, -200, 5], [0, -100]]) for i, a in enumerate(day)]
    df = spark.createDataFrame(rows, "day int, i int, amount long, transfer long, is_transfer boolean")
    by = [F.col("i")]
    line = running.running_total(running.running_total(df, "day", by, "amount", "balance"), "day", by, "transfer", "transfers")
    fall = running.deepest_fall(df, "day", by)
    assert fall.first().max_drawdown == running.drawdown(line, "day", by).first().max_drawdown > 0
    assert running.deepest_fall(df.limit(0), "day", by).first().max_drawdown == 0
    assert plan(fall).count("LogicalRDD") == 2
