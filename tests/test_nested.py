import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import nested
from ledgerloom.plans import screenshots


@pytest.mark.parametrize(("n", "want"), [(1_500_000_000_000, "1.5 هزار میلیارد"), (2_000_000_000, "2 میلیارد"), (1_250_000, "1.25 میلیون"), (12_345, "12٬345"), (0, "0")])
def test_money_words(spark, n, want):
    assert spark.range(1).select(nested.money_words(F.lit(n).cast("long")).alias("x")).first().x == want


def test_lists(spark):
    row = spark.range(1).select(nested.joined(F.array(*map(F.lit, "abc"))).alias("a"), nested.joined(F.array(F.lit("a"))).alias("b"), nested.listed(F.lit(" x ، y،،")).alias("c"), nested.edits(F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("a"))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("a، b و c", "a", ["x", "y"], ["a", "b"])


def test_screenshot(spark):
    texts = [
        "BTC/USDT Perp Long 10x\nEntry Price\n60,000.5\nSize: 0.2\nStop Loss 59000\nFee ۱٫۵",
        "BTCUSDT Perpetual\nLong 20x Cross\nEntry Price 62,150.5\nMark Price 62,400.1\nMargin\n150.25 USDT\nSize 0.048\nTP/SL\nStop Loss 61,500\nTake Profit 64,000\n2026-10-11 21:34:05",
        "Realized PnL\n-12.35 USDT\nMargin Ratio 3.5%",
        None,
    ]
    a, b, c, d = (r.trade for r in screenshots.parse(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect())
    assert (a.symbol, a.side, a.leverage, a.entry_price, a.qty, a.sl, a.fee, a.margin) == ("BTCUSDT", "long", 10, 60000.5, 0.2, 59000, 1.5, 1200.01)
    assert (b.symbol, b.side, b.leverage, b.entry_type) == ("BTCUSDT", "long", 20, "futures")
    assert (b.entry_price, b.margin, b.qty, b.sl, b.tp, b.opened_at, b.pnl) == (62150.5, 150.25, 0.048, 61500, 64000, "2026-10-11 21:34", None)
    assert (c.pnl, c.margin, c.symbol) == (-12.35, None, None) and d.symbol is None and d.margin is None
