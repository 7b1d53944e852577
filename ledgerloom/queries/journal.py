"""The trading journal on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import nested, numbers
from ledgerloom.operators import running
from ledgerloom.plans import journal as J
from ledgerloom.queries.book import Book

BOOK = Book()

METRICS = """m AS (SELECT *, margin * leverage AS value, margin * leverage / entry_price AS qty, CASE WHEN side = 'short' THEN -1.0 ELSE 1.0 END AS s, nullif(sl, 0) AS stop FROM trades),
x AS (SELECT *, qty * pct1 / 100 * (price1 - entry_price) * s AS g1, coalesce(qty * pct2 / 100 * (price2 - entry_price) * s, 0) AS g2,
  qty * pct1 / 100 * price1 * entry_fee / 100 + value * (entry_fee / 100) * pct1 / 100 AS f1, coalesce(qty * pct2 / 100 * price2 * fee2 / 100 + value * (entry_fee / 100) * pct2 / 100, 0) AS f2 FROM m),
g AS (SELECT *, value * (abs(entry_price - stop) / entry_price) + value * (entry_fee / 100) AS risk, abs(tp - entry_price) / abs(entry_price - stop) AS planned_r,
  g1 + g2 AS gross, f1 + f2 AS fees, pct1 + coalesce(pct2, 0) AS closed_pct, coalesce(CASE WHEN pct2 IS NOT NULL THEN at2 END, at1) AS closed_at FROM x),
j AS (SELECT *, gross - fees AS net, (gross - fees) / risk AS actual_r, 100 * (gross - fees) / (margin * closed_pct / 100) AS gain_pct, CASE WHEN closed_pct >= 99.999 THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN closed_pct < 99.999 THEN NULL WHEN abs(gross) <= greatest(0.001 * margin, fees) AND abs(gross - fees) <= fees + 0.001 * margin THEN 'be' WHEN gross - fees > 0 THEN 'win' ELSE 'loss' END AS result FROM g)"""
EVENTS = """e AS (SELECT day, 0 AS rank, id AS ord, amount, amount AS transfer FROM transfers UNION ALL SELECT at1, 1, id, CAST(round((g1 - f1) * 100) AS BIGINT), 0 FROM j
  UNION ALL SELECT at2, 1, id, CAST(round((g2 - f2) * 100) AS BIGINT), 0 FROM j WHERE pct2 IS NOT NULL)"""
START, START_AT = 1000.0, "1995-06-01"


def journal(b):
    """Trades with one exit, with two, and half open ones."""
    t = b.entity("trades")
    leave = lambda i, fee: F.struct(F.col(f"price{i}").alias("price"), F.col(f"pct{i}").alias("pct"), fee.cast("double").alias("fee"), F.col(f"at{i}").alias("at"), F.col("exit_type").alias("type"))
    exits = F.filter(F.array(leave(1, F.lit(None)), leave(2, F.col("fee2"))), lambda e: e["pct"].isNotNull())
    return J.metrics(t.withColumn("exits", exits).drop("price1", "price2", "pct1", "pct2", "at1", "at2", "fee2"))


@BOOK.add("trade_metrics", f"""
WITH {METRICS} SELECT id, symbol, side, round(value, 4) AS value, round(qty, 6) AS qty, round(risk, 4) AS risk, round(planned_r, 4) AS planned_r, round(gross, 4) AS gross,
  round(fees, 4) AS fees, round(net, 4) AS net, round(actual_r, 4) AS actual_r, round(gain_pct, 4) AS gain_pct, status, result FROM j""", ("trades",))
def trade_metrics(b):
    r = lambda c, n=4: F.round(c, n).alias(c)
    return journal(b).select("id", "symbol", "side", r("value"), r("qty", 6), r("risk"), r("planned_r"), r("gross"), r("fees"), r("net"), r("actual_r"), r("gain_pct"), "status", "result")


def curve(b):
    """The day's last balance and transfers so far."""
    rows = J.events(journal(b), b.entity("transfers"))
    days = rows.groupBy("at").agg(F.sum("amount").alias("amount"), F.sum("transfer").alias("transfer"), F.count(F.lit(1)).alias("n"))
    return rows, days


@BOOK.add("equity_curve", f"""
WITH {METRICS}, {EVENTS}, d AS (SELECT day, sum(amount) AS a, sum(transfer) AS t, count(*) AS n FROM e GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, n, CAST(sum(a) OVER (ORDER BY day) AS BIGINT) AS balance, CAST(sum(t) OVER (ORDER BY day) AS BIGINT) AS transfers FROM d""", ("trades", "transfers"))
def equity_curve(b):
    _, days = curve(b)
    both = running.running_total(running.running_total(days, "at", [F.col("at")], "amount", "balance"), "at", [F.col("at")], "transfer", "transfers")
    return both.select(F.col("at").cast("string").alias("day"), "n", "balance", "transfers")


@BOOK.add("max_drawdown", f"""
WITH {METRICS}, {EVENTS}, c AS (SELECT day, rank, sum(amount) OVER w AS balance, sum(transfer) OVER w AS t, row_number() OVER w AS r FROM e WINDOW w AS (ORDER BY day, rank, ord, amount ROWS UNBOUNDED PRECEDING)),
p AS (SELECT balance, rank, t + max(CASE WHEN rank = 1 THEN balance - t END) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS peak FROM c)
SELECT round(coalesce(max(CASE WHEN peak > 0 AND rank = 1 THEN 100.0 * (CAST(peak AS DOUBLE) - CAST(balance AS DOUBLE)) / CAST(peak AS DOUBLE) END), 0.0), 6) AS max_drawdown FROM p""", ("trades", "transfers"))
def max_drawdown(b):
    rows, _ = curve(b)
    falls = running.deepest_fall(rows.withColumn("is_transfer", F.col("rank") == 0), "at", [F.col("rank"), F.col("ord"), F.col("amount")])
    return falls.select(F.round("max_drawdown", 6).alias("max_drawdown"))


@BOOK.add("streaks", f"""
WITH {METRICS}, c AS (SELECT * FROM j WHERE status = 'closed'), o AS (SELECT symbol, result, row_number() OVER (PARTITION BY symbol ORDER BY closed_at, id, net) - row_number() OVER (PARTITION BY symbol, result ORDER BY closed_at, id, net) AS run FROM c)
SELECT symbol, result, max(n) AS longest FROM (SELECT symbol, result, run, count(*) AS n FROM o GROUP BY ALL) GROUP BY symbol, result""", ("trades",))
def streaks(b):
    return running.streaks(journal(b).filter("status = 'closed'"), ["symbol"], [F.col("closed_at"), F.col("id"), F.col("net")], "result")


@BOOK.add("prior_balance_asof", f"""
WITH {METRICS}, {EVENTS}, d AS (SELECT day, sum(sum(amount)) OVER (ORDER BY day) AS balance FROM e GROUP BY day)
SELECT j.id, CAST(j.opened_at AS VARCHAR) AS opened_at, round(j.net, 4) AS net, CAST(coalesce(d.balance, 0) AS BIGINT) AS balance FROM j ASOF LEFT JOIN d ON j.opened_at >= d.day""", ("trades", "transfers"))
def prior_balance_asof(b):
    j = journal(b)
    rows = J.events(j, b.entity("transfers"))
    probes = j.select("id", F.col("opened_at").alias("at"), F.round("net", 4).alias("net"))
    return running.as_of(probes, rows, "at", "amount", "balance").select("id", F.col("at").cast("string").alias("opened_at"), "net", "balance")


def up(x: str, digits: int = 4) -> str:
    """Half up as the number reads in ten decimals: shares of a round balance are often half-way."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"


@BOOK.add("trade_balances", f"""
WITH {METRICS}, {EVENTS}, d AS (SELECT day, sum(sum(amount)) OVER (ORDER BY day) AS balance FROM e GROUP BY day),
p AS (SELECT j.*, CASE WHEN j.opened_at < DATE '{START_AT}' THEN {START} ELSE {START} + coalesce(d.balance, 0) / 100.0 END AS b FROM j ASOF LEFT JOIN d ON j.opened_at >= d.day)
SELECT id, {up('b', 2)} AS balance_before, {up('CASE WHEN b > 0 THEN 100 * margin / b END')} AS position_pct, {up('CASE WHEN b > 0 THEN 100 * risk / b END')} AS risked_pct,
  {up('CASE WHEN b > 0 THEN 100 * net / b END')} AS change_pct, {up("CASE WHEN status = 'closed' THEN b + net END", 2)} AS new_balance FROM p""", ("trades", "transfers"))
def trade_balances(b):
    j = journal(b)
    prior = running.as_of(j.withColumn("at", F.col("opened_at")), J.events(j, b.entity("transfers")), "at", "amount", "balance")
    out = J.with_balance(prior, START, F.to_date(F.lit(START_AT)))
    digits = {"balance_before": 2, "position_pct": 4, "risked_pct": 4, "change_pct": 4, "new_balance": 2}
    return out.select("id", *(numbers.half_up(F.col(c), n).alias(c) for c, n in digits.items()))


@BOOK.add("journal_return", f"""
WITH {METRICS}, t AS (SELECT coalesce(sum(amount) FILTER (amount > 0), 0) AS d, coalesce(-sum(amount) FILTER (amount < 0), 0) AS w FROM transfers)
SELECT CAST(d AS BIGINT) AS deposits, CAST(w AS BIGINT) AS withdrawals, round(100 * (SELECT sum(net) FROM j) / ({START} + d / 100.0), 6) AS return_pct FROM t""", ("trades", "transfers"))
def journal_return(b):
    return J.return_pct(journal(b), b.entity("transfers"), START)


@BOOK.add("trade_stats", f"""
WITH {METRICS}, c AS (SELECT * FROM j WHERE status = 'closed') SELECT (SELECT count(*) FROM j) AS n, count(*) AS closed, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses,
  count(*) FILTER (result = 'be') AS breakeven, round(100.0 * count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0), 4) AS win_rate, round((SELECT sum(net) FROM j), 2) AS realized,
  round(sum(net) FILTER (result = 'win') / -sum(net) FILTER (result = 'loss'), 6) AS profit_factor, round(avg(net) FILTER (result = 'win'), 4) AS avg_win, round(avg(net) FILTER (result = 'loss'), 4) AS avg_loss,
  round(avg(actual_r), 6) AS avg_r, round((SELECT sum(net) FROM j) / count(*), 4) AS expectancy, round((SELECT sum(fees) FROM j), 2) AS fees, round(avg(closed_at - opened_at), 4) AS avg_days,
  (SELECT id FROM c ORDER BY net DESC, id LIMIT 1) AS best_id, (SELECT id FROM c ORDER BY net, id LIMIT 1) AS worst_id FROM c""", ("trades",))
def trade_stats(b):
    return journal(b).agg(*J.stats())


DIMENSIONS = {"symbol": "symbol", "strategy": "strategy", "side": "side", "weekday": "CAST(isodow(opened_at) - 1 AS VARCHAR)", "month": "strftime(closed_at, '%Y-%m')", "exchange": "exchange", "mood": "mood", "exit": "exit_type"}
ROWS = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {k} AS key, result, net, actual_r FROM c" for n, k in DIMENSIONS.items())


@BOOK.add("trade_groups", f"""
WITH {METRICS}, c AS (SELECT * FROM j WHERE status = 'closed'), p AS ({ROWS} UNION ALL SELECT 'mistake', trim(unnest(string_split(mistake, '،'))), result, net, actual_r FROM c)
SELECT dimension, coalesce(key, '—') AS key, count(*) AS n, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses,
  round(100.0 * count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0), 4) AS win_rate, round(sum(net), 2) AS net, round(avg(actual_r), 6) AS avg_r FROM p GROUP BY ALL""", ("trades",))
def trade_groups(b):
    plain = {n: F.col(n) for n in ("symbol", "strategy", "side", "weekday", "exchange", "mood")}
    more = {"month": F.date_format("closed_at", "yyyy-MM"), "exit": F.try_element_at("exits", F.lit(-1))["type"], "mistake": nested.listed(F.col("mistake"))}
    return J.by_dimensions(journal(b), plain | more)


@BOOK.add("position_size", """
SELECT id, round(v, 4) AS value, round(tp2, 4) AS tp, round(v * abs(tp2 - entry_price) / entry_price - 2 * v * entry_fee / 100, 4) AS profit FROM
(SELECT *, 1000.0 * 2.0 / 100 / nullif(abs(entry_price - sl) / entry_price + 2 * entry_fee / 100, 0) AS v, entry_price + 3.0 * abs(entry_price - sl) AS tp2 FROM trades)""", ("trades",))
def position_size(b):
    t = b.entity("trades")
    parts = J.position_size(F.lit(1000.0), F.lit(2.0), F.col("entry_price"), F.col("sl"), F.col("entry_fee"), F.lit(3.0))
    return t.select("id", *(F.round(v, 4).alias(k) for k, v in parts.items()))
