"""The trading journal: metrics of each trade, an event-sourced balance, statistics.

A trade has margin, leverage, prices, fees and a list of exits {price, pct, fee, at}; everything about its exits is computed by
higher-order functions on that list.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_up(exits: Column, f) -> Column:
    return F.aggregate(exits, F.lit(0.0), lambda total, e: total + f(e))


def metrics(trades: DataFrame) -> DataFrame:
    """trades with value, qty, risk, planned_r, gross, fees, net, exit_nets, closed_pct, exit_price, actual_r, gain_pct, closed_at,
    weekday, status and result.

    exit_nets lists each exit's own net; weekday counts from Monday, 0. sl and tp of 0 count as missing; a stop at the entry price gives no risk; an exit's pct is 100 if missing or 0 and lies in
    0 to 100, its fee is the entry fee if missing. A closed trade breaks even if gross and net are within the fees and a
    thousandth of the margin.
    """
    c = F.col
    sign = F.when(c("side") == "short", -1.0).otherwise(1.0)
    sl, tp = F.nullif(c("sl"), F.lit(0.0)), F.nullif(c("tp"), F.lit(0.0))
    fee = F.coalesce(c("entry_fee"), F.lit(0.0)) / 100
    pct = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nullif(e["pct"], F.lit(0.0)), F.lit(100.0))))
    out = trades.withColumns({"value": c("margin") * c("leverage"), "_fee": fee, "_sign": sign})
    out = out.withColumn("qty", c("value") / c("entry_price"))
    distance = F.abs(c("entry_price") - sl) / c("entry_price")
    paid = lambda e: c("qty") * pct(e) / 100 * e["price"] * F.coalesce(e["fee"], c("entry_fee"), F.lit(0.0)) / 100 + c("value") * c("_fee") * pct(e) / 100
    won = lambda e: c("qty") * pct(e) / 100 * (e["price"] - c("entry_price")) * c("_sign")
    out = out.withColumns(
        {
            "risk": F.when(distance > 0, c("value") * distance + c("value") * c("_fee")),
            "planned_r": F.abs(tp - c("entry_price")) / F.nullif(F.abs(c("entry_price") - sl), F.lit(0.0)),
            "gross": add_up(c("exits"), won),
            "fees": add_up(c("exits"), paid),
            "exit_nets": F.transform("exits", lambda e: won(e) - paid(e)),
            "closed_at": F.array_max(F.transform("exits", lambda e: e["at"])),
            "weekday": F.weekday("opened_at") if "opened_at" in trades.columns else F.lit(None).cast("int"),
            "_pct": add_up(c("exits"), pct),
            "_weighted": add_up(c("exits"), lambda e: e["price"] * pct(e)),
        }
    )
    out = out.withColumns({"net": c("gross") - c("fees"), "closed_pct": F.least(F.lit(100.0), c("_pct"))})
    closed = c("closed_pct") >= 99.999
    even = (F.abs(c("gross")) <= F.greatest(0.001 * c("margin"), c("fees"))) & (F.abs(c("net")) <= c("fees") + 0.001 * c("margin"))
    return out.withColumns(
        {
            "exit_price": c("_weighted") / F.nullif(c("closed_pct"), F.lit(0.0)),
            "actual_r": c("net") / c("risk"),
            "gain_pct": 100 * c("net") / F.nullif(c("margin") * c("closed_pct") / 100, F.lit(0.0)),
            "status": F.when(closed, "closed").otherwise("open"),
            "result": F.when(closed, F.when(even, "be").when(c("net") > 0, "win").otherwise("loss")),
        }
    ).drop("_fee", "_sign", "_pct", "_weighted")


def events(journal: DataFrame, transfers: DataFrame) -> DataFrame:
    """Transfers and each exit's own net result, in whole cents: at, rank (transfers first), ord, amount, transfer."""
    t = transfers.select(F.col("day").alias("at"), F.lit(0).alias("rank"), F.col("id").alias("ord"), F.col("amount"), F.col("amount").alias("transfer"))
    leaves = journal.select(F.explode(F.arrays_zip(F.col("exits").alias("e"), F.col("exit_nets").alias("net"))).alias("x"), "id", "opened_at")
    x = leaves.select(F.coalesce(F.col("x.e.at"), F.col("opened_at")).alias("at"), F.lit(1).alias("rank"), F.col("id").alias("ord"), F.round(F.col("x.net") * 100).cast("long").alias("amount"), F.lit(0).cast("long").alias("transfer"))
    return t.unionByName(x)


def with_balance(journal: DataFrame, start: float, start_at) -> DataFrame:
    """journal with the balance before each trade, and its shares of it, and the balance after it once it is closed.

    Its column balance is the events' sum up to the trade's opening, in cents; trades opened before start_at have the start.
    """
    balance = F.when(F.col("opened_at") < start_at, F.lit(start)).otherwise(F.lit(start) + F.coalesce(F.col("balance"), F.lit(0)) / 100)
    out = journal.withColumn("balance_before", balance).drop("balance")
    known = lambda x: F.when(F.col("balance_before") > 0, 100 * x / F.col("balance_before"))
    exited = F.size("exits") > 0
    return out.withColumns(
        {
            "position_pct": known(F.col("margin")),
            "risked_pct": known(F.col("risk")),
            "change_pct": F.when(exited, known(F.col("net"))),
            "new_balance": F.when(F.col("status") == "closed", F.col("balance_before") + F.coalesce("net", F.lit(0.0))),
        }
    )


def stats(start: float = 0.0) -> list[Column]:
    """Aggregates of all trades of a journal: realized and fees over all, the others over closed ones.

    Ties of best and worst go to the smaller id. profit_factor is what wins made by what losses lost; null without a loss.
    """
    c = F.col
    closed = c("status") == "closed"
    wins, losses = closed & (c("result") == "win"), closed & (c("result") == "loss")
    net = F.when(closed, c("net"))
    realized, n = F.sum(F.coalesce("net", F.lit(0.0))), F.count_if(closed)
    pick = lambda f, sign: f(F.when(closed, c("id")), F.when(closed, F.struct("net", (sign * c("id")).alias("i"))))
    return [
        F.count(F.lit(1)).alias("n"),
        n.alias("closed"),
        F.count_if(wins).alias("wins"),
        F.count_if(losses).alias("losses"),
        (n - F.count_if(wins) - F.count_if(losses)).alias("breakeven"),
        F.round(100.0 * F.count_if(wins) / F.nullif(F.count_if(wins) + F.count_if(losses), F.lit(0)), 4).alias("win_rate"),
        F.round(realized, 2).alias("realized"),
        F.round(F.sum(F.when(wins, net)) / F.nullif(-F.sum(F.when(losses, net)), F.lit(0.0)), 6).alias("profit_factor"),
        F.round(F.avg(F.when(wins, net)), 4).alias("avg_win"),
        F.round(F.avg(F.when(losses, net)), 4).alias("avg_loss"),
        F.round(F.avg(F.when(closed, c("actual_r"))), 6).alias("avg_r"),
        F.round(realized / F.nullif(n, F.lit(0)), 4).alias("expectancy"),
        F.round(F.sum(F.coalesce("fees", F.lit(0.0))), 2).alias("fees"),
        F.round(F.avg(F.when(closed, F.datediff("closed_at", "opened_at"))), 4).alias("avg_days"),
        pick(F.max_by, -1).alias("best_id"),
        pick(F.min_by, 1).alias("worst_id"),
    ]


def money_in(transfers: DataFrame) -> DataFrame:
    """Sums of deposits and of withdrawals."""
    a, zero = F.col("amount"), F.lit(0)
    return transfers.agg(F.coalesce(F.sum(F.when(a > 0, a)), zero).alias("deposits"), F.coalesce(-F.sum(F.when(a < 0, a)), zero).alias("withdrawals"))


def return_pct(journal: DataFrame, transfers: DataFrame, start: float) -> DataFrame:
    """The realized result in percent of the start and all deposits; one row."""
    paid = money_in(transfers).withColumn("_base", F.lit(start) + F.col("deposits") / 100)
    made = journal.agg(F.coalesce(F.sum("net"), F.lit(0.0)).alias("_made"))
    return made.crossJoin(F.broadcast(paid)).select("deposits", "withdrawals", F.round(F.when(F.col("_base") > 0, 100 * F.col("_made") / F.col("_base")), 6).alias("return_pct"))  # one row each


def pair(dimension: Column, key: Column) -> Column:
    return F.struct(dimension.alias("dimension"), F.coalesce(key, F.lit("—")).alias("key"))


def by_dimensions(journal: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Statistics of closed trades by several dimensions at once: rows are expanded to (dimension, key) and summed in one shuffle.

    A dimension is a column, or an array of them: then a trade counts under each, and not at all if there's none. Null is "—".
    """
    schema = journal.select(*(k.alias(n) for n, k in dimensions.items())).schema
    pairs = []
    for n, k in dimensions.items():
        several = schema[n].dataType.typeName() == "array"
        keys = F.coalesce(k, F.array().cast("array<string>")) if several else F.array(F.coalesce(k.cast("string"), F.lit("—")))
        pairs.append(F.transform(keys, partial(pair, F.lit(n))))
    rows = journal.filter("status = 'closed'").select(F.explode(F.flatten(F.array(*pairs))).alias("p"), "result", "net", "actual_r").select("p.*", "result", "net", "actual_r")
    wins, losses = F.count_if(F.col("result") == "win"), F.count_if(F.col("result") == "loss")
    return rows.groupBy("dimension", "key").agg(
        F.count(F.lit(1)).alias("n"), wins.alias("wins"), losses.alias("losses"), F.round(100.0 * wins / F.nullif(wins + losses, F.lit(0)), 4).alias("win_rate"), F.round(F.sum("net"), 2).alias("net"), F.round(F.avg("actual_r"), 6).alias("avg_r")
    )


def position_size(balance: Column, risk_pct: Column, entry: Column, sl: Column, fee_pct: Column, reward: Column) -> dict[str, Column]:
    """Value, take-profit price and profit after fees of a trade that risks a share of the balance."""
    distance = F.abs(entry - sl) / entry
    value = balance * risk_pct / 100 / F.nullif(distance + 2 * fee_pct / 100, F.lit(0.0))
    side = F.when(sl < entry, 1.0).otherwise(-1.0)
    tp = entry + side * reward * F.abs(entry - sl)
    return {"value": value, "tp": tp, "profit": value * F.abs(tp - entry) / entry - 2 * value * fee_pct / 100}
