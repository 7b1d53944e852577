"""Fields of a trade from the text of a screenshot.

Each line is looked up for the phrases that name a field. The number behind a phrase is the field's value, or else the one that
the next line begins with; of several lines the first with a value counts. All of it is column expressions over the text's lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import calendar

# What exchanges call a field, the currencies that prices are in, and the words of the two sides. Phrases under "" look like
# others and name none.
PHRASES = {
    "entry_price": ("entry price", "avg entry price", "average entry price", "open price", "avg open price", "opening price", "filled price", "average price", "avg price", "avg. price", "قیمت ورود", "قیمت خرید", "قیمت میانگین", "میانگین قیمت"),
    "exit_price": ("exit price", "close price", "closing price", "avg close price", "avg exit price", "قیمت خروج", "قیمت فروش", "قیمت بستن"),
    "margin": ("margin", "initial margin", "مارجین", "وجه تضمین"),
    "qty": ("qty", "quantity", "size", "position size", "amount", "filled", "مقدار", "حجم"),
    "sl": ("stop loss", "stoploss", "sl", "حد ضرر"),
    "tp": ("take profit", "takeprofit", "tp", "حد سود"),
    "fee": ("fee", "fees", "trading fee", "trading fees", "کارمزد"),
    "pnl": ("pnl", "p&l", "realized pnl", "unrealized pnl", "realised pnl", "closed pnl", "profit", "سود و زیان", "سود/زیان"),
    "": ("margin ratio", "margin mode", "maintenance margin", "mark price", "liq. price", "liquidation price", "order size"),
}
QUOTES = ("USDT", "USDC", "BUSD", "FDUSD", "USD", "IRT", "TMN", "BTC", "ETH")
SIDES = {"short": ("short", "شورت", "فروش"), "long": ("long", "لانگ", "خرید")}

FIELDS = tuple(f for f in PHRASES if f)
OF_PHRASE = {p: f for f, phrases in PHRASES.items() for p in phrases}
#: Any phrase, the longest at a place first.
PHRASE = r"(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, sorted(OF_PHRASE, key=len, reverse=True))) + r")(?![\p{L}\p{N}])"
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"


def first_number(text: Column, shape: str = NUMBER) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(text, f"({shape})", 1), F.lit("")), ",", "").try_cast("double")


def parse(df: DataFrame, text: str, name: str = "trade") -> DataFrame:
    """df with a struct: symbol, side, entry_type, leverage, opened_at and FIELDS.

    A missing margin follows from price, quantity and leverage. A null or empty text has nulls.
    """
    plain = F.translate(calendar.fold_digits(F.coalesce(F.col(text), F.lit(""))), "٫٬", ".,")
    rows = df.withColumn("_plain", plain).withColumn("_lines", F.filter(F.transform(F.split(F.lower("_plain"), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    fields = F.create_map(*(F.lit(x) for pair in OF_PHRASE.items() for x in pair))

    def seen(line: Column, i: Column) -> Column:
        phrase = F.regexp_extract(line, PHRASE, 1)
        behind = F.regexp_replace(line, f"^.*?{PHRASE}", "")
        below = F.coalesce(F.get(F.col("_lines"), i + 1), F.lit(""))
        own = first_number(behind)
        return F.struct(fields[phrase].alias("field"), F.coalesce(own, F.when(below.rlike(r"^[-+$]?\s*\d"), first_number(below))).alias("value"))

    rows = rows.withColumn("_seen", F.filter(F.transform("_lines", seen), lambda x: x["value"].isNotNull()))
    value = lambda f: F.get(F.filter("_seen", lambda x: x["field"] == f), F.lit(0))["value"]
    pair = rf"(?<![A-Z0-9.])(?=\d*[A-Z])([A-Z0-9]{{2,12}}?)\s*[/-]?\s*({'|'.join(QUOTES)})(?![A-Z0-9])"
    base, quote = (F.regexp_extract(F.upper("_plain"), pair, i) for i in (1, 2))
    low = F.lower("_plain")
    says = lambda words: low.rlike(r"(?<![\p{L}])(?:" + "|".join(words) + r")(?![\p{L}])")
    times = F.coalesce(first_number(F.regexp_extract(low, r"(?<![\d.])(\d{1,3}(?:\.\d+)?)\s*x(?![a-z])", 1)), first_number(F.regexp_extract(low, r"(?:leverage|اهرم)\D{0,6}(\d{1,3})", 1)))
    side = F.when(says(SIDES["short"]), "short").when(says(SIDES["long"]), "long")
    when = F.nullif(F.regexp_extract("_plain", r"((?:20|1[34])\d\d[-/]\d{1,2}[-/]\d{1,2}[ T]+\d{1,2}:\d{2})", 1), F.lit(""))
    rows = rows.withColumns({f"_{f}": value(f) for f in FIELDS} | {"_times": times})
    margin = F.coalesce("_margin", F.round(F.col("_entry_price") * F.col("_qty") / F.coalesce(F.nullif("_times", F.lit(0.0)), F.lit(1.0)), 4))
    made = {
        "symbol": F.when(base != "", F.concat(base, F.when(quote == "USD", "USDT").otherwise(quote))),
        "side": side,
        "entry_type": F.when(times.isNotNull() | says(("perpetual", "perp", "futures", "cross", "isolated")), "futures"),
        "leverage": F.col("_times"),
        "opened_at": calendar.exchange_time(when),
        **{f: margin if f == "margin" else F.col(f"_{f}") for f in FIELDS},
    }
    return rows.withColumn(name, F.struct(*(v.alias(k) for k, v in made.items()))).select(*(x for x in df.columns if x != name), name)
