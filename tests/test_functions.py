import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import CATALOG
from ledgerloom.functions import calendar, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("g", "j"), [("2024-03-20", "1403/01/01"), ("2025-03-20", "1403/12/30"), ("2025-03-21", "1404/01/01"), ("1979-02-11", "1357/11/22"), ("2000-01-01", "1378/10/11")])
def test_known_dates(spark, g, j):
    assert one(spark, calendar.jalali_text(F.to_date(F.lit(g)))) == j
    assert str(one(spark, calendar.parse(F.lit(j)))) == g


def test_calendar_round_trip(spark):
    days = spark.range(0, 20000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert days.filter(calendar.parse(calendar.jalali_text(F.col("d"))) != F.col("d")).count() == 0


def test_normalize_date(spark):
    cases = {"۱۴۰۳/۱/۵": "1403/01/05", "1403-12-30": "1403/12/30", "1403/13/01": None, "1403/07/31": None, "x": None, "": None}
    for raw, want in cases.items():
        assert one(spark, calendar.normalize_date(F.lit(raw))) == want


def test_month_end_and_add_months(spark):
    assert one(spark, calendar.month_end(F.lit(1403), F.lit(12))) == 30
    assert one(spark, calendar.month_end(F.lit(1404), F.lit(12))) == 29
    y, m, d = calendar.add_months(F.lit(1403), F.lit(6), F.lit(31), F.lit(1))
    assert tuple(spark.range(1).select(y, m, d).first()) == (1403, 7, 30)
    assert one(spark, F.weekday(F.to_date(F.lit("2024-03-20")))) == datetime.date(2024, 3, 20).weekday()


def test_times_and_periods(spark):
    for raw, want in {"۱۴۰۵/۰۷/۲۰ ۰۹:۱۵": "2026-10-12 09:15", "2026-10-01T7:05": "2026-10-01 07:05", "2026-10-01": "2026-10-01 00:00", "2026-13-01": None, "x": None}.items():
        assert one(spark, calendar.exchange_time(F.lit(raw))) == want
    assert one(spark, calendar.add_days(F.lit("1403/12/30"), F.lit(1))) == "1404/01/01" and one(spark, calendar.days_until(F.lit("1404/01/01"), F.lit("1403/12/29"))) == 2
    assert [one(spark, calendar.end_of(F.lit("1403/06/31"), F.lit(n), F.lit(u))) for n, u in ((1, "month"), (2, "year"), (2, "week"), (10, "day"))] == ["1403/07/30", "1405/06/31", "1403/07/14", "1403/07/10"]
    assert calendar.period("quarter", "1404/01/15") == ("1403/11/01", "1404/01/31") and calendar.period("all", "1404/01/15") == (None, None) and calendar.period("previous", "1404/01/15")[0] == "1403/12/01"
    assert one(spark, calendar.jalali_text(F.lit(None).cast("date"))) is None


@pytest.mark.parametrize(("raw", "want"), [("1,234", 1234), ("۱۲٬۳۴۵", 12345), ("2.5", 2), ("3.5", 4), ("12 %", 12), ("x", None), ("", None)])
def test_to_integer(spark, raw, want):
    assert one(spark, numbers.to_integer(F.lit(raw))) == want


def test_number_key(spark):
    assert one(spark, numbers.number_key(F.lit("ب/۰۰۱۲-45"))) == "12-45"
    assert one(spark, numbers.number_key(F.lit("7/8"))) is None


def test_errors(spark):
    raw = spark.createDataFrame([("1403/01/01", "income", "10", "a"), (None, "gift", "x", " ")], "tx_date string, kind string, amount string, description string")
    found = [r.e for r in raw.select(numbers.errors(CATALOG["transactions"], raw.columns).alias("e")).collect()]
    assert found == [[], ["tx_date: required", "kind: choice", "amount: money", "description: required"]]


def test_normal_form(spark):
    assert one(spark, text.normalize(F.lit("كتابِ ﻻزم‌ها  ABC، ۱۲"))) == "کتاب لازم ها abc 12"
    assert one(spark, text.stem(F.lit("کتابهای"))) == "کتاب"


def quality(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.quality for r in text.with_quality(rows, "t").orderBy("i").collect()]


def test_quality(spark):
    good = "این متن برای آن است که در هر جمله از واژه های رایج و با معنا استفاده شود و خوانا باشد"
    a, b, c, d, e, f = quality(spark, good, "ا ب پ ت 1۲ س ش", "", None, "روشEPC با وCG2 است", good[::-1])
    assert a.score > 0.9 > b.score and c.score == d.score == 0 and b.bad > 0
    assert e.bad == 0.167 and e.words == 6  # glued words are two, but loose ones are broken
    assert f.stop_rev > max(0.06, 2 * f.stop) and a.fa == 1.0


def test_quality_of_latin_text(spark):
    """The score by hand: 8 words, 2 of them short and no frequent words, 3 frequent; no symbols."""
    (q,) = quality(spark, "the results of gy measured yo and construction")
    en = (1 - min(1, (2 / 8 - 0.08) * 2.5)) * (0.55 + 0.45)
    assert q.score == round(1 - (1 - en), 3) and q.words == 8
    assert q.plausible == pytest.approx(1 - 1.2 * 2 / 8)


def test_direction(spark):
    good = "این متن برای آن است که در هر جمله از واژه های رایج و با معنا استفاده شود ABC 12"
    rows = spark.createDataFrame([(text_of,) for text_of in (good, text_turned(good))], "t string")
    assert [(r.t, r.turned) for r in text.fix_direction(rows, "t").collect()] == [(good, False), (good, True)]


def text_turned(line):
    import re

    return re.sub(r"[A-Za-z0-9]+", lambda m: m[0][::-1], line)[::-1]


def test_clean_display(spark):
    raw = "كتاب\u200f  يك \n\n\n\n  دو\t\tـ سه ۱ "
    assert one(spark, text.clean_display(F.lit(raw))) == text.displayed(raw) == "کتاب یک\n\nدو سه ۱"


def test_is_persian_and_terms(spark):
    assert one(spark, text.is_persian(F.lit("کتاب abc"))) and not one(spark, text.is_persian(F.lit("ک abc")))
    assert text.query_terms("مبلغ کتابهای قرارداد چقدر است کتاب x 7") == ["مبلغ", "کتاب", "قرارداد", "7"]


def test_chunks():
    rng = random.Random(3)
    sentence = lambda n: " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(n)) + "."
    whole = "\n".join(sentence(rng.randint(3, 40)) for _ in range(60)) + "\n\n" + " ".join(sentence(30) for _ in range(20)) + "\n\n" + "x" * 2000
    found = text.chunk(whole)
    assert all(len(c) <= 900 for c in found) and all(w in " ".join(found) for w in whole.split()[:-1])
    for a, b in zip(found, found[1:], strict=False):  # a chunk begins with the end of the one before, but for hard cuts
        assert "x" * 9 in b or a.endswith(b[:20]) or b[:20] in a[-151:]
    assert [len(c) for c in text.chunk("y" * 2000)] == [900, 900, 500]
    assert text.chunk("") == text.chunk("a") == text.chunk(" \n ") == [] and text.chunk("a b") == ["a b"]
    assert text.chunk("First line\nsecond line\n\nNext one.") == ["First line second line\nNext one."]


def test_pages():
    assert text.pages("") == [""] and text.pages("a\nb") == ["a\nb\n"]
    paragraphs = ["p" * 1000, "q" * 1999, "r" * 5000, "s"]
    assert text.pages("\n".join(paragraphs)) == ["p" * 1000 + "\n" + "q" * 1999 + "\n", "r" * 5000 + "\n", "s\n"]


def test_schema_carries_metadata():
    schema = CATALOG["invoices"].schema()
    assert schema["gross_amount"].metadata["required"] and schema["status"].metadata["default"] == "draft"
