"""Monthly reports, made from orders: three pages each, under one running head."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.plans import monthly
from ledgerloom.queries.book import Book

BOOK = Book()
WORKS = ("خاکریزی محور اصلی راه", "بتن ریزی پایه های پل", "اجرای لایه زیر اساس", "نصب علایم ایمنی کارگاه")
TROUBLES = ("کمبود قیر در کارگاه", "تاخیر در تحویل مصالح سنگی")
HEAD = "طرح ساختمان راه جنوب"


def pages(b):
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    text = lambda x: x.cast("string")
    code = F.concat(F.lit("CH-MR-"), F.lpad(text(n % 1000), 3, "0"))
    month, year = pick(calendar.MONTHS, n), text(1400 + key % 6)
    # a third of the reports name their code without a label, among another code that is rarer
    named = F.when(key % 3 == 0, F.concat(F.lit("کد AB-ZZ-9 و "), code, F.lit(" و "), code)).otherwise(F.concat(F.lit("نقشه AB-ZZ-9\nشماره گزارش: "), code))
    first = F.concat(F.lit(f"{HEAD}\nشروع کار مهر 1399 و ادامه مهر 1399\nگزارش منتهی به "), month, F.lit(" ماه "), year, F.lit("\n"), named)
    second = F.concat(F.lit(f"{HEAD}\nاقدامات انجام شده\nردیف شرح عملیات\n1 "), pick(WORKS, n), F.lit(" ادامه\n2 "), pick(WORKS, n + 1), F.lit("\n2 "), pick(WORKS, n + 1))
    third = F.concat(F.lit(f"{HEAD}\nمشکلات و موانع\n"), pick(TROUBLES, key), F.lit("\n"), text((n % 50 + 1) * 30), F.lit(" "), text(n % 50 + 1), F.lit(" جمع نفرات"))
    body = F.posexplode(F.array(first, second, third)).alias("page", "text")
    # a file of orders is small, and its texts are many times larger: orders are dealt before they become texts, and all that is found in
    # a document meets where it was found
    orders = b.table("orders").select("o_orderkey", "o_custkey").repartition(int(b.spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return orders.select(key.alias("doc_id"), body).withColumn("page", F.col("page") + 1)


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@BOOK.add("report_fields", f"""
WITH d AS (SELECT o_orderkey AS doc_id, o_custkey AS n, o_custkey % 12 + 1 AS m, 1400 + o_orderkey % 6 AS y, concat(({listed(WORKS)})[o_custkey % 4 + 1], ' (ادامه)') AS a, ({listed(WORKS)})[(o_custkey + 1) % 4 + 1] AS b, ({listed(TROUBLES)})[o_orderkey % 2 + 1] AS t FROM orders),
e AS (SELECT *, concat(({listed(calendar.MONTHS)})[m], ' ', CAST(y AS VARCHAR)) AS period, concat(CAST(y AS VARCHAR), '/', lpad(CAST(m AS VARCHAR), 2, '0'), '/', CASE WHEN m <= 6 THEN '31' WHEN m <= 11 OR y = 1403 THEN '30' ELSE '29' END) AS until FROM d)
SELECT doc_id, concat('CH-MR-', lpad(CAST(n % 1000 AS VARCHAR), 3, '0')) AS report_no, period, until AS doc_date, concat('گزارش ماهانه ', period) AS subject, (n % 50 + 1) * 30 AS man_days, n % 50 + 1 AS man_avg,
  concat('اقدامات این ماه: ', a, '؛ ', b, ' | مشکلات: ', t) AS points FROM e""")
def report_fields(b):
    return monthly.fields(pages(b)).select("doc_id", "report_no", "period", "doc_date", "subject", "man_days", "man_avg", F.array_join("points", " | ").alias("points"))
