"""Import of a file made of all stored transactions, with repeated, changed, undated and summing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import importing as I
from ledgerloom.queries.book import Book

BOOK = Book()
#: The file's cells, in SQL that both run: the header's names are set by raw().
CELLS = """SELECT CASE WHEN id % 50 = 0 THEN 'نامشخص؛ ماه قبل' WHEN id % 50 = 1 THEN NULL ELSE concat('1400/', CAST(month(tx_date) AS VARCHAR(9)), '/', CAST(least(day(tx_date), 29) AS VARCHAR(9))) END AS a,
  CASE WHEN id % 31 = 0 THEN 'جمع کل ماه' WHEN id % 37 = 0 THEN '  ' ELSE description END AS b, CASE WHEN id % 41 = 0 THEN 'n/a' WHEN id % 7 = 0 THEN concat('-', CAST(amount AS VARCHAR(20))) ELSE CAST(amount AS VARCHAR(20)) END AS c,
  CASE WHEN id % 4 = 0 THEN 'هزینه' WHEN id % 4 = 1 THEN 'تأمین مالی دریافتی' WHEN id % 4 = 2 THEN 'بازپرداخت بدهی' END AS d, category AS e,
  CASE WHEN id % 5 = 0 THEN 'نامشخص' WHEN id % 5 = 1 THEN 'پراید' END AS f, CASE WHEN id % 6 = 0 THEN 'note  two' END AS g, id FROM transactions"""
READ = f"""c AS ({CELLS}), v AS (SELECT *, try_cast(c AS BIGINT) AS v, CASE WHEN a LIKE '1400/%' THEN format('1400/{{:02d}}/{{:02d}}', CAST(string_split(a, '/')[2] AS INT), CAST(string_split(a, '/')[3] AS INT)) END AS day FROM c),
k AS (SELECT *, CASE WHEN d IN ('هزینه', 'بازپرداخت بدهی') OR d IS NULL THEN 'expense' ELSE 'income' END AS kind FROM v WHERE v IS NOT NULL AND v <> 0 AND trim(b) <> '' AND b NOT LIKE 'جمع%'),
r AS (SELECT coalesce(day, CASE (SELECT min(day) FROM k) WHEN '1400/01/01' THEN '1399/12/30' END) AS tx_date, kind, abs(v) * 10 AS amount, coalesce(e, d) AS category,
  substr(concat_ws(' — ', b, CASE WHEN f = 'پراید' THEN 'خودرو: پراید' END, replace(g, '  ', ' '), CASE WHEN day IS NULL AND a IS NOT NULL THEN concat('تاریخ در فایل: ', a) END), 1, 500) AS description, day IS NULL AS guessed FROM k)"""


def raw(b):
    """The transactions as a file would hold them."""
    sql = CELLS.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING").replace("FROM transactions", "FROM {t}")
    return b.spark.sql(sql, t=b.entity("transactions")).drop("id").toDF("تاریخ", "شرح هزینه", "مبلغ (تومان)", "نوع", "دسته‌بندی", "خودرو", "توضیحات")


@BOOK.add("import_rows", f"WITH {READ} SELECT tx_date, kind, amount, category, description, guessed, count(*) AS n FROM r GROUP BY ALL", ("transactions",))
def import_rows(b):
    rows = I.read_rows(raw(b), "ریز هزینه‌ها")
    return rows.groupBy("tx_date", "kind", "amount", "category", "description", "guessed").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("import_preview", f"""
WITH {READ} SELECT kind, CASE WHEN kind = 'expense' THEN category END AS category, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, min(tx_date) AS first_day, max(tx_date) AS last_day FROM r GROUP BY 1, 2""", ("transactions",))
def import_preview(b):
    return I.preview(I.read_rows(raw(b), "ریز هزینه‌ها"))


FILE = "f AS (SELECT id, tx_date, kind, amount, description FROM transactions UNION ALL SELECT id, tx_date, kind, amount, description FROM transactions WHERE kind = 'expense' UNION ALL SELECT id + 1, tx_date, kind, amount + 1, description FROM transactions WHERE category IS NULL)"


@BOOK.add("import_dedup", f"""
WITH {FILE}, r AS (SELECT tx_date, kind, amount, description FROM f EXCEPT ALL SELECT tx_date, kind, amount, description FROM transactions)
SELECT CAST(tx_date AS VARCHAR) AS tx_date, kind, amount, description, count(*) AS n FROM r GROUP BY ALL""", ("transactions",))
def import_dedup(b):
    """All stored rows, the expenses a second time, and those without a category changed."""
    t = b.entity("transactions").select(*I.KEY, "category")
    row = lambda more: F.struct("tx_date", "kind", (F.col("amount") + more).alias("amount"), "description")
    copies = F.array(row(0), F.when(F.col("kind") == "expense", row(0)), F.when(F.col("category").isNull(), row(1)))
    file = t.select(F.explode(F.array_compact(copies)).alias("r")).select("r.*")
    return I.new_counts(file, t).select(F.col("tx_date").cast("string").alias("tx_date"), "kind", "amount", "description", "n")
