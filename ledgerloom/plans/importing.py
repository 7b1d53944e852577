"""Bulk import: tables of texts become records by their header's words, and what the store has already is left out.

A table is a transactions table if its header has a date, an amount (or what comes in, or goes out) and a description; it is a notes
table if it has a description and one other column; other tables (sums by day or category) are skipped, so nothing counts twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerloom.functions import calendar
from ledgerloom.operators import sets

# The header words of each role, in order of claim; words of kinds; words of rows that sum up; words for nothing.
ROLES = {
    "date": ("تاریخ",),
    "income": ("دریافتی", "واریز", "بستانکار", "درآمد"),
    "expense": ("پرداختی", "برداشت", "بدهکار"),
    "amount": ("مبلغ", "قیمت", "هزینه"),
    "description": ("شرح", "بابت", "عنوان", "موضوع"),
    "category": ("دسته",),
    "kind": ("نوع",),
    "counterparty": ("طرف حساب", "طرف", "فروشنده", "گیرنده", "پرداخت به", "دریافت از"),
    "notes": ("توضیحات", "ملاحظات", "یادداشت"),
}
SPENT = "بازپرداخت|پرداخت|هزینه|خرید|برداشت|قسط"
EARNED = "دریافت|درآمد|واریز|تأمین|تامین|قرض|وام|فروش"
SUM_ROW = r"^(?:جمع|مجموع)(?![\p{L}\p{N}_])"
NOTHING = ("", "-", "—", "نامشخص", "none", "null")
TOMAN, RIAL = "تومان", "ریال"
DAY = r"(1[34]\d\d)\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{1,2})"
KEY = ["tx_date", "kind", "amount", "description"]


def roles(header: list[str]) -> dict[str, str]:
    """role -> column. A word claims the first column with a word that begins with it, unless another role has that column."""
    out: dict[str, str] = {}
    for role, words in ROLES.items():
        for word in words:
            first = next((h for h in header if f" {word}" in f" {h}"), None)
            if first is not None and first not in out.values():
                out[role] = first
                break
    return out


def table_kind(header: list[str]) -> str:
    """transactions, notes or skipped, by the roles of a header."""
    at = roles(header)
    if "date" in at and "description" in at and at.keys() & {"amount", "income", "expense"}:
        return "transactions"
    named = [h for h in header if h]
    return "notes" if "description" in at and not at.keys() & {"date", "amount"} and len(named) >= 2 else "skipped"


def find_header(rows: list[list[str]]) -> tuple[int, str]:
    """Of a table's first six rows the one that is the header, and the table's kind; a transactions header goes first."""
    kinds = [table_kind(r) for r in rows[:6]]
    for kind, at in (("transactions", 0), ("notes", -1)):
        found = [i for i, k in enumerate(kinds) if k == kind]
        if found:
            return found[at], kind
    return -1, "skipped"


def unit_factor(header: str) -> float:
    """To rial: toman count ten times."""
    return 10.0 if TOMAN in header else 1.0


def squeezed(column: str) -> Column:
    """A cell as text with single blanks; null if there's nothing in it."""
    return F.nullif(F.trim(F.regexp_replace(F.col(f"`{column}`").cast("string"), r"\s+", " ")), F.lit(""))


def number(column: Column) -> Column:
    """The first number of a text."""
    plain = F.regexp_replace(calendar.fold_digits(column), "[٬،,]", "")
    return F.bround(F.nullif(F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double"), 0)


def read_rows(raw: DataFrame, title: str = "", keep: str | None = None) -> DataFrame:
    """Records (tx_date, kind, amount, category, counterparty, description, guessed) of a transactions table of texts.

    Rows that sum up, and those without a description or with no amount, are left out. A kind comes from the kind column's words,
    else from the table's title; a negative amount turns it over where there is no such column. A description takes in the columns
    of no role, the notes, and a date that can't be read whole. Rows without a date get the day before the earliest one: of all rows, or
    of those with the same value in the column `keep`, which goes on to the records.
    """
    at = roles([c for c in raw.columns if c != keep])
    others = [c for c in raw.columns if c and c != keep and c not in at.values()]
    own = [keep] if keep else []
    # cells, and then amounts and days, as lists of one: Spark copies no expression over a generator, so each is reckoned once
    cell = F.struct(*(squeezed(c).alias(role) for role, c in at.items()), *(squeezed(c).alias(f"_{i}") for i, c in enumerate(others)))
    cells = raw.select(*own, F.explode(F.array(cell)).alias("_cell"))
    get = lambda role: F.col(f"_cell.{role}") if role in at else F.lit(None).cast("string")
    default = "income" if any(w in title for w in ("دریافت", "درآمد", "واریز")) else "expense"
    text = F.coalesce(F.regexp_replace(get("kind"), "\u200c", " "), F.lit(""))
    said = F.when(text.rlike(SPENT), "expense").when(text.rlike(EARNED), "income").otherwise(default)
    if at.keys() & {"income", "expense"}:
        up, down = number(get("income")), number(get("expense"))
        earned = F.coalesce(up != 0, F.lit(False))
        value = F.when(earned, up * unit_factor(at.get("income", ""))).otherwise(down * unit_factor(at.get("expense", "")))
        said = F.when(earned, "income").otherwise("expense")
    else:
        value = number(get("amount")) * unit_factor(at["amount"])
    when = get("date")
    found = F.regexp_replace(F.regexp_extract(calendar.fold_digits(when), DAY, 0), r"\s*[/.-]\s*", "/")
    read = cells.select(*own, "_cell", F.explode(F.array(F.struct(value.alias("value"), said.alias("kind"), calendar.normalize_date(found).alias("day")))).alias("_read"))
    day, said, worth = F.col("_read.day"), F.col("_read.kind"), F.col("_read.value")
    if "kind" not in at:
        said = F.when(worth >= 0, said).otherwise(F.when(said == "income", "expense").otherwise("income"))
    extra = [F.when(~F.lower(F.col(f"_cell._{i}")).isin(*NOTHING), F.concat(F.lit(f"{c}: "), F.col(f"_cell._{i}"))) for i, c in enumerate(others)]
    unread = F.when(when.isNotNull() & (day.isNull() | when.rlike("[آ-ی]")), F.concat(F.lit("تاریخ در فایل: "), when))
    out = read.select(
        *own, day.alias("_day"), said.alias("kind"), F.bround(F.abs(worth)).cast("long").alias("amount"), F.coalesce(get("category"), get("kind")).alias("category"),
        get("counterparty").alias("counterparty"), get("description").alias("_first"), F.substring(F.concat_ws(" — ", get("description"), *extra, get("notes"), unread), 1, 500).alias("description"),
    ).filter(F.col("_first").isNotNull() & ~F.col("_first").rlike(SUM_ROW) & (F.col("amount") > 0))
    before = out.groupBy(*own).agg(calendar.jalali_text(F.date_sub(calendar.parse(F.min("_day")), 1)).alias("_before"))
    dated = out.join(before, keep) if keep else out.crossJoin(F.broadcast(before))  # one row without keep
    return dated.select(*own, F.coalesce("_day", "_before").alias("tx_date"), "kind", "amount", "category", "counterparty", "description", F.col("_day").isNull().alias("guessed"))


def read_notes(raw: DataFrame, keep: str | None = None) -> DataFrame:
    """title and content of a notes table: its description column, and the first other one with a name."""
    at = roles([c for c in raw.columns if c != keep])
    other = next((c for c in raw.columns if c and c != keep and c != at["description"]), None)
    content = F.coalesce(squeezed(other), F.lit("")) if other else F.lit("")
    return raw.select(*([keep] if keep else []), F.substring(squeezed(at["description"]), 1, 200).alias("title"), content.alias("content")).filter("title IS NOT NULL")


LAYOUT = StructType([StructField("head", IntegerType()), StructField("kind", StringType()), StructField("names", ArrayType(StringType()))])
#: Different headers of one import.
MOST_LAYOUTS = 500


@F.pandas_udf(LAYOUT)
def layout_of(first: pd.Series) -> pd.DataFrame:
    """Which of a file's first rows is its header, what kind of table it makes, and its names with single blanks and folded letters."""
    out, fold = [], str.maketrans("يىك", "ییک")
    for rows in first:
        plain = [[" ".join((c or "").split()).translate(fold) for c in r["cells"]] for r in rows]
        at, kind = find_header(plain)
        out.append((int(rows[at]["row"]), kind, plain[at]) if at >= 0 else (None, kind, None))
    return pd.DataFrame(out, columns=["head", "kind", "names"])


def layouts(cells: DataFrame, looked_at: int = 6) -> DataFrame:
    """path, head, kind and names of each file, from its first rows with anything in them. cells: path, row, cells."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("row"))
    first = cells.withColumn("_n", nth).filter(F.col("_n") <= looked_at).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("first"))
    return first.select("path", layout_of("first").alias("x")).select("path", "x.*")


def read_folder(cells: DataFrame, kind: str = "transactions") -> DataFrame:
    """The records (or, with kind "notes", the notes) of all files of that kind, with their path; see read_rows() and read_notes().

    Files may have different headers, of at most MOST_LAYOUTS kinds; those of one kind are read together. Titles and remarks above
    a header are left out, and so are columns without a name and later ones of the same name.
    """
    found = layouts(cells)
    own = cells.join(found.filter(F.col("kind") == kind), "path").filter("row > head")
    headers = [r.names for r in found.filter(F.col("kind") == kind).select("names").distinct().limit(MOST_LAYOUTS + 1).collect()]
    if len(headers) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers in one import")
    out = None
    for names in headers:
        places = {n: i for i, n in reversed(list(enumerate(names))) if n and n != "_path"}
        columns = sorted(places, key=places.get)
        same = own.filter(F.col("names") == F.array(*map(F.lit, names)))
        raw = same.select(F.col("path").alias("_path"), *(F.get("cells", places[n]).alias(n) for n in columns))
        part = read_rows(raw, keep="_path") if kind == "transactions" else read_notes(raw, keep="_path")
        out = part if out is None else out.unionByName(part)
    if out is None:
        some = cells.limit(0).select(F.col("path").alias("_path"), *(F.lit("").alias(n) for n in ("تاریخ", "شرح", "مبلغ")))
        out = read_rows(some, keep="_path") if kind == "transactions" else read_notes(some, keep="_path")
    return out.withColumnRenamed("_path", "path")


def new_notes(notes: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes whose title the store doesn't have; those of one title within the file all stay."""
    return notes.join(stored.select("title").distinct(), "title", "left_anti")


def new_rows(file: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a file that the store doesn't absorb, as a multiset."""
    return sets.bag_difference(file, stored, KEY, [F.col("id")] if "id" in file.columns else [F.lit(0)])


def new_counts(file: DataFrame, stored: DataFrame) -> DataFrame:
    """KEY and n: how many of new_rows() have that key."""
    return sets.surplus(file, stored, KEY)


def preview(rows: DataFrame) -> DataFrame:
    """Totals by kind and, of expenses, category, with the span of dates."""
    return rows.groupBy("kind", F.when(F.col("kind") == "expense", F.col("category")).alias("category")).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.min("tx_date").cast("string").alias("first_day"), F.max("tx_date").cast("string").alias("last_day"))
