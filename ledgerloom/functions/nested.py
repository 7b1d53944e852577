"""Nested values, and words for amounts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(columns: list[Column]) -> Column:
    """A record as JSON, without nulls and empty texts and lists."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def null_if_empty(column: Column, kind: str) -> Column:
    return F.nullif(column, F.lit("")) if kind == "string" else F.when(F.size(column) > 0, column)


def edits(before: Column, now: Column) -> Column:
    """The union of edited field names, sorted."""
    return F.array_sort(F.array_union(F.coalesce(before, F.array().cast("array<string>")), now))


def listed(text: Column, mark: str = "،") -> Column:
    """The values of a text that separates several by a mark."""
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def distinct_first(values: Column, n: int) -> Column:
    """Ordered distinct values, the first n."""
    return F.slice(F.array_distinct(values), 1, n)


# Units of large amounts.
UNITS = ((10**12, "هزار میلیارد"), (10**9, "میلیارد"), (10**6, "میلیون"))


def money_words(amount: Column) -> Column:
    """An amount in its largest unit, with at most 2 digits behind the point and no trailing zeros."""

    def short(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")

    plain = F.regexp_replace(F.format_number(amount, 0), ",", "٬")
    return reduce(lambda rest, u: F.when(F.abs(amount) >= u[0], F.concat_ws(" ", short(amount / F.lit(float(u[0]))), F.lit(u[1]))).otherwise(rest), reversed(UNITS), plain)


def joined(words: Column) -> Column:
    """Words joined by commas, the last by "and"."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), "، "), F.lit(" و "), F.element_at(words, -1)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is reckoned once for each row, however often and wherever it is used then: Spark copies no expression
    over a generator, into filters below it neither."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def through(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is reckoned once, as a list of one. Spark compiles what stands beside it in pieces: as part of a whole stage
    a long row of expressions becomes a method that is too long for the JVM to compile, and runs many times slower."""
    return F.get(F.transform(F.array(value), f), 0)
