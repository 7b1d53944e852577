"""The generic list query over an entity: filters, free text, date range, exclusions, order, limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import EntitySpec

def with_project_name(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Each record with its project's name, null where it has none."""
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return df.join(names, "project_id", "left")


def free_text(columns: tuple[str, ...], term: str) -> Column:
    """Any of the columns holds the term; % and _ stay wildcards, case is folded for ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = str.maketrans(upper, lower)
    pattern = f"%{term.translate(fold)}%".replace("\\", "\\\\")
    return reduce(lambda a, b: a | b, (F.coalesce(F.translate(F.col(c), upper, lower).like(pattern), F.lit(False)) for c in columns))


def rank_of(column: str, values: tuple[str, ...]) -> Column:
    """The place of a value in a list, after the list if it isn't there."""
    return reduce(lambda rest, x: F.when(F.col(column) == x[1], x[0]).otherwise(rest), reversed(list(enumerate(values))), F.lit(len(values)))


def order_of(entity: EntitySpec) -> list[Column]:
    out = []
    for column, how in entity.order:
        if isinstance(how, tuple):
            out.append(rank_of(column, how).asc())
        else:
            out.append(F.col(column).desc_nulls_last() if how else F.col(column).asc_nulls_last())
    return out


def clamp(limit: int) -> int:
    return max(1, min(limit, 1000))


def list_records(df: DataFrame, entity: EntitySpec, filters: dict | None = None, search: str | None = None, date_from=None, date_to=None, exclude_status: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Records that fit all conditions, in the entity's order. Empty filter values are ignored; a list means any of its values."""
    for name, value in (filters or {}).items():
        if name not in df.columns:
            raise ValueError(f"{entity.name} has no field {name}")
        if value is None or value == "":
            continue
        df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if search:
        df = df.filter(free_text(tuple(c for c in entity.search if c in df.columns), search))
    if date_from is not None:
        df = df.filter(F.col(entity.date) >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(F.col(entity.date) <= F.lit(date_to))
    if exclude_status:
        df = df.filter(~F.col("status").isin(*exclude_status))
    return df.orderBy(*order_of(entity)).limit(clamp(limit))


def delete(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Records without those whose id is in gone."""
    return df.join(gone.select("id"), "id", "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str = "project_id") -> DataFrame:
    """Children keep their rows; the key of those whose parent went is null."""
    marked = gone.select(F.col("id").alias(key), F.lit(True).alias("_gone")).distinct()
    return children.join(marked, key, "left").withColumn(key, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(key))).drop("_gone")


def upsert(df: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """df with the non-null values of patches over its own, and the patches' new keys added."""
    columns = [c for c in df.columns if c != key]
    right = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns if c in patches.columns))
    return df.join(right, key, "full_outer").select(key, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in patches.columns else F.col(c) for c in columns))


def last_wins(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the largest version."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("v")).select(key, *(F.col(f"v.{c}") for c in others))
