"""Writing records: reading of loose payloads, patches, new ids, what follows from a change, labels, look-up by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import EntitySpec
from ledgerloom.functions import numbers, text

# What the states of a task and its priorities are called.
TASK_LABELS = {"todo": "انجام‌نشده", "doing": "در حال انجام", "waiting": "منتظر دیگران", "done": "انجام‌شده", "cancelled": "لغو‌شده"}
PRIORITY_LABELS = {"urgent": "فوری", "high": "زیاد", "medium": "متوسط", "low": "کم"}


def get(df: DataFrame, key: int) -> Row:
    """The record of an id; LookupError without one."""
    found = df.filter(F.col("id") == key).head()
    if found is None:
        raise LookupError(f"no record {key}")
    return found


def label_of(column: Column, labels: dict[str, str]) -> Column:
    """What a choice is called; a value without a label stands for itself."""
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, column), column)


def read_payload(df: DataFrame, entity: EntitySpec, payload: str = "payload", partial: bool = False) -> DataFrame:
    """df with a column of its type for each editable field of the entity, read from a map of texts, and the list of errors.

    Whole records get the fields' defaults. Of partial ones a field that isn't in the map is null as is one set to nothing;
    map_contains_key tells them apart. Errors: keys that are no field, values that don't fit, required fields without a value.
    """
    fields = [f for f in entity.fields if not f.system]
    m = F.coalesce(F.col(payload), F.create_map().cast("map<string,string>"))
    strange = F.array_sort(F.array_except(F.map_keys(m), F.array(*(F.lit(f.name) for f in fields))))
    found, values = [], {}
    for f in fields:
        given = numbers.blank_to_null(F.try_element_at(m, F.lit(f.name)))
        value = numbers.coerce(given, f)
        found.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"{f.name}: {f.kind}")))
        if f.required:
            missing = given.isNull() & F.map_contains_key(m, f.name) if partial else given.isNull()
            found.append(F.when(missing, F.lit(f"{f.name}: required")))
        values[f.name] = value if partial or f.default is None else F.coalesce(value, F.lit(f.default))
    wrong = F.concat(F.transform(strange, lambda x: F.concat(x, F.lit(": unknown"))), F.array_compact(F.array(*found)))
    return df.withColumns(values | {"errors": wrong})


def follow(entity: EntitySpec, old: dict[str, Column], new: dict[str, Column], given: dict[str, Column], now: Column) -> dict[str, Column]:
    """The values that follow from a change. An invoice's net amount is reckoned anew where it isn't given and its parts are; a task
    that gets done is completed now, one that gets any other state isn't; a new time of reminding is one not reminded of."""
    none, zero = F.lit(None), F.lit(0)
    asked = lambda name: given.get(name, F.lit(False))
    if entity.name == "invoices" and "net_amount" in new:
        parts = asked("gross_amount") | asked("deductions")
        reckoned = F.coalesce(new["gross_amount"], zero) - F.coalesce(new["deductions"], zero)
        stays = asked("net_amount") & new["net_amount"].isNotNull()
        return {"net_amount": F.when(~stays & parts, reckoned).otherwise(new["net_amount"])}
    out = {}
    if entity.name == "tasks" and "completed_at" in new:
        done = new["status"] == "done"
        out["completed_at"] = F.when(~asked("status"), old["completed_at"]).when(~done, none).when(old["status"].eqNullSafe("done"), old["completed_at"]).otherwise(now)
    if entity.name == "tasks" and "reminded" in new and "remind_at" in new:
        out["reminded"] = F.when(asked("remind_at") & ~new["remind_at"].eqNullSafe(old["remind_at"]), zero).otherwise(old["reminded"])
    return out


def update(stored: DataFrame, patches: DataFrame, entity: EntitySpec, now: str, payload: str = "payload") -> DataFrame:
    """Stored records with the patches (id and a map of texts) that have no error; at most one patch an id.

    A field set to nothing becomes null. Only fields that stored has are changed; those that follow from others change with them.
    """
    fields = [f.name for f in entity.fields if not f.system and f.name in stored.columns]
    read = read_payload(patches.select("id", payload), entity, payload, partial=True).filter(F.size("errors") == 0)
    p = read.select("id", F.struct(payload, *fields).alias("_p"))
    rows = stored.join(p, "id", "left")
    given = {f: F.coalesce(F.map_contains_key(F.col(f"_p.{payload}"), f), F.lit(False)) for f in fields}
    old = {c: F.col(c) for c in stored.columns}
    new = old | {f: F.when(given[f], F.col(f"_p.{f}").cast(stored.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    new |= follow(entity, old, new, given, F.lit(now))
    if "updated_at" in new:
        new["updated_at"] = F.when(F.col("_p").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    return rows.select(*(c.alias(name) for name, c in new.items()))


def insert(stored: DataFrame, new: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """New records with ids from the largest stored one on, without a gap.

    key is a whole number, unique among them. They are numbered within buckets of it; only the buckets' counts meet in one task.
    """
    rows = new.withColumn("_b", F.pmod(F.col(key), F.lit(buckets)))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", before.alias("_before"))
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))
    placed = rows.join(F.broadcast(starts), "_b").crossJoin(F.broadcast(last))  # buckets rows, one row
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return placed.withColumn("id", F.col("_last") + F.col("_before") + place).drop("_b", "_before", "_last")


def narrowed(df: DataFrame, columns: list[str], query: str = "", equal: dict[str, str] | None = None, but: tuple[str, ...] = ()) -> DataFrame:
    """Records as a list narrows them: equal values where they are set, no state in but, and the query, in normal form, anywhere in the columns."""
    for name, value in (equal or {}).items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    if but:
        df = df.filter(~F.coalesce(F.col("status").isin(*but), F.lit(False)))
    if query.strip():
        df = df.filter(text.normalize(F.concat_ws(" ", *columns)).contains(text.normalize(F.lit(query))))
    return df


def tail(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n records of each project in an order, with their place."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)
