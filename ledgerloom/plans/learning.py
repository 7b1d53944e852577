"""Rules learned from corrections: what stood before a corrected value is its label, and finds it in other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_plain

# Marks and digits that are no part of a label, marks between the groups of a number, labels that say nothing by themselves.
UNLABELLED = r"""[\d۰-۹٠-٩:：.\-/|\\()«»"'،,؛*_]+"""
BETWEEN = r"\s*[/ا|\\\-.]\s*"
GENERIC = ("شماره", "تاریخ", "نامه", "سند", "به", "مورخ", "ش", "ت")
NUMBER = r"^[\s:.\n]*([0-9][\w/\-.]{0,24}(?:\s*/\s*[\w\-.]{1,12}){0,3})"
DATE = r"(\d{4}/\d{1,2}/\d{1,2})"


def label_words(text: Column) -> Column:
    """The words of a text that hold a letter, without marks and digits."""
    return F.filter(F.split(F.regexp_replace(text, UNLABELLED, " "), r"\s+"), lambda w: w.rlike("[آ-یa-zA-Z]"))


def value_pattern(field: Column, value: Column) -> Column:
    """A pattern that finds a number's groups in either order, or a date in either order; null where a number has under 3 digits."""
    groups = F.regexp_extract_all(value, F.lit(r"(\d+)"), 1)
    loose = F.transform(groups, lambda g: F.concat(F.lit("0*"), F.regexp_replace(g, "^0+(?=.)", "")))
    parts = F.when(field == "doc_date", loose).otherwise(groups)
    joined = F.concat(F.lit(r"(?<!\d)(?:"), F.array_join(parts, BETWEEN), F.lit("|"), F.array_join(F.reverse(parts), BETWEEN), F.lit(r")(?!\d)"))
    dated = value.rlike(r"^\d{4}/\d{2}/\d{2}$")
    return F.when(F.when(field == "doc_date", dated).otherwise(F.length(F.array_join(groups, "")) >= 3), joined)


def labels_of(edits: DataFrame, documents: DataFrame) -> DataFrame:
    """edits (doc_id, field, value, at) of documents (doc_id, text, category) with label: the last three words before the value's
    first place, on its line or, where that has none, on the line before. Edits whose value isn't in the text are left out."""
    rows = edits.join(documents.select("doc_id", "text", "category"), "doc_id").withColumn("_rx", value_pattern(F.col("field"), F.col("value")))
    rows = rows.filter("_rx IS NOT NULL").withColumn("_pos", F.regexp_instr("text", F.col("_rx"))).filter("_pos > 0")
    before = F.substring("text", F.lit(1), F.col("_pos") - 1)
    tail = lambda words: F.when(F.size(words) >= 3, F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3)).otherwise(words)
    line = F.regexp_extract(before, r"([^\n]*)$", 1)
    above = F.regexp_extract(before, r"([^\n]*)\n+[^\n]*$", 1)
    words = lambda x: tail(label_words(F.right(x, F.lit(40))))
    own = words(line)
    label = F.array_join(F.when(F.size(own) > 0, own).otherwise(words(above)), " ")
    return rows.withColumn("label", label).filter("label <> ''").select("doc_id", "field", "value", "at", "category", "label")


def heads(documents: DataFrame) -> DataFrame:
    """documents with head: the first six words of the first of their 15 top lines that has two words."""
    found = F.get(F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 15), label_words), lambda w: F.size(w) >= 2), 0)
    return documents.withColumn("head", F.array_join(F.slice(found, 1, 6), " "))


def rules(labelled: DataFrame, most: int = 60) -> DataFrame:
    """Rules (field, category, label, n, rank): how often a label was seen, the one seen last first; most of each field stay, as the
    list of rules is a short one by its nature."""
    seen = labelled.groupBy("field", "category", "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "doc_id")).alias("_last"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("_last"), "label", "category"))
    return seen.withColumn("rank", rank).filter(F.col("rank") <= most).drop("_last")


def generic(label: Column) -> Column:
    """Whether all words of a label are such as say nothing by themselves."""
    return F.size(F.array_except(F.split(label, " "), F.array(*map(F.lit, GENERIC)))) == 0


def apply(documents: DataFrame, rules_: DataFrame, head: int | None = 6000, known: DataFrame | None = None) -> DataFrame:
    """doc_id, field, value: what the first rule of a document's category finds behind its label within the document's head, or,
    with None, anywhere in it.

    documents: doc_id, text, category. Rules are at most 60 a field, and meet documents by category. known (doc_id, field, guessed): what
    was found without rules; a rule whose label is generic leaves that alone, unless it was guessed.
    """
    pattern = F.array_join(F.transform(F.split("label", " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"[\s‌]*")
    r = rules_.select("category", "field", "rank", generic(F.col("label")).alias("_generic"), F.concat(F.lit("(?s)"), pattern, F.lit("(.{0,60})")).alias("_rx"))
    rows = documents.select("doc_id", "category", (F.col("text") if head is None else F.substring("text", 1, head)).alias("_top")).join(r, "category")
    if known is not None:
        sure = known.filter(~F.coalesce("guessed", F.lit(False))).select("doc_id", "field").distinct().withColumn("_sure", F.lit(True))
        rows = rows.join(sure, ["doc_id", "field"], "left").filter("NOT (_generic AND coalesce(_sure, false))")
    rows = rows.select("doc_id", "field", "rank", F.posexplode(F.regexp_extract_all("_top", F.col("_rx"), 1)).alias("_n", "_after"))
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract("_after", NUMBER, 1), r"\s+", ""), r"^[/.\-]+|[/.\-]+$", "")
    numeric = (F.length(F.regexp_replace(number, r"\D", "")) >= 3) & ~number.rlike(f"^{DATE}$")
    dated = F.regexp_extract("_after", DATE, 1)
    value = F.when(F.col("field") == "doc_date", F.nullif(dated, F.lit(""))).otherwise(F.when(numeric, number))
    hits = rows.withColumn("value", value).filter("value IS NOT NULL")
    return hits.groupBy("doc_id", "field").agg(F.min(F.struct("rank", "_n", "value")).alias("b")).select("doc_id", "field", "b.value")


def category_rules(edits: DataFrame, documents: DataFrame, most: int = 60) -> DataFrame:
    """Rules (head, category) of corrected categories (doc_id, category, at): the one seen last for each head, in normal form."""
    seen = edits.select("doc_id", F.col("category").alias("given"), "at").join(heads(documents).select("doc_id", "head"), "doc_id").filter("head <> ''")
    key = normalize_plain(F.col("head"))
    last = seen.groupBy(key.alias("head")).agg(F.max(F.struct("at", "doc_id", "given")).alias("b"))
    return last.orderBy(F.desc("b")).limit(most).select("head", F.col("b.given").alias("category"))


def category_for(documents: DataFrame, rules_: DataFrame) -> DataFrame:
    """doc_id, category: of documents whose head a rule has."""
    own = heads(documents).select("doc_id", normalize_plain(F.col("head")).alias("head"))
    return own.join(rules_.select("head", "category"), "head").select("doc_id", "category")
