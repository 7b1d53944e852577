"""Which of many keys a text holds, and the one project that a document names.

A key and a text are taken as words with one space between them and at both ends, so a key is held where its words follow each other.
Of each key the word that fewest texts have names the candidates: texts that have that word. Only ids of keys and texts meet there, by
that word; a key of one word is found by this alone, and longer ones are looked for in the texts of their candidates.

Scale: texts are cut into distinct words twice, once to count those that are words of keys and once to meet them. Keys are counted
first: up to FEW meet the texts where these are read, so no text is moved; more meet them by word and then by text, sorted on both
sides, for Spark takes cut texts for as small as their files and would send them to all tasks. A word that half of the texts have is no
key's rarest one unless the key has no other, and then each of its candidates is one row of two ids. No text is compared with a key it
shares no word with, and nothing is sent to all tasks that hasn't been counted.

Null and empty texts and keys hold and are nothing; equal keys are found alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.nested import once


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("w"))


#: So many keys are sent to all tasks.
FEW = 100_000


def held(texts: DataFrame, keys: DataFrame, few: int = FEW) -> DataFrame:
    """text_id and key_id of each text and each key that it holds, once. texts: text_id, t; keys: key_id, k; both in normal form."""
    known = keys.filter("k IS NOT NULL AND trim(k) <> ''").distinct()
    small = known.limit(few + 1).count() <= few
    sent = F.broadcast if small else lambda df: df.hint("merge")
    of_keys = known.select("key_id", "k", F.size(T.tokens(F.col("k"))).alias("n"), F.explode(F.array_distinct(T.tokens(F.col("k")))).alias("w"))
    asked = of_keys.select("w").distinct()
    found = words_of(texts.filter("t IS NOT NULL"), "text_id", "t")
    counts = found.join(sent(asked), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("texts"))
    # a key with a word that no text has is in none
    rare = of_keys.join(sent(counts), "w", "left").groupBy("key_id", "k").agg(F.max("n").alias("n"), F.max(F.col("texts").isNull()).alias("absent"), F.min_by("w", F.struct("texts", "w")).alias("w"))
    rare = rare.filter("NOT absent").select("key_id", "k", "n", "w")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    if small:
        cut = texts.filter("t IS NOT NULL").select("text_id", "t", F.explode(F.array_distinct(T.tokens(F.col("t")))).alias("w"))
        near = cut.join(sent(rare), "w")
    else:
        near = found.join(sent(rare), "w").select("text_id", "key_id", "k", "n").join(texts.hint("merge"), "text_id")
    return near.filter((F.col("n") == 1) | F.contains(padded("t"), padded("k"))).select("text_id", "key_id").distinct()


def match_projects(documents: DataFrame, projects: DataFrame, least: int = 4, least_code: int = 3) -> DataFrame:
    """doc_id and project_id of documents whose text names exactly one project, by name or code.

    documents: doc_id, text (whole texts). projects: id, name, code. Names and codes under `least` letters in normal form, and codes under
    least_code signs, name nothing.
    """
    plain = lambda df, key, c: once(df.select(key, T.normalize(F.col(c)).alias("_n")), "t", F.col("_n")).select(key, "t")
    names = projects.select(F.col("id").alias("key_id"), F.col("name").alias("k"))
    codes = projects.filter(F.length(F.trim("code")) >= least_code).select(F.col("id").alias("key_id"), F.col("code").alias("k"))
    # a project has up to two keys, so keys are numbered by project and kind
    both = plain(names, "key_id", "k").withColumn("kind", F.lit("n")).unionByName(plain(codes, "key_id", "k").withColumn("kind", F.lit("c")))
    keys = both.filter(F.length("t") >= least).select(F.struct("key_id", "kind").alias("key_id"), F.col("t").alias("k"))
    texts = plain(documents.select(F.col("doc_id").alias("text_id"), "text"), "text_id", "text")
    hits = held(texts, keys).select("text_id", F.col("key_id.key_id").alias("project_id")).distinct()
    one = hits.groupBy("text_id").agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).alias("n"))
    return one.filter("n = 1").select(F.col("text_id").alias("doc_id"), "project_id")
