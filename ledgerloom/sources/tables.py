"""Delimited files, text files and exports."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.shipping import ship

#: Encodings tried in turn; UTF-16 where a file says so by its mark, for without one nearly any bytes can be read as it.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1256")


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        if name == "utf-16" and data[:2] not in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            continue
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return data.decode("utf-8", "replace")


def sniff(sample: str) -> str:
    """The delimiter of a sample: the one of , ; TAB that is most frequent in its first line with any."""
    line = next((x for x in sample.splitlines() if re.search("[,;\t]", x)), ",")
    return max(",;\t", key=line.count)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header as texts: encoding and delimiter from its first bytes, blank rows left out.

    UTF-8 files are read by Spark's own reader, split over tasks; others are decoded file by file.
    """
    ship(spark)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("h")).first()
    data = bytes(head.h) if head else b""
    try:
        data.decode("utf-8-sig")
        plain = True
    except UnicodeDecodeError as e:
        plain = e.start >= len(data) - 3 and len(data) >= 65000  # cut inside a character
    delimiter = sniff(decode(data))
    if plain:
        df = spark.read.csv(path, header=True, sep=delimiter, multiLine=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
        return df.na.drop("all")
    names = next(csv.reader(decode(data).splitlines(), delimiter=delimiter))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = list(csv.reader(decode(content).splitlines(), delimiter=delimiter))[1:]
                rows = [[x.strip() or None for x in (r + [""] * len(names))[: len(names)]] for r in rows]
                yield pd.DataFrame([r for r in rows if any(r)], columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))


def read_cells(spark: SparkSession, path: str, rows: int = 5000) -> DataFrame:
    """path, row (from 0) and cells of every row with anything in it, of all delimited files of a folder.

    Each file has an encoding and a delimiter of its own; quoted cells may hold delimiters and line feeds. A file is one row of Spark's
    binary source, so it is of at most 2 GB and read by one task, and comes from any store that Spark reads.
    """
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                text = decode(bytes(content))
                held: list[tuple[int, list[str]]] = []
                for i, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text[:65536]))):
                    if any(x.strip() for x in cells):
                        held.append((i, [x.strip() for x in cells]))
                    if len(held) == rows:
                        yield pd.DataFrame({"path": name, "row": [r for r, _ in held], "cells": [c for _, c in held]})
                        held = []
                if held:
                    yield pd.DataFrame({"path": name, "row": [r for r, _ in held], "cells": [c for _, c in held]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, decoded."""
    ship(spark)

    @F.pandas_udf("string")
    def as_text(data: pd.Series) -> pd.Series:
        return data.map(lambda x: decode(bytes(x)))

    return spark.read.format("binaryFile").load(path).select("path", as_text("content").alias("text"))


KINDS = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp"), "docx": ("docx",), "text": ("txt", "md", "csv")}


def kind_of(name):
    """A file's kind, by its extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def numbered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Writes a register: rows in order, numbered from 1. A small result, in one file, with the mark that spreadsheets look for."""
    rows = df.withColumn("row", F.row_number().over(Window.orderBy(*order)))
    first, *rest = ["row", *df.columns]
    rows.orderBy("row").select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").csv(path, header=True)


def export_json(tables: dict[str, DataFrame], folder: str) -> None:
    """Every entity whole, as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def add_documents(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new uploads: content (by sha256) that is there keeps its row, and takes the new project if it has none."""
    first = new.withColumn("sha", F.sha2("content", 256)).groupBy("sha").agg(F.min_by(F.struct("name", "project_id", "content"), "name").alias("n")).select("sha", "n.*")
    both = store.join(first.select("sha", F.col("name").alias("_name"), F.col("project_id").alias("_project"), F.col("content").alias("_content")), "sha", "full_outer")
    return both.select("sha", F.coalesce("name", "_name").alias("name"), F.coalesce("project_id", "_project").alias("project_id"), F.coalesce("content", "_content").alias("content"))
