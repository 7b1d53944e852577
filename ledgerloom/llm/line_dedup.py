"""Line deduplication with twin Bloom filters.

Scale: three scans of the texts, each a map, and one that only measures them to size the filters. What shuffles are the segments
of the Bloom filters (8 bits a key for each task, compressed) and the suspected repeats, as 16-byte digests with a doc_id; counting them combines before the shuffle, so a line that a third
of all documents hold costs each task one row. Keys confirmed as repeats go into a sorted table that workers map into memory.

Defined results: a null or empty text is one empty line; a row without doc_id is judged like the others but never holds the
line that stays (all such rows count as one document); rows that repeat a doc_id count as one document and keep the line
together; extra columns pass through untouched, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common as C

#: What is stripped from both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, the places of those with a key of at least min_chars code points, and these keys."""
    lines, at, keys = text.split(b"\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()  # bytes: only A-Z
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                keys.append(key)
    return lines, at, keys


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit digests, as two 64-bit numbers each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), C.U64).reshape(-1, 2)


def repeated_lines(docs: DataFrame, path: str, min_chars: int, min_docs: int) -> tuple[C.Twice, C.Table]:
    """The filter of suspected repeats, and the table of confirmed ones: digest -> second half of it, largest doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in C.binary(batch["text"]):
            if text and (keys := line_keys(text, min_chars)[2]):
                yield np.unique(digests(keys)[:, 0])

    # no more keys than lines, nor than min_chars bytes a key allow
    lines, least = F.regexp_count("text", F.lit("\n")) + 1, F.octet_length("text") / min_chars
    keys = texts.agg(F.sum(F.least(lines, F.ceil(least)))).first()[0] or 0
    twice = C.twice_seen(texts, keys_of, f"{path}/twice", C.filter_bits(int(keys)))

    @C.tidy
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [np.empty((0, 2), C.U64)], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), C.binary(batch["text"]), strict=True):
                if text and (keys := line_keys(text, min_chars)[2]):
                    own = np.unique(digests(keys), axis=0) if len(keys) > 1 else digests(keys)
                    own = own[twice.has(own[:, 0])]
                    found.append(own)
                    ids += [doc_id] * len(own)
            both = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_pydict({"h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1]), "doc_id": pa.array(ids, pa.int64())})

    rows = texts.mapInArrow(suspects, "h1 long, h2 long, doc_id long")
    counted = rows.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
    confirmed = counted.filter(F.col("n") >= min_docs).select("h1", "h2", F.coalesce("holder", F.lit(-(2**63))).alias("holder"))
    return twice, C.write_table(confirmed, f"{path}/lines")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the repeated lines taken out of ``text``, and the columns ``n_lines`` (before) and ``n_dropped``.

    A line whose key (stripped, A-Z lower-cased) has at least min_chars code points and is found in at least min_docs
    documents stays only in the largest doc_id that holds it.
    """
    path = C.workspace(docs.sparkSession, "lines")
    twice, table = repeated_lines(docs, path, min_chars, min_docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    i_id, i_text = names[where["doc_id"]], names[where["text"]]
    flat = docs.toDF(*names).withColumn(i_text, F.col(i_text).cast("string"))

    @C.tidy
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch[i_id].to_pylist(), C.binary(batch[i_text])
            parsed = [line_keys(t or b"", min_chars) for t in texts]
            hashes = [digests(keys) for _, _, keys in parsed]
            sizes = np.array([len(h) for h in hashes], np.int64)
            every = np.concatenate([np.empty((0, 2), C.U64), *hashes])
            drop = twice.has(every[:, 0])
            some = np.flatnonzero(drop)
            hit, (second, holder) = table.get(every[some, 0])
            own = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), sizes)[some]
            null = np.repeat(np.array([i is None for i in ids], bool), sizes)[some]
            drop[some] = hit & (second.view(C.U64) == every[some, 1]) & ((own != holder) | null)
            kept, dropped, start = [], [], 0
            for text, (lines, at, _), size in zip(texts, parsed, sizes.tolist(), strict=True):
                gone = {at[j] for j in np.flatnonzero(drop[start : start + size])}
                start += size
                kept.append(text if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                dropped.append(len(gone))
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == i_text else batch[c] for c in batch.schema.names]
            counts = [pa.array([len(x[0]) for x in parsed], pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + counts, names=[*batch.schema.names, "n_lines", "n_dropped"])

    schema = StructType([*(StructField(f.name, StringType() if f.name == i_text else f.dataType) for f in flat.schema), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return flat.mapInArrow(clean, schema).toDF(*docs.columns, *C.free_names(docs.columns, "n_lines", "n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Every row's line keys; a key's documents are counted once each.
SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \\t\\n\\x0B\\x0C\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\\n'), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND r.holder <> l.doc_id AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
