"""Benchmark decontamination: a hash set of normalised benchmark n-grams against the windows of all training tokens.

A window is known by a 64-bit hash of the 64-bit hashes of its words; a hit is verified word by word against the stored window.

Scale: one map over the documents, no shuffle. The benchmark's windows are cut and counted in Spark and written as sorted arrays
into the shared folder, with the items that hold each. The hash set itself is broadcast where its counted size is within
`broadcast_windows` (8 bytes each); of more windows, workers map the arrays from the folder, and a bit table says what to look up.

Defined results: a null or empty text has no words and no hits; benchmark rows without text, words or item_id take no part;
repeated benchmark rows count once; rows of documents are judged one by one, repeated or not; an empty benchmark hits nothing; an
empty table gives an empty table; extra columns pass through, and an own column whose name is taken gets a _ behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from . import common as C

#: Words: a-z, 0-9 and all beyond ASCII, after lower-casing A-Z; everything else separates.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class Windows:
    """The benchmark's windows in the shared folder; picklable, mapped by workers.

    A bucket has four files: sorted hashes, the words' hashes of each window, where each window's items begin, and the items.
    held: all hashes, where they are broadcast; lengths: the windows' lengths.
    """

    def __init__(self, path: str, bits: int, there: np.ndarray, lengths: list[int], held):
        self.path, self.bits, self.there, self.lengths, self.held, self.files = path, bits, there, lengths, held, {}

    def __getstate__(self):
        return self.path, self.bits, self.there, self.lengths, self.held

    def __setstate__(self, state):
        self.__init__(*state)

    def file(self, bucket: int) -> tuple:
        if bucket not in self.files:
            self.files[bucket] = tuple(np.load(f"{self.path}/{bucket:05d}-{x}.npy", mmap_mode="r") for x in ("keys", "grams", "starts", "items"))
        return self.files[bucket]

    @cached_property
    def near(self) -> np.ndarray:
        """A flag for the first bits of each hash, to look up few others."""
        keys = [self.held.value] if self.held else (self.file(b)[0] for b in np.flatnonzero(self.there).tolist())
        flags = np.zeros(1 << NEAR, bool)
        for k in keys:
            flags[k >> C.U64(64 - NEAR)] = True
        return flags

    def hits(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Over the word hashes of many documents: for each length, where windows begin, and the items that hold each."""
        for size in self.lengths:
            if len(words) < size:
                continue
            found = keys_of(words, size)
            at = np.flatnonzero(self.near[found >> C.U64(64 - NEAR)])
            at = at[doc[at] == doc[at + size - 1]]
            if self.held and len(at):
                held = self.held.value
                at = at[held[np.minimum(np.searchsorted(held, found[at]), len(held) - 1)] == found[at]]
            at = at[np.argsort(found[at], kind="stable")]
            tops = (found[at] >> C.U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(at), np.int64)
            good, owners = [np.empty(0, np.int64)], []
            for a, b in C.runs(tops):
                if not self.there[tops[a]]:
                    continue
                keys, grams, starts, items = self.file(int(tops[a]))
                own = at[a:b]
                row = np.minimum(np.searchsorted(keys, found[own]), len(keys) - 1)
                same = (keys[row] == found[own]) & (words[own[:, None] + np.arange(size)] == grams[row, :size]).all(axis=1)
                good.append(own[same])
                owners += [items[starts[r] : starts[r + 1]] for r in row[same].tolist()]
            yield size, np.concatenate(good), owners


#: Bits of a hash that say whether it is looked up.
NEAR = 22


def keys_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of a length."""
    return C.mix(C.windows(words, size) ^ C.U64(size))


def windows_of(benchmark: DataFrame, n: int, broadcast_windows: int) -> Windows:
    """Cuts the items of a benchmark into windows, and writes them; none of it passes through the driver but a checked hash set."""
    spark = benchmark.sparkSession
    path = C.workspace(spark, "benchmark")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()

    @C.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), C.binary(batch["text"]), strict=True):
                words = C.word_hashes(words_of(text))
                size = min(n, len(words))
                if size:
                    keys = keys_of(words, size)
                    grams = np.zeros((len(keys), n), C.U64)
                    grams[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), size, np.int32)), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(np.full(len(keys), item))], names=["key", "size", "gram", "item_id"])

    made = C.store(items.mapInArrow(cut, "key long, size int, gram binary, item_id long").distinct(), f"{path}/cut")
    rows = made.count()
    bits = C.table_bits(spark, rows)

    def put(part: pa.Table) -> pa.Table:
        bucket, item = part["bucket"][0].as_py(), C.longs(part["item_id"].combine_chunks())
        key = C.longs(part["key"].combine_chunks()).view(C.U64)
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        data = part["gram"].to_pylist()
        grams = np.frombuffer(b"".join(data[i] for i in order[first].tolist()), C.U64).reshape(-1, n)
        for name, array in (("keys", key[first]), ("grams", grams), ("starts", np.r_[first, len(key)]), ("items", item)):
            C.save(array, f"{path}/{bucket:05d}-{name}.npy")
        return C.only(bucket)

    there = C.per_bucket(made.withColumn("bucket", C.bucket_of(F.col("key"), bits)), bits, put)
    held = None
    if rows <= broadcast_windows:
        keys = made.select("key").distinct().toArrow()["key"].combine_chunks()
        held = spark.sparkContext.broadcast(np.sort(C.longs(keys).view(C.U64))) if len(keys) else None
    return Windows(path, bits, there, [r.size for r in made.select("size").distinct().collect()], held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_windows: int = 10_000_000) -> DataFrame:
    """docs with ``n_words``, ``n_hit`` (words in any occurrence of a window), ``item_ids`` (sorted list of the items found) and
    ``spans`` (places of hit words, as first word and the one after the last).

    A window is n consecutive words of an item, or all words of a shorter one. Up to broadcast_windows windows of items the hash
    set is broadcast, at most 80 MB; of more, it is mapped from the shared folder.
    """
    shared = windows_of(benchmark, n, broadcast_windows)
    own = C.free_names(docs.columns, *OWN)
    names = [f"c{i}" for i in range(len(docs.columns))]
    i_text = names[docs.columns.index("text")]
    flat = docs.toDF(*names).withColumn(i_text, F.col(i_text).cast("string"))

    @C.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [C.word_hashes(words_of(text)) for text in C.binary(batch[i_text])]
            sizes = [len(p) for p in parts]
            ids = np.concatenate([np.empty(0, C.U64), *parts])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            edge, items = np.zeros(len(ids) + 1, np.int32), {}
            for size, at, owners in shared.hits(ids, doc):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                for d, found in zip(doc[at].tolist(), owners, strict=True):
                    items.setdefault(d, set()).update(found.tolist())
            hit = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(hit)]
            n_hit = total[starts[1:]] - total[starts[:-1]]
            spans: list[list[list[int]]] = [[] for _ in sizes]
            for d in items:
                cuts = np.flatnonzero(np.diff(np.r_[False, hit[starts[d] : starts[d + 1]], False]))
                spans[d] = cuts.reshape(-1, 2).tolist()
            out = [pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(i, ())) for i in range(len(sizes))], pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in more)])

    more = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(LongType())), StructField("spans", ArrayType(ArrayType(LongType())))]
    return flat.mapInArrow(scan, StructType([*flat.schema, *more])).toDF(*docs.columns, *own)


OWN = ("n_words", "n_hit", "item_ids", "spans")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The rule: at least a twentieth of a document's words are hit. The columns' names are those that decontaminate() gave them."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated."""
    n_words, n_hit, *_ = C.free_names(docs.columns, *OWN)
    return decontaminate(docs, benchmark, **options).filter(~contaminated(n_words, n_hit)).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i : i + least(13, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, size, i, w[i : i + size - 1] AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
