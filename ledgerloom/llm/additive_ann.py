"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length 1, is coded as a sum of one full-dimensional codeword from each codebook. Codebooks start as those of
residual k-means and are then fitted together by least squares, with codes found by beam search. For each code the squared norm
of its sum is stored, so that a look-up table of a query's products with all codewords gives its distance from every code by a
few additions. The codes' order picks what is compared exactly first; the rest of the shortlist is every vector that its code
doesn't rule out: a query's product with a vector differs from that with its code by the length of what the code leaves out at
most, which is stored.

Scale: codebooks are fitted on at most `sample` vectors (those with the smallest hashes of their ids), in one task; every vector
is indexed, in one map. Queries go to the workers in blocks of a fixed size; each task keeps only the nearest found for each query
of the block, and these few rows meet in a window by query. The `rerank` best codes of a batch are compared first, and the n-th
best exact score so far decides which others have to be, ties included. So the result is that of brute force, however rows are
dealt to batches, in groups of near copies too, and whatever the codebooks were fitted on: good codes only save comparisons.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than most have, nor rows without vec_id; equal scores go by the smaller vec_id, and rows that repeat a vec_id appear once each;
an empty table or one without queries gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def valid(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (float64) of a batch's valid rows."""
    ids, vectors = [], []
    for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_numpy(zero_copy_only=False), strict=True):
        if i is None or v is None or not len(v) or dim and len(v) != dim:
            continue
        v = np.asarray(v, np.float64)
        if np.isfinite(v).all() and v.any():
            ids.append(i)
            vectors.append(v)
    return np.array(ids, np.int64), np.array(vectors, np.float64).reshape(len(ids), -1)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=-1))


class Index:
    """Codebooks: (books, words, dim), float32."""

    def __init__(self, books: np.ndarray, beam: int):
        self.books, self.beam = books, beam
        m, k, d = books.shape
        flat = books.reshape(m * k, d)
        self.gram = (flat @ flat.T).reshape(m, k, m, k)

        # bounds the rounding of float32 products and sums; 2**-23 is its step
        self.slack = 2.0**-22 * (d + m) * float(lengths(books.astype(np.float64)).max(axis=1).sum())

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes by beam search, the squared norms of their sums, and the lengths of what they leave out."""
        m, k, _ = self.books.shape
        n = len(x)
        codes, rest, cost = np.zeros((n, 1, 0), np.int64), x[:, None, :], np.zeros((n, 1))
        for b in range(m):
            book = self.books[b]
            gain = (book * book).sum(1) - 2 * (rest.reshape(-1, rest.shape[-1]) @ book.T).reshape(n, -1, k)
            total = (cost[:, :, None] + gain).reshape(n, -1)
            width = min(self.beam if b + 1 < m else 1, total.shape[1])
            best = np.argpartition(total, width - 1, axis=1)[:, :width]
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, best // k], (best % k)[:, :, None]], axis=2)
            rest = rest[row, best // k] - book[best % k]
            cost = total[row, best]
        codes = codes[:, 0]
        sums = self.books[np.arange(m), codes].sum(axis=1)
        return codes.astype(np.uint8), (sums * sums).sum(axis=1), lengths(x.astype(np.float64) - sums)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all codewords: (queries, books, words)."""
        return np.einsum("qd,mkd->qmk", q, self.books)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(x: np.ndarray, books: int = 16, words: int = 256, beam: int = 4, rounds: int = 1, seed: int = 5) -> Index:
    """Codebooks for vectors of length 1."""
    rng = np.random.default_rng(seed)
    rest, made = x.astype(np.float32), []
    for _ in range(books):
        made.append(kmeans(rest, words, rng))
        near = np.argmin((made[-1] * made[-1]).sum(1) - 2 * rest @ made[-1].T, axis=1)
        rest = rest - made[-1][near]
    index = Index(np.stack(made), beam)
    for _ in range(rounds):  # least squares over all codewords at once; unused ones stay where they are
        codes = np.concatenate([index.encode(x[a : a + 2000].astype(np.float32))[0] for a in range(0, len(x), 2000)]).astype(np.int64)
        at = codes + words * np.arange(books)
        gram, right = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(right, at[:, a], x.astype(np.float32))
            for b in range(books):
                both = np.bincount(codes[:, a] * words + codes[:, b], minlength=words * words)
                gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = both.reshape(words, words)
        gram[np.diag_indices_from(gram)] += 1.0
        start = index.books.reshape(-1, x.shape[1])
        index = Index((start + np.linalg.solve(gram, right - gram @ start)).reshape(books, words, -1), beam)
    return index


def top(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, of equal ones the first."""
    if n >= len(scores):
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    over = np.flatnonzero(scores > least)
    return np.r_[over, np.flatnonzero(scores == least)[: n - len(over)]]


def nearest(vectors: DataFrame, queries: DataFrame, n: int = 5, sample: int = 20_000, rerank: int = 40, block: int = 2048, **options) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the n nearest other rows of vectors by cosine.

    Both are (vec_id, embedding). sample bounds the vectors that codebooks are fitted on; rerank changes the speed alone.
    """
    spark = vectors.sparkSession
    path = C.workspace(spark, "ann")
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors, queries = plain(vectors), plain(queries)
    sizes = vectors.filter("embedding IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes.d if sizes else 1
    beam = options.get("beam", 4)

    @C.tidy
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.empty((0, dim)), *(valid(b, dim)[1] for b in batches)])
        if len(x):
            made = fit(x / lengths(x)[:, None], **options).books.astype(np.float32)
            yield pa.RecordBatch.from_pydict({"books": pa.array([made.tobytes()], pa.binary()), "count": pa.array([made.shape[0]], pa.int64()), "words": pa.array([made.shape[1]], pa.int64())})

    some = vectors.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    made = some.coalesce(1).mapInArrow(fitted, "books binary, count long, words long").first()
    index = spark.sparkContext.broadcast(Index(np.frombuffer(made.books, np.float32).reshape(made["count"], made.words, dim), beam) if made else None)

    @C.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = valid(batch, dim)
            codes, norms, left = [np.empty((0, 0), np.uint8)], [np.empty(0)], [np.empty(0)]
            for a in range(0, len(x), 2000):
                c, s, e = index.value.encode((x[a : a + 2000] / lengths(x[a : a + 2000])[:, None]).astype(np.float32))
                codes.append(c)
                norms.append(s)
                left.append(e)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids), "vector": pa.array([v.tobytes() for v in x], pa.binary()), "codes": pa.array([c.tobytes() for part in codes for c in part], pa.binary()), "norm": pa.array(np.concatenate(norms).astype(np.float32)), "left": pa.array(np.concatenate(left).astype(np.float32))})

    coded = C.store(vectors.mapInArrow(encode, "vec_id long, vector binary, codes binary, norm float, left float"), f"{path}/coded")

    def search(asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """asked: a broadcast of (ids, vectors) of a block's queries."""
        ids, q = asked.value
        size = lengths(q)
        tables = index.value.tables((q / size[:, None]).astype(np.float32))
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = C.longs(batch["vec_id"])
            order = np.argsort(vec, kind="stable")
            vec = vec[order]
            x = np.frombuffer(b"".join(batch["vector"].to_pylist())).reshape(len(vec), dim)[order]
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(len(vec), -1)[order].T.astype(np.intp)
            norm, own = batch["norm"].to_numpy()[order], lengths(x)
            reach = batch["left"].to_numpy()[order] + index.value.slack

            def compare(i: int, at: np.ndarray) -> None:
                exact = (x[at] * q[i]).sum(axis=1) / (own[at] * size[i])
                scores, found = np.r_[best[i][0], exact], np.r_[best[i][1], vec[at]]
                kept = np.lexsort((found, -scores))[:n]
                best[i] = scores[kept], found[kept]

            for i in range(len(ids)):
                product = np.zeros(len(vec), np.float32)
                for m, at in enumerate(codes):
                    product += tables[i, m][at]
                guess = 2 * product - norm
                guess[vec == ids[i]] = -np.inf
                at = top(guess, rerank)
                compare(i, at[vec[at] != ids[i]])
                open_ = product + reach >= (best[i][0][-1] if len(best[i][0]) == n else -np.inf)
                open_ &= vec != ids[i]
                open_[at] = False
                if len(at := np.flatnonzero(open_)):
                    compare(i, at)
        counts = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, counts)), "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *(f for _, f in best)])), "score": pa.array(np.concatenate([np.empty(0), *(s for s, _ in best)]))})

    @C.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = valid(batch, dim)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids), "vector": pa.array([v.tobytes() for v in x], pa.binary())})

    asked = C.store(queries.mapInArrow(cut, "vec_id long, vector binary"), f"{path}/queries")
    blocks = -(-asked.count() // block)
    found = None
    for b in range(blocks):
        rows = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = rows.distinct().collect()  # about `block` vectors
        held = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), np.array([np.frombuffer(r.vector) for r in rows]).reshape(-1, dim)))
        part = coded.mapInArrow(lambda batches, held=held: search(held, batches), "query_id long, vec_id long, score double")
        part = part if blocks == 1 else C.store(part, f"{path}/found-{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
