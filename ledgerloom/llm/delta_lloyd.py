"""Clusters around centroids by Lloyd's rounds on integers, of which each compares and sums only what has changed.

Vectors become integers, so sums are exact and don't depend on how rows are dealt. Each vector keeps its owner, the centroid it
belongs to, and the distance to it. In a round, a vector whose owner has stayed where it was meets only the centroids that moved:
among the others nothing has changed, and its owner was the best of them. A vector whose owner moved meets all. The sums and counts of all
clusters are kept too: vectors that change their owner are subtracted from the old one's sums and added to the new one's.

Scale: the vectors are written as integers once and, with their assignments, once a round, by one map without a shuffle; the state
before goes. The rows that changed their owner are then read alone and summed in each task, to one row of `dim` sums for each
cluster; eight tasks add these up, and the driver the eight. It holds `k` centroids, sums and counts, whatever the input. The start
centroids are found by a top k of hashes, in two steps, so that vectors travel only for those that may win.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a
component of 2**19 or more (their squares don't fit in 64 bits); rows without vec_id are assigned like others and never start
centroids; rows that repeat a vec_id are vectors of their own, in the order of their components where they are start centroids; equal
distances go to the smaller number; with fewer than k vectors there are fewer centroids; where no vector has an id there is none, and no
row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Components, times the scale, below which squared distances of vectors fit in 64 bits.
MOST = 1 << 27
#: Products of components below this are exact in doubles, summed over 64 of them.
EXACT = 1 << 22
STATE = "vec_id long, x array<int>, was int, owner int, distance long"


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """The state before the first round: each valid vector as floor(scale * x), owned by nothing."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * rows_of(batch["embedding"], dim).astype(np.float64))  # null components are NaN here
            fits = (np.abs(x) < MOST).all(axis=1)
            ids, x = batch["vec_id"].filter(pa.array(fits)), x[fits].astype(np.int32)
            n = len(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), pa.array(x.ravel()))
            none = pa.array(np.full(n, -1, np.int32))
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "x": flat, "was": none, "owner": none, "distance": pa.array(np.zeros(n, np.int64))})

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).mapInArrow(run, STATE)


def first_centroids(state: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """Those of the k smallest hashes of `seed:vec_id`, as rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    keyed = state.filter("vec_id IS NOT NULL").select(key.alias("key"), "x")
    low = keyed.select("key").orderBy("key").limit(k).agg(F.max("key")).first()[0]
    found = keyed.filter(F.col("key") <= low).orderBy("key", "x").limit(k).collect() if low else []
    return np.array([r.x for r in found], np.int64).reshape(-1, dim)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exactly: through products of doubles where these are exact, else of integers."""
    dim = x.shape[1]
    most = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    if int(most) ** 2 * dim < 2**53 and most < EXACT:
        products = (x.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64)
    else:
        products = x @ centres.T
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * products


def assign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances it took: rows whose owner moved meet all, the others those that moved."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    a, b, some = np.flatnonzero(lost), np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(a):
        d = squared(x[a], centres)
        owner[a] = d.argmin(axis=1)
        distance[a] = d[np.arange(len(a)), owner[a]]
    if len(b) and len(some):
        d = squared(x[b], centres[some])
        best = d.argmin(axis=1)
        least, other = d[np.arange(len(b)), best], some[best]
        wins = (least < distance[b]) | (least == distance[b]) & (other < owner[b])
        owner[b[wins]], distance[b[wins]] = other[wins], least[wins]
    return owner, distance, len(a) * len(centres) + len(b) * len(some)


def round_of(state: DataFrame, centres: np.ndarray, moved: np.ndarray, path: str, block: int = 4096) -> DataFrame:
    """The state after each vector has been assigned anew, with `was`, the owner before."""
    dim = centres.shape[1]

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                was = batch["owner"].to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance, _ = assign(rows_of(batch["x"], dim).astype(np.int64), was, C.longs(batch["distance"]), centres, moved)
                yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "x": batch["x"], "was": batch["owner"], "owner": pa.array(owner, pa.int32()), "distance": pa.array(distance)})

    return C.store(state.mapInArrow(run, STATE), path)


def transfers(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the round moved: signed sums (k, dim) and counts (k) over the rows that changed their owner."""

    def out(sums: np.ndarray, counts: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(touched)
        return pa.RecordBatch.from_pydict({"cluster": pa.array(at, pa.int32()), "n": pa.array(counts[at]), "total": pa.array([sums[i].tobytes() for i in at], pa.binary())})

    @C.tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, touched = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
        for batch in batches:
            x = rows_of(batch["x"], dim).astype(np.int64)
            for column, sign in (("was", -1), ("owner", 1)):
                at = C.longs(batch[column])
                there = at >= 0
                np.add.at(sums, at[there], sign * x[there])
                np.add.at(counts, at[there], sign)
                touched[at[there]] = True
        yield out(sums, counts, touched)

    @C.tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, touched = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
        for batch in batches:
            for c, n, total in zip(*(batch[name].to_pylist() for name in ("cluster", "n", "total")), strict=True):
                sums[c] += np.frombuffer(total, np.int64)
                counts[c] += n
                touched[c] = True
        yield out(sums, counts, touched)

    schema = "cluster int, n long, total binary"
    moved = state.filter("was <> owner").select("was", "owner", "x").mapInArrow(partial, schema)
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in moved.repartition(8, "cluster", F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(merge, schema).collect():  # at most 8 * k rows
        sums[r.cluster] += np.frombuffer(r.total, np.int64)
        counts[r.cluster] += r.n
    return sums, counts


class Clusters(NamedTuple):
    """rows: vec_id, x, owner and distance. centres: (k, dim). counts: vectors of each."""

    rows: DataFrame
    centres: np.ndarray
    counts: np.ndarray


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> Clusters:
    """vectors: (vec_id, embedding). After `rounds` of assigning and moving, vectors are assigned once more."""
    path = C.workspace(vectors.sparkSession, "lloyd")
    state = C.store(integers(vectors, dim, scale), f"{path}/0")
    centres = first_centroids(state, k, dim, seed)
    k = len(centres)
    if not k:
        # no vector has an id: nothing to start from
        return Clusters(state.filter("owner >= 0"), centres, np.zeros(0, np.int64))
    sums, counts, moved = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.ones(k, bool)
    for r in range(1, rounds + 2):
        state = round_of(state, centres, moved, f"{path}/{r}")
        C.discard(f"{path}/{r - 1}")
        plus, more = transfers(state, k, dim)
        sums, counts = sums + plus, counts + more
        if r <= rounds:
            after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centres)
            moved, centres = (after != centres).any(axis=1), after
    return Clusters(state, centres, counts)


def described(found: Clusters) -> DataFrame:
    """Each vector with its cluster's inertia, that of all, and the digest of its centroid."""
    spark = found.rows.sparkSession
    inertia = {r.owner: r.s for r in found.rows.groupBy("owner").agg(F.sum("distance").alias("s")).collect()}  # at most k
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centres.tolist()]
    table = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows, a parameter
    return found.rows.select("vec_id", F.col("owner").alias("cluster"), "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return described(cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same in DuckDB's SQL, where every round compares everything."""
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k})",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(kept.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, r, x, c, d FROM (SELECT vec_id, r, kept.x, c, {d} AS d, row_number() OVER (PARTITION BY r ORDER BY {d}, c) AS k FROM kept, c{r} m) WHERE k = 1)")
        if r < rounds:
            out.append(f"s{r} AS MATERIALIZED (SELECT c, j, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({dim})) AS j FROM a{r}) GROUP BY c, j)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.x, m.x) AS x FROM c{r} m LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{r} GROUP BY c) n ON m.c = n.c)")
    return (
        f"WITH {', '.join(out)} SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"
    )


SQL = sql()
