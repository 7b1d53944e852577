"""Quality classifier: random Fourier features of text statistics, ridge by summed normal equations, isotonic calibration.

Scale: one map over the texts gives a short vector for each document. The vectors of labelled rows meet their labels in a join
on doc_id; each partition sums its normal equations, eight tasks add these up, and the driver the eight (a fixed size). Calibration
uses counts by score bin, of scores that each row gets from the half of the labels it isn't in. The driver holds matrices of
features**2 and one list of bins, whatever the input. All labelled rows are used. accept() measures the texts twice, before the
fit and after it, instead of writing or shuffling them.

Defined results: a null or empty text has the statistics of an empty text and gets a score like any other; rows without doc_id
are scored but never learned from; repeated rows are scored alike; with no labelled row, or labels of one kind only, all
scores are that share (0.5 without labels); extra columns are ignored by score() and passed through by accept().
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS, UPPER, DIGIT, BLANK, VOWEL, POINT, SYMBOL = (np.array([f(c) for c in range(256)], bool) for f in (lambda c: chr(c).isalpha() and c < 128, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in b" \t\n\r", lambda c: c in b"aeiouAEIOU", lambda c: c in b".,;:?'\"()-", lambda c: 33 <= c <= 126 and not chr(c).isalnum() and c not in b".,;:?'\"()-"))
STATISTICS = 22


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a whole text."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words = max(1, len(text)), text.split()
    n = len(words)
    letters = max(1, int(counts[LETTERS].sum()))
    p = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = text.split(b"\n")
    tails = Counter(w[-1] for w in words)
    heads = Counter(w[0] for w in words)
    by_word = Counter(words)
    return [
        np.log1p(len(text)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        counts[UPPER].sum() / letters,
        counts[DIGIT].sum() / size,
        counts[POINT].sum() / size,
        np.sqrt(counts[SYMBOL].sum() / size),
        counts[128:].sum() / size,
        counts[BLANK].sum() / size,
        counts[VOWEL].sum() / letters,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        len(by_word) / max(1, n) ** 0.9,
        sum(map(operator.eq, words, words[1:])) / max(1, n),
        max(by_word.values(), default=0) / max(1, n),
        sum(c for w, c in by_word.items() if not any(x >= 128 or 48 <= x <= 57 or LETTERS[x] for x in w[:3])) / max(1, n),
        sum(c for x, c in tails.items() if SYMBOL[x]) / max(1, n),
        sum(c for x, c in heads.items() if UPPER[x]) / max(1, n),
        sum(c for x, c in tails.items() if x in b".!?") / max(1, n),
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in C.binary(batch["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "stats": pa.array(rows, pa.list_(pa.float64()))})

    C.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def remainder(column, n: int):
    """crc32 of an id as text, mod n."""
    return F.crc32(column.cast("string").cast("binary")) % n


class Model:
    """A fitted classifier, of a fixed size."""

    def __init__(self, centre, scale, features: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = centre, scale
        self.w, self.phase = rng.normal(0, 1 / bandwidth, (STATISTICS, features)), rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots, self.values, self.constant = None, None, None, None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -5, 5)
        return np.hstack([np.ones((len(x), 1)), x / 3, np.sqrt(2 / len(self.phase)) * np.cos(x @ self.w + self.phase)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a small share of the raw score keeps the order within a calibrated level. A constant stays as it is."""
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: the centre and level of each block."""
    blocks: list[list[float]] = []
    for a, s, c in zip(x.tolist(), sums.tolist(), counts.tolist(), strict=True):
        blocks.append([a * c, s, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


BINS, LOW, HIGH = 2000, -0.5, 1.5


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, bandwidth: float = 4.0, ridge: float = 1.0, seed: int = 7) -> Model:
    """Learns from all rows of stats (doc_id, stats) that have a label: labels is doc_id, y (0 or 1)."""
    columns = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    about = stats.agg(*columns).first()
    centre = np.array([about[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([(about[f"s{i}"] or 0.0) + 1e-6 for i in range(STATISTICS)])
    model = Model(centre, scale, features, bandwidth, seed)
    size = 1 + STATISTICS + features
    labelled = labels.select("doc_id", F.col("y").cast("double").alias("y")).filter("y IS NOT NULL")
    rows = stats.join(labelled, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))

    @C.tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            f, y = model.features(matrix(batch["stats"])), batch["y"].to_numpy(zero_copy_only=False)
            for half in (0, 1):
                own = batch["half"].to_numpy(zero_copy_only=False) == half
                total[half] += f[own].T @ np.hstack([f[own], y[own, None]])
        if total[:, 0, 0].any():
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    @C.tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(2 * size * (size + 1)), False
        for batch in batches:
            for x in batch["total"].to_pylist():
                total, some = total + np.frombuffer(x), True
        if some:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(sums, "total binary").repartition(8).mapInArrow(merge, "total binary").collect()
    halves = sum((np.frombuffer(r.total) for r in parts), np.zeros(2 * size * (size + 1))).reshape(2, size, size + 1)
    total = halves.sum(axis=0)
    n = total[0, 0]
    share = total[0, size] / n if n else 0.5
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 1e-6
    solved = lambda t: np.linalg.solve(t[:, :size] + penalty, t[:, size])
    model.weights = solved(total)
    if not n or not 0 < share < 1:
        model.constant = float(share)
        return model

    others = np.stack([solved(halves[1 - half]) for half in (0, 1)])

    @C.tidy
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (model.features(matrix(batch["stats"])) * others[batch["half"].to_numpy(zero_copy_only=False)]).sum(axis=1)
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at, pa.int32()), "y": batch["y"]})

    bins = sorted(rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s")).collect())
    model.knots, model.values = isotonic(np.array([LOW + (b.bin + 0.5) * (HIGH - LOW) / BINS for b in bins]), np.array([b.s for b in bins]), np.array([b.c for b in bins], float))
    return model


def training(labels: DataFrame):
    """Labels to learn from: those whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of stats."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(model.score(matrix(batch["stats"])))})

    return stats.mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs, learning from labels (doc_id, y)."""
    stats = C.store(featured(docs), C.workspace(docs.sparkSession, "quality") + "/stats")
    return scored(stats, fit(stats, labels, **options))


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score is at least this."""
    stats = C.store(featured(docs), C.workspace(docs.sparkSession, "quality") + "/stats")
    model = fit(stats, labels, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    i_text = names[docs.columns.index("text")]
    flat = docs.toDF(*names)

    @C.tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in C.binary(batch[i_text].cast(pa.string()))]).reshape(-1, STATISTICS)
            yield batch.filter(pa.array(model.score(stats) >= least))

    return flat.mapInArrow(keep, flat.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
