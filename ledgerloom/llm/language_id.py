"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Two recurrences, one from each end of a window of bytes, meet at each position in a softmax over the languages, so every byte has a
label of its own; a document's probabilities are the means over its bytes. Gates are straight lines cut at 0 and 1 and candidates
are cut at -1 and 1, instead of logistic curves and hyperbolic tangents: these cost no exponentials. A text is read as windows of WINDOW
bytes, each from rest, as in training; windows of many texts are one batch, longest first, so a long text is as well spread over it
as many short ones.

Scale: the network is fitted in one task, on at most about `per_language` rows of each of the `languages` most frequent languages
(those of the smallest hashes), of which `pieces` windows each are taken, so the sample is bounded by these parameters. Weights are
a few 10,000 numbers. All texts are then read in one map without a shuffle, and only ids and results leave it.

Defined results: `und` with score 0 where text is null or empty, has no letter (category L), or nothing was learned; rows without
doc_id are labelled and not learned from; repeated rows are labelled alike and learned from once; languages that are as likely go by
the smaller name; with one language learned all texts with a letter are in it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 128
UNKNOWN = "und"
#: Windows that go through the network together.
TOGETHER = 1024


class Direction:
    """One recurrence: byte -> gates (reset, update) and candidate, by tables, and hidden -> both, by matrices."""

    NAMES = ("gate_in", "new_in", "gate_own", "new_own")

    def __init__(self, gate_in: np.ndarray, new_in: np.ndarray, gate_own: np.ndarray, new_own: np.ndarray):
        self.gate_in, self.new_in, self.gate_own, self.new_own = gate_in, new_in, gate_own, new_own

    @classmethod
    def start(cls, hidden: int, rng: np.random.Generator) -> Direction:
        draw = lambda *size: rng.normal(0, 0.3, size).astype(np.float32)
        return cls(draw(256, 2 * hidden) + np.float32(0.5), draw(256, hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def run(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Hidden states (steps, rows, hidden) of byte columns x (steps, rows); only the first active[t] rows go on at step t."""
        steps, rows = x.shape
        n = self.new_own.shape[0]
        out = np.zeros((steps, rows, n), self.new_own.dtype)
        h, gate, into, new, told = (np.zeros((rows, w), self.new_own.dtype) for w in (n, 2 * n, 2 * n, n, n))
        for t in range(steps):
            if (a := int(active[t])) < len(h):
                h, gate, into, new, told = h[:a], gate[:a], into[:a], new[:a], told[:a]
            if not a:
                break
            at = x[t, :a]
            np.matmul(h, self.gate_own, out=gate)
            np.take(self.gate_in, at, axis=0, out=into, mode="clip")
            np.add(gate, into, out=gate)
            np.clip(gate, 0, 1, out=gate)
            np.matmul(h, self.new_own, out=new)
            np.multiply(new, gate[:, :n], out=new)
            np.take(self.new_in, at, axis=0, out=told, mode="clip")
            np.add(new, told, out=new)
            np.clip(new, -1, 1, out=new)
            np.subtract(new, h, out=new)
            np.multiply(new, gate[:, n:], out=new)
            np.add(h, new, out=out[t, :a])
            h = out[t, :a]
        return out

    def gradients(self, x: np.ndarray, states: np.ndarray, pulls: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parts, from those of all hidden states (steps, rows, hidden), back through time."""
        steps, rows = x.shape
        n = self.new_own.shape[0]
        grads = [np.zeros_like(p) for p in self.parts()]
        to_gate, to_new = np.zeros((steps, rows, 2 * n), pulls.dtype), np.zeros((steps, rows, n), pulls.dtype)
        dh = np.zeros((rows, n), pulls.dtype)
        for t in reversed(range(steps)):
            h = states[t - 1] if t else np.zeros((rows, n), pulls.dtype)
            raw = h @ self.gate_own + self.gate_in[x[t]]
            gate, inside = np.clip(raw, 0, 1), (raw > 0) & (raw < 1)
            own = h @ self.new_own
            drawn = self.new_in[x[t]] + gate[:, :n] * own
            new = np.clip(drawn, -1, 1)
            dh = dh + pulls[t]
            d_new = dh * gate[:, n:] * (np.abs(drawn) < 1)
            d_gate = np.hstack([d_new * own, dh * (new - h)]) * inside
            d_own = d_new * gate[:, :n]
            grads[2] += h.T @ d_gate
            grads[3] += h.T @ d_own
            to_gate[t], to_new[t] = d_gate, d_new
            dh = dh * (1 - gate[:, n:]) + d_own @ self.new_own.T + d_gate @ self.gate_own.T
        np.add.at(grads[0], x.ravel(), to_gate.reshape(-1, 2 * n))
        np.add.at(grads[1], x.ravel(), to_new.reshape(-1, n))
        return grads


class Windows:
    """Windows of texts as byte columns, forward and backward: (WINDOW, rows), longest first."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        steps = np.arange(int(lengths.max(initial=1)))[:, None]
        self.lengths, last = lengths, max(0, len(data) - 1)
        self.forward = data[np.minimum(starts + steps, last)].astype(np.intp)
        self.turned = lengths - 1 - steps  # step of the other direction at each position
        self.backward = data[np.clip(starts + self.turned, 0, last)].astype(np.intp)
        self.there = steps < lengths
        self.active = self.there.sum(axis=1)


class Network:
    def __init__(self, languages: list[str], directions: list[Direction], weights: list[np.ndarray], bias: np.ndarray):
        """weights: (hidden, languages) of each direction."""
        self.languages, self.directions, self.weights, self.bias = languages, directions, weights, bias

    @classmethod
    def start(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        both = [Direction.start(hidden, rng) for _ in range(2)]
        return cls(languages, both, [rng.normal(0, 0.3, (hidden, len(languages))).astype(np.float32) for _ in both], np.zeros(len(languages), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.directions[0].parts(), *self.directions[1].parts(), *self.weights, self.bias]

    def put(self, parts: list[np.ndarray]) -> None:
        self.directions = [Direction(*parts[:4]), Direction(*parts[4:8])]
        self.weights, self.bias = list(parts[8:10]), parts[10]

    def states(self, w: Windows) -> list[np.ndarray]:
        return [d.run(x, w.active) for d, x in zip(self.directions, (w.forward, w.backward), strict=True)]

    def likely(self, w: Windows, states: list[np.ndarray]) -> np.ndarray:
        """Probabilities (languages, steps, rows); meaningless beyond a window's end."""
        steps, rows = w.forward.shape
        ahead, back = ((m.T @ s.reshape(steps * rows, -1).T).reshape(-1, steps, rows) for m, s in zip(self.weights, states, strict=True))
        if (w.lengths == steps).all():
            back = back[:, ::-1]
        else:
            back = np.take_along_axis(back, np.maximum(w.turned, 0)[None], axis=1)
        told = np.exp(np.clip(ahead + back + self.bias[:, None, None], -30, 30))
        return told / told.sum(axis=0)

    def loss(self, w: Windows, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients. truth: a number of a language for each row."""
        states = self.states(w)
        p = self.likely(w, states)
        k, steps, rows = p.shape
        total = max(1, int(w.there.sum()))
        value = -float(np.log(np.maximum(p[truth, :, np.arange(rows)].T, 1e-30))[w.there].sum()) / total
        pull = p.copy()
        pull[truth, :, np.arange(rows)] -= 1
        pull = (pull * w.there / total).astype(p.dtype)
        turned = np.take_along_axis(pull, np.maximum(w.turned, 0)[None], axis=1) * w.there
        grads, heads = [], []
        for d, x, s, m, g in zip(self.directions, (w.forward, w.backward), states, self.weights, (pull, turned), strict=True):
            grads += d.gradients(x, s, np.moveaxis(g, 0, 2) @ m.T)
            heads.append(s.reshape(steps * rows, -1).T @ g.reshape(k, -1).T)
        return value, [*grads, *heads, pull.sum(axis=(1, 2))]

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For batches of windows of the texts data[offsets[i]:offsets[i + 1]]: their texts, starts, lengths and probabilities."""
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[:-1][text] + nth * WINDOW
        lengths = np.minimum(WINDOW, offsets[1:][text] - starts)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), TOGETHER):
            at = order[a : a + TOGETHER]
            w = Windows(data, starts[at], lengths[at])
            yield text[at], starts[at], lengths[at], self.likely(w, self.states(w)) * w.there

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (texts, languages); zeros for an empty text."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for text, _, _, p in self.positions(data, offsets):
            np.add.at(out, text, p.sum(axis=1).T)
        return out / np.maximum(1, np.diff(offsets))[:, None]


def train(texts: list[bytes], truth: np.ndarray, languages: list[str], hidden: int = 8, steps: int = 400, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam over batches that hold as many windows of each language. texts: at most WINDOW bytes each."""
    net, rng = Network.start(languages, hidden, seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    own = [np.flatnonzero(truth == k) for k in range(len(languages))]
    own = [o for o in own if len(o)]
    for step in range(1, steps + 1):
        rows = np.concatenate([o[rng.integers(0, len(o), -(-batch // len(own)))] for o in own])
        rows = np.array(sorted(rows.tolist(), key=lambda i: -len(texts[i])))
        lengths = np.array([len(texts[i]) for i in rows])
        w = Windows(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), np.cumsum(lengths) - lengths, lengths)
        _, grads = net.loss(w, truth[rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now, parts = rate * min(1.0, 2 * (1 - (step - 1) / steps)), []
        for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * g * g
            parts.append((p - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        net.put(parts)
    return net


def learned_rows(docs: DataFrame, languages: int, per_language: int, pieces: int) -> tuple[list[str], DataFrame]:
    """The languages, and rows (lang, piece, order) to learn from: windows of texts at places that follow the text's hash."""
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    # at most `languages` rows
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return [], rows.select("lang")
    parts = [(name, min(1.0, per_language / n)) for name, n in counts.items()]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(parts, "name string, part double"))
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    some = rows.withColumn("order", key).join(bounds, F.col("lang") == F.col("name")).filter(F.pmod(F.col("order"), F.lit(1 << 30)) < F.col("part") * F.lit(float(1 << 30)))

    @C.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text, order in zip(batch["lang"].to_pylist(), C.binary(batch["text"]), batch["order"].to_pylist(), strict=True):
                count = -(-len(text) // WINDOW)
                chosen = np.random.default_rng(order & 0xFFFFFFFF).permutation(count)[:pieces].tolist()
                out += [(lang, text[i * WINDOW : (i + 1) * WINDOW], order, i) for i in chosen]
            yield pa.RecordBatch.from_pydict({name: pa.array([r[j] for r in out], kind) for j, (name, kind) in enumerate((("lang", pa.string()), ("piece", pa.binary()), ("order", pa.int64()), ("nth", pa.int64())))})

    cuts = some.select("lang", "text", "order").mapInArrow(cut, "lang string, piece binary, order long, nth long")
    return sorted(counts), cuts.dropDuplicates(["lang", "order", "nth"])


def fit(docs: DataFrame, languages: int = 200, per_language: int = 1000, pieces: int = 2, **options) -> Network | None:
    """A network learned from docs (doc_id, text, lang); None where there is nothing to learn from."""
    C.prepare(docs.sparkSession)
    names, rows = learned_rows(docs, languages, per_language, pieces)
    if not names:
        return None

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, truth = [], []
        for batch in batches:
            texts += batch["piece"].to_pylist()
            truth += [names.index(x) for x in batch["lang"].to_pylist()]
        if texts:
            net = train(texts, np.array(truth), names, **options)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p.tobytes() for p in net.parts()], pa.binary()), "shape": pa.array([list(p.shape) for p in net.parts()], pa.list_(pa.int64()))})

    made = rows.repartition(1).sortWithinPartitions("order", "nth").mapInArrow(run, "part binary, shape array<long>").collect()
    if not made:
        return None
    net = Network(names, [], [], np.zeros(0))
    net.put([np.frombuffer(r.part, np.float32).reshape(r["shape"]) for r in made])
    return net


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each begins and the last ends; null as empty."""
    texts = [t or b"" for t in C.binary(column)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if net is None:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    C.prepare(docs.sparkSession)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.pooled(*texts_of(batch["text"]))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            lettered = batch["lettered"].to_pylist()
            names = [net.languages[k] if has else UNKNOWN for k, has in zip(best.tolist(), lettered, strict=True)]
            score = np.clip(p[np.arange(len(best)), best], 0, 1) * np.array(lettered, float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return plain.withColumn("lettered", lettered).mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, start, length (in bytes) and lang of each run of positions with the same likeliest language, of every text."""
    C.prepare(docs.sparkSession)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch["text"])
            label = np.zeros(len(data), np.int64)
            for _, starts, lengths, p in net.positions(data, offsets):
                best = p.argmax(axis=0)
                for j, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                    label[a : a + n] = best[:n, j]
            ids = batch["doc_id"].to_pylist()
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                out += [(ids[i], s, e - s, net.languages[int(label[a + s])]) for s, e in C.runs(label[a:b])]
            yield pa.RecordBatch.from_pydict({name: pa.array([r[j] for r in out], kind) for j, (name, kind) in enumerate((("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())))})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, start long, length long, lang string")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predicted(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
