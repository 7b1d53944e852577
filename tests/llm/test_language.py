"""Language of texts: gradients by differences, bytes one by one, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import language_id as L
from tests.oracle import DATA

SCHEMA = "doc_id long, text string, lang string, score string, lettered int"


def toy(seed=1, hidden=5, names=("a", "b", "c")):
    net = L.Network.start(list(names), hidden, seed)
    net.put([p.astype(np.float64) for p in net.parts()])
    return net


def windows(texts):
    texts = sorted(texts, key=lambda t: -len(t))
    lengths = np.array([len(t) for t in texts])
    return L.Windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths)


def test_gradients():
    net, w, truth = toy(), windows([b"hello world this", b"abc", b"zzz yyy"]), np.array([0, 2, 1])
    _, grads = net.loss(w, truth)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parts(), grads, strict=True):
        places = np.argwhere(g != 0)
        for at in map(tuple, places[rng.integers(0, len(places), 8)]):
            old, step = p[at], 1e-6
            p[at] = old + step
            up = net.loss(w, truth)[0]
            p[at] = old - step
            down = net.loss(w, truth)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-7


def by_hand(net, text):
    """Probabilities of each byte, one after the other."""
    def states(d, order):
        h, out = np.zeros(d.new_own.shape[0]), {}
        n = len(h)
        for t in order:
            gate = np.clip(d.gate_in[text[t]] + h @ d.gate_own, 0, 1)
            new = np.clip(d.new_in[text[t]] + gate[:n] * (h @ d.new_own), -1, 1)
            h = (1 - gate[n:]) * h + gate[n:] * new
            out[t] = h
        return out

    out = []
    for a in range(0, len(text), L.WINDOW):
        span = range(a, min(len(text), a + L.WINDOW))
        f, b = states(net.directions[0], span), states(net.directions[1], reversed(span))
        for t in span:
            e = np.exp(f[t] @ net.weights[0] + b[t] @ net.weights[1] + net.bias)
            out.append(e / e.sum())
    return out


def test_every_byte_counts(monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 3)
    net, rng = toy(), random.Random(5)
    texts = [bytes(rng.choices(range(256), k=n)) for n in (0, 1, 130, 700, 128, 5)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.pooled(data, offsets)
    assert not got[0].any()
    for t, p in zip(texts[1:], got[1:], strict=True):
        assert np.allclose(p, np.mean(by_hand(net, t), axis=0))


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return L.fit(docs.filter(~L.held_out(docs.doc_id)), steps=150)


def test_held_out_accuracy(spark, learned):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [(truth[r.doc_id], r.lang_pred, r.score) for r in L.predicted(docs, learned).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) > 30 and all(0 <= s <= 1 for *_, s in got)
    assert sum(a == b for a, b, _ in got) >= 0.95 * len(got)


def test_odd_rows(spark, learned):
    long = "the and of " * 500_000
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 ++\n", "en"), (None, "the and of this that", None), (4, long, None), (5, "the and of this that", "x"), (5, "the and of this that", "x"), (6, "日本語", None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predicted(spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA), learned).collect()]
    assert [g[1:] for g in got[:3]] == [(L.UNKNOWN, 0.0)] * 3
    assert len({g[1:] for g in got if g[0] in (None, 5)}) == 1 and all(g[1] in learned.languages for g in got[3:])
    assert got[4][1] == "en" and got[4][2] > 0.8


def test_nothing_one_and_many_languages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.fit(docs) is None and L.predicted(docs, None).count() == 0
    rows = spark.createDataFrame([(1, "only this", "xx", "s", 1), (2, None, "yy", "s", 1), (3, "no lang", None, "s", 1), (None, "no id", "zz", "s", 1)], SCHEMA)
    net = L.fit(rows, steps=3)
    assert net.languages == ["xx"]
    assert [(r.lang_pred, r.score) for r in L.predicted(rows, net).orderBy("doc_id").collect()][0] == ("xx", 1.0)
    assert L.fit(rows, steps=3, languages=1).languages == ["xx"]


def test_repeated_rows_are_learned_once(spark):
    rows = [(1, "z " * 400, "aa", "s", 1)] * 300 + [(i, f"text {i}", "bb", "s", 1) for i in range(2, 60)]
    names, learn = L.learned_rows(spark.createDataFrame(rows, SCHEMA), 200, 1000, 2)
    assert names == ["aa", "bb"] and learn.filter("lang = 'aa'").count() == 2


def test_spans_cover_the_text(spark, learned):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(20)
    size = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    by_doc = {}
    for r in L.spans(docs, learned).orderBy("doc_id", "start").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, rows in by_doc.items():
        at = 0
        for a, b in zip(rows, [*rows[1:], None], strict=True):
            assert a.start == at and (b is None or a.lang != b.lang)
            at += a.length
        assert at == size[d]
