"""Training-data operators against brute force, on small fixtures with odd cases."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import additive_ann, chunk_dedup, common, decontaminate, html_extract, jaccard_join, line_dedup, ngram_lm, packing, quality, warc
from ledgerloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import DATA, compare

SCHEMA = "doc_id long, text string, c0 int, n_lines string, score string"
rng = random.Random(8)
WORDS = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


@functools.cache
def odd_documents():
    line, passage = "This line is long enough to count as a repeated one, é.", prose(70)
    texts = [None, "", " \n\t", "One word", "ONE word", "a  b \n c \n \n", "x" * 5000, "\x1f   odd space", "日本語 の 文 です", "<|endoftext|> special"]
    texts += [prose(30) + "\n" + line.upper() + "\r\n" + prose(20) for _ in range(6)]
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(4)]
    base = prose(120).split()
    for _ in range(8):
        copy = list(base)
        copy[rng.randrange(120)] = "changed"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 5 + [prose(3000), "z " * 9000, "a " * 3 + "b"]
    rows = [(i, t, i, "q", None) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[20], (None, texts[12], 1, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    compare(QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_packing(spark, odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t, *_ in odd_documents():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, ids.tobytes()] += 1
    got = packing.pack(odd).collect()
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        assert r.length * 4 == len(r.ids)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        total = 0
        for r in rows:
            assert r.offset == total
            total += r.length
        assert total <= 1024 and (total == 1024 or total & (total - 1) == 0)
    pieces = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.start, r.sequence_id))
    whole = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in pieces:
        whole[r.doc_id][r.start].add(bytes(r.ids))
    assert sum(r.length for r in got) == sum(len(k[1]) // 4 * n for k, n in want.items())
    for (d, ids), n in want.items():
        if n == 1 and sum(k[0] == d for k in want) == 1:
            assert b"".join(next(iter(whole[d][s])) for s in sorted(whole[d])) == ids
    assert packing.pack(empty).count() == 0


def test_encoder_equals_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(*map(public_tokenizers.path, (packing.RANKS, packing.VOCABULARY)), remembered=40)
    parts = [" ", "  ", "\n", " \n", "\t", "foo", "bar.", "é", "123", "'s", "<|endoftext|>", "日本", "!!", "　", " ", "a"]
    for _ in range(1500):
        s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert encoder.encode(s) == np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_long_runs(spark):
    """Runs of a million signs of one kind, alone and between words, and a text of 5 MB."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x * 1_000_000 for x in (" ", "\t", "\n", "7", "a")] + [" \n" * 300_000, "one" + "\u00a0" * 500_000 + "two", " " * 1_000_000 + "<|endoftext|> x", "word " * 1_000_000]
    rows = [(i, t, 1, None, None) for i, t in enumerate(texts)]
    got = collections.defaultdict(dict)
    for r in packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got[r.doc_id][r.start] = bytes(r.ids)
    for i, t in enumerate(texts):
        assert b"".join(got[i][s] for s in sorted(got[i])) == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_sum_of_squares_takes_the_best_level():
    packer, counts = packing.SumOfSquares(16, 1000), collections.Counter()
    for i in range(300):
        size = rng.randint(1, 15)

        def after(h, size=size):
            c = collections.Counter(counts)
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return sum(v * v for v in c.values())

        level = packer.place(size)
        assert after(level) == min(after(h) for h in range(16 - size + 1) if not h or counts[h])
        packer.add((i, 0, b"\0" * 4 * size))
        if level:
            counts[level] -= 1
        if level + size < 16:
            counts[level + size] += 1


def test_line_dedup(spark, odd, empty):
    rows = odd_documents()
    strip = lambda x: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), strip(x))
    holders = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    gone = {k: max(d for d in v if d is not None) for k, v in holders.items() if len(v) >= 5}
    want = collections.Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        want[d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)] += 1
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines_", "n_dropped"]
    assert collections.Counter((r[0], r[5], r[6], r[1]) for r in out.collect()) == want
    assert gone and line_dedup.dedup_lines(empty).count() == 0


def test_filters_have_no_false_negatives(spark, tmp_path):
    values = spark.range(0, 5000).selectExpr("xxhash64(id % 3000) AS k").repartition(6)
    keys = lambda batch: [common.longs(batch["k"]).view(np.uint64)]
    twice = common.twice_seen(values, keys, str(tmp_path / "t"), bits=20)
    again = np.array([r.k for r in spark.range(0, 2000).selectExpr("xxhash64(id) AS k").collect()], np.int64).view(np.uint64)
    once = np.array([r.k for r in spark.range(2000, 3000).selectExpr("xxhash64(id) AS k").collect()], np.int64).view(np.uint64)
    assert twice.has(again).all() and twice.has(once).mean() < 0.1


@pytest.mark.parametrize("most", [0, 10**6])
def test_decontamination(spark, odd, empty, most):
    texts = {d: t for d, t, *_ in odd_documents() if d is not None}
    items = [(1, texts[16]), (2, "Word ONE"), (3, None), (None, "one word"), (4, "!!"), (5, "x" * 5000), (1, texts[16]), (12, texts[18])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = decontaminate.decontaminate(odd, bench, broadcast_windows=most).collect()
    assert len(got) == len(odd_documents())
    for r in got:
        w, hit, found = split(r.text), set(), set()
        for i, t in items:
            b = split(t)
            n = min(13, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n and i is not None else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(i)
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))
        assert sum(b - a for a, b in r.spans) == len(hit)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


def brute_components(rows, k=5, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = collections.Counter()
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[d, len(sets[i]), min(ids) if sets[i] and ids else d] += 1
    return out


def families(n):
    """Families whose members differ more and less, some with a passage in common."""
    rows, common_part = [], prose(60)
    for f in range(n):
        base = prose(rng.randint(8, 150)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            copy = copy[rng.randrange(3) :]
            rows.append((len(rows) * 7 % 1009, " ".join(copy) + (" " + common_part if f % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("group", [4000, 3])
def test_jaccard_components(spark, odd, empty, group):
    got = collections.Counter(map(tuple, jaccard_join.components(odd, group=group).collect()))
    assert got == brute_components(odd_documents())
    rows = families(40)
    got = collections.Counter(map(tuple, jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), group=group).collect()))
    assert got == brute_components(rows)
    assert jaccard_join.components(empty).count() == 0


def test_jaccard_of_repeated_rows(spark):
    """Each row twice: groups of rare shingles with the same outermost holders (two compilations) are told apart."""
    own = random.Random(21)
    words = lambda n: [f"w{own.randrange(10**9)}" for _ in range(n)]
    pairs, boiler = [words(60) for _ in range(6)], words(4000)
    near = [" ".join(p[:-1] + ["other"]) for p in pairs]
    texts = [" ".join(p) for p in pairs] + near + [" ".join(boiler + words(i * 9000)) for i in (1, 2, 3)]
    node = lambda t: jaccard_join.fingerprint(jaccard_join.shingles(t.encode(), 5))[0]
    inside = [node(t) for t in texts]
    quoted = " ".join(x for p in pairs for x in p) + " " + " ".join(boiler)
    first = next(t for i in range(10**4) if node(t := f"{quoted} first{i}") < min(inside))
    last = next(t for i in range(10**4) if node(t := f"{quoted} last{i}") > max(inside))
    rows = [(i, t) for i, t in enumerate([*texts, first, last])] * 2
    got = collections.Counter(map(tuple, jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == brute_components(rows)


def test_one_of_each(spark):
    rows = families(20)
    kept = jaccard_join.one_of_each(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, c0 string"))
    assert kept.columns == ["doc_id", "text", "c0"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k[2] for k in brute_components(rows)})


def test_one_of_each_judges_rows(spark):
    one, two, three, four = (prose(40) for _ in range(4))
    rows = [(1, one), (2, one), (2, two), (3, two), (None, one), (None, three), (None, three), (4, four), (4, four), (4, four + " end"), (5, ""), (5, ""), (None, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    count = collections.Counter((r.doc_id, r.text) for r in kept)
    fours = [x for x in count.elements() if x[0] == 4]
    assert len(fours) == 1 and fours[0] in rows
    assert count == collections.Counter([(1, one), (2, two), (None, three), *fours, (5, ""), (5, ""), (None, None)])


def test_prefix_tree_equals_pairs():
    sets = {i: np.unique(np.array(rng.choices(range(60), k=rng.randint(5, 40)))) for i in range(80)}
    tree = jaccard_join.PrefixTree([(i, len(s), s) for i, s in sets.items()], 60)
    for i, s in sets.items():
        found = []
        tree.probe(len(s), s, lambda j: False, found.append)
        assert sorted(found) == [j for j, o in sets.items() if 100 * len(np.intersect1d(s, o)) >= 60 * len(np.union1d(s, o))], i


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, odd, empty, order):
    got = ngram_lm
    rows = [(d, t) for d, t, *_ in odd_documents()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in rows:
        if d is not None and not held(d):
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
            three.update(zip([None, None, *w], [None, *w], w, strict=False))
    total, distinct = sum(one.values()), len(one)
    if order == 3:
        two = collections.Counter()
        for (u, v, w), c in three.items():
            two[v, w] += c if u is None and v is None else 1
    before = collections.Counter(w for _, w in two)

    def discount(counts):
        n = collections.Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(i - 0.01, max(0.01, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3))]

    d3, d2, d1 = discount(three.values()), discount(two.values()), discount(before.values())
    free = sum(d1[min(c, 3)] for c in before.values()) / len(two) / (distinct + 1)
    left, sums = collections.Counter(), collections.Counter()
    for (u, _), c in two.items():
        left[u] += d2[min(c, 3)]
        sums[u] += c
    for (u, v, _), c in three.items():
        left[u, v] += d3[min(c, 3)]
        sums[u, v] += c

    def p(u, v, w):
        low = free + (before[w] - d1[min(before[w], 3)]) / len(two)
        if v in sums:
            low = (two[v, w] - d2[min(two[v, w], 3)]) / sums[v] + left[v] / sums[v] * low
        if order == 3 and (u, v) in sums:
            low = (three[u, v, w] - d3[min(three[u, v, w], 3)]) / sums[u, v] + left[u, v] / sums[u, v] * low
        return low

    some = next(iter(three))
    for u, v in ((None, None), some[:2]):  # all words and the unknown one sum to 1
        assert abs(sum(p(u, v, w) for w in one) + p(u, v, "unknown") - 1) < 1e-9
    from pyspark.sql import functions as F

    texts = odd.select("doc_id", "text")
    model = got.train(texts.filter(F.col("doc_id").isNotNull() & ~got.held_out(F.col("doc_id"))).select("text"), common.workspace(spark, "test"), order)
    assert (model.total, model.distinct) == (total, distinct)
    chain = lambda t: zip([None, None, *tokens(t)], [None, *tokens(t)], tokens(t), strict=False)
    want = sorted((str(d), len(tokens(t)), sum(w in one for w in tokens(t)), sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in tokens(t)), sum(math.log10(p(u, v, w)) for u, v, w in chain(t))) for d, t in rows)
    out = sorted((str(r[0]), *r[1:]) for r in got.score(texts, model).collect())
    for a, b in zip(out, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-6)
    none = got.train(empty.select("text"), common.workspace(spark, "none"), order)
    assert got.score(texts, none).filter("score <> 0").count() == 0 and got.score(empty, none).count() == 0


def test_quality(spark, empty):
    good = [prose(rng.randint(20, 120)) for _ in range(160)]
    bad = [(w + " ") * 60 for w in rng.choices(WORDS, k=80)] + [re.sub(" ", "### ", prose(50)) for _ in range(80)]
    texts = [*good, *bad, None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 160)) for i in range(320)] + [(5, None), (None, 1), (10**6, 0)], "doc_id long, y int")
    train = labels.filter("doc_id % 2 = 0 OR doc_id IS NULL")
    got = {r.doc_id: r.score for r in quality.score(docs, train).collect()}
    assert len(got) == 322 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i < 160) for i in range(1, 320, 2)]) > 0.95
    kept = quality.accept(docs, train)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    assert all(abs(r.score - 0.5) < 0.02 for r in quality.score(docs, labels.limit(0)).collect())
    assert quality.score(empty, train).count() == 0


def test_quality_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([prose(50), "### " * 9, "", None])], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, y int")
    for rows, score in ([], 0.5), ([(0, None), (1, None)], 0.5), ([(77, 1), (78, 0)], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0)], 0.0):
        assert [r.score for r in quality.score(docs, labels(rows)).collect()] == [score] * 4
        assert quality.accept(docs, labels(rows)).count() == (4 if score >= 0.5 else 0)


def test_ridge_equals_a_plain_fit(spark):
    """Statistics, features and weights against a computation that shares no code with them but the random numbers."""
    texts = [prose(rng.randint(5, 60)) + rng.choice(["", "!", " 12 #%", "\n"]) for _ in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 90, 3)], "doc_id long, y int")
    stats = quality.featured(docs)
    model = quality.fit(stats, labels, features=20)
    x = np.array([quality.statistics(t.encode()) for t in texts])
    words = [t.split() for t in texts]
    assert np.allclose(x[:, :3], [[math.log(1 + len(t.encode())), math.log(1 + len(w)), sum(map(len, w)) / len(w)] for t, w in zip(texts, words, strict=True)])
    every = np.concatenate([x, x[3:4]])
    scaled = np.clip((x - every.mean(axis=0)) / (every.std(axis=0) + 1e-6), -5, 5)
    gen = np.random.default_rng(7)
    w, phase = gen.normal(0, 1 / 4.0, (x.shape[1], 20)), gen.uniform(0, 2 * np.pi, 20)
    f = np.hstack([np.ones((90, 1)), scaled / 3, np.sqrt(2 / 20) * np.cos(scaled @ w + phase)])
    own = [*range(0, 90, 3), 3]
    penalty = np.diag([1e-6] + [1.0] * (f.shape[1] - 1))
    y = np.array([i % 2 for i in own], float)
    assert np.allclose(model.weights, np.linalg.solve(f[own].T @ f[own] + penalty, f[own].T @ y), atol=1e-6)


def test_quality_of_odd_rows(spark):
    good = [prose(60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, "### " * 30) for i in range(40)]
    rows += [(None, good[0]), (None, None), (7, good[7]), (200, "word " * 400_000), (201, "é" * 900_000), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, y int")
    got = collections.defaultdict(list)
    for r in quality.score(docs, labels).collect():
        got[r.doc_id].append(r.score)
    assert len(got[7]) == 2 and got[7][0] == got[7][1] and got[0][0] in got[None] and all(0 <= s <= 1 for x in got.values() for s in x)


def test_isotonic_is_monotone():
    x, y = np.arange(50.0), np.array([rng.random() for _ in range(50)])
    knots, levels = quality.isotonic(x, y, np.ones(50))
    assert (np.diff(levels) > 0).all() and abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.1


def test_nearest_recall_and_ties(spark, empty):
    gen = np.random.default_rng(3)
    centres = gen.normal(size=(12, 24))
    x = (centres[gen.integers(0, 12, 3000)] + gen.normal(size=(3000, 24))).astype(np.float32)
    x[100:140] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, None] + [0.0] * 22), (5200, [1.0]), (None, x[0].tolist()), (5250, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in additive_ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), books=4, words=64, block=25).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 50))
    d = x.astype(float)
    norms = np.sqrt((d * d).sum(axis=1))
    hits = 0
    for q, found in got.items():
        s = (d * d[q]).sum(axis=1) / (norms * norms[q])
        s[q] = -2
        best = np.lexsort((np.arange(3000), -s))[:5]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert all(abs(s[v] - score) < 1e-12 for v, score in found)
    assert hits / (5 * len(got)) >= 0.9
    assert [v for v, _ in got[50]] == [100, 101, 102, 103, 104]
    few = vectors.filter("vec_id IN (0, 1, 50)")
    assert additive_ann.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert additive_ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_nearest_in_a_hot_group(spark):
    """More vectors than codebooks are fitted on, a third of them near copies: the result is that of brute force."""
    gen = np.random.default_rng(17)
    x = gen.normal(size=(6000, 32))
    x[::3] = x[0] + 0.02 * gen.normal(size=(2000, 32)) * np.abs(x[0]).mean()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in additive_ann.nearest(vectors, vectors.filter("vec_id % 40 = 0"), sample=1500, books=4, words=64, rerank=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    norms = np.sqrt((x * x).sum(axis=1))
    for q in range(0, 6000, 40):
        s = (x * x[q]).sum(axis=1) / (norms * norms[q])
        s[q] = -2
        assert got[q] == np.lexsort((np.arange(6000), -s))[:5].tolist(), q


def test_chunks(spark, odd, empty):
    text = prose(2000).encode()
    ends = chunk_dedup.borders(text, 12, 44, 96)
    assert ends[-1] == len(text) and all(0 < b - a <= 96 for a, b in zip([0, *ends], ends, strict=False))
    moved = chunk_dedup.digests(new := b"inserted words here " + text, chunk_dedup.borders(new, 12, 44, 96))
    kept = set(map(bytes, chunk_dedup.digests(text, ends)))
    assert len(kept & set(map(bytes, moved))) > 0.95 * len(kept)
    out = chunk_dedup.dedup_chunks(odd)
    assert out.columns[:5] == odd.columns
    rows = out.collect()
    before = collections.Counter((d, t) for d, t, *_ in odd_documents())
    for r in rows:
        originals = [t for d, t in before if d == r.doc_id]
        cut = lambda t, spans=r.spans: "".join((t or "")[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t or "")], strict=True))
        assert any(cut(t) == (r.text or "") for t in originals)
    dropped = {r.doc_id: r.n_dropped for r in rows}
    assert dropped[16] == 0 and all(dropped[i] > 150 for i in (17, 18, 19)), dropped
    assert all(dropped[i] == 0 for i in (0, 1, 2, 3, 4, 5, 8))
    assert chunk_dedup.dedup_chunks(empty).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="article-page"><header class="site-header"><h1>Site name</h1></header>
<div class="cookie-notice">We use cookies to make this site work better for you. <button>OK</button></div><div id="menu"><ul><li><a href=x>Home</a></li></ul></div>
<div class="content"><h2>The title</h2><p>First paragraph, with some <em>words</em> in it. It goes on.</p><div class="ad">Buy this thing now! It is great.</div><p>Short one.
<p>Second &lt;b&gt; paragraph&nbsp;here &#233;.</div><aside><p>Related: a long sentence that has many words, like an article has.</p></aside>
<section id="comments"><article class="comment"><p>I like this article very much, thank you for writing it.</p></article></section><script>var a="</p>";</script>
<form><label>Name</label><textarea>x</textarea></form><footer>&copy; 2020</footer></body></html>"""


def test_chunks_take_whole_passages(spark):
    """Passages of 51 words, and of characters without spaces, go from end to end, whatever stands around them."""
    own = random.Random(31)
    words = lambda n: " ".join("".join(own.choices("abcdefghij", k=own.randint(2, 9))) for _ in range(n))
    signs = lambda n: "".join(chr(own.randrange(0x4E00, 0x9000)) for _ in range(n))
    passages = [words(51) for _ in range(150)] + [signs(150) for _ in range(30)]
    rows = []
    for i, p in enumerate(passages):
        around = words if " " in p else signs
        rows += [(i, around(40) + p + around(30)), (1000 + i, around(35) + p + around(50))]
    twice = words(60)
    rows += [(3000, twice), (3000, "before it " + twice), (None, twice + " x"), (None, twice)]
    got = [(r.doc_id, r.text, r.n_dropped) for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    by_id = {d: (t, n) for d, t, n in got}
    for i, p in enumerate(passages):
        assert by_id[i] == (rows[2 * i][1], 0)
        assert len(p) <= by_id[1000 + i][1] < len(p) + 8, i
    assert sum(twice in t for _, t, _ in got) == 1 and sum(n >= len(twice) for _, _, n in got) == 3


def test_agreeing_and_extended():
    own = random.Random(32)
    for _ in range(300):
        common_part = bytes(own.choices(b"ab", k=own.randrange(300)))
        assert chunk_dedup.agreeing(common_part + b"x", common_part + b"yz") == len(common_part)
    text, other = "§ before, middle, after é".encode(), "¨ before, middle, after è".encode()
    at = text.index(b"middle")
    a, b = chunk_dedup.extended(text, at, at + 6, other, other.index(b"middle"))
    assert text[a:b].decode() == " before, middle, after "
    assert chunk_dedup.extended(b"y" * 9999 + b"z", 9000, 9100, b"y" * 9999, 9000) == (0, 9999)


def test_main_text(spark):
    want = "The title First paragraph, with some words in it. It goes on. Short one. Second <b> paragraph here é."
    assert html_extract.main_text(PAGE) == want
    for broken in (None, "", "<", "<p", "<!-- ", "<script>x", "</p></div>", "<div>" * 3000, "<a '" * 9, "<p title='"):
        assert html_extract.main_text(broken) in ("", "<")
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string").repartition(2)
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "text_"]
    assert sorted((r.page_id or 0, r.text, r.text_) for r in out.collect()) == sorted([(0, None, ""), (1, "t", want), (1, "t", want)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


P = "<p>The first paragraph of the article, which is long enough. It has two sentences.</p><p>The second one goes on, with some more words in it.</p>"
TEXT = "The first paragraph of the article, which is long enough. It has two sentences. The second one goes on, with some more words in it."
LAYOUTS = {
    "layout class": f'<body><div class="layout with-sidebar"><article>{P}</article><div class="sidebar"><a href=x>Other pages</a></div></div>',
    "site class": f'<body><div class="hfeed fixed-header site"><article>{P}</article></div><footer>Contact us at any time of day.</footer>',
    "named wrapper": f'<body><div class="sidebar-left widget"><div>{P}</div></div>',
    "advert in the text": f'<article>{P.replace("</p><p>", "</p><div class=content-ad>Buy one of our new things today.</div><p>")}</article>',
    "meta": f'<article><div class="post-meta">By a writer, at noon, in the city.</div>{P}<div class="article-share"><a href=x>Share this</a></div></article>',
    "apostrophe": f"<article>{P.replace('<p>', '<p title=it&apos;s>', 1).replace('&apos;', chr(39))}</article>",
    "quote": f'<article>{P.replace("<p>", "<p title=5" + chr(34) + ">", 1)}</article>',
    "greater in value": f'<article>{P.replace("<p>", "<p title=" + chr(34) + "a > b" + chr(34) + ">", 1)}</article>',
    "form page": f"<body><form action=x><div>{P}</div><input name=q></form>",
    "search form": f"<body><form class=search><label>Search this site for words</label><input></form><main>{P}</main>",
    "comments": f'<main>{P}</main><section id="comments"><h2>3 comments</h2><article class="comment"><p>I have read it all, and I did like it very much, thank you.</p></article></section>',
    "long comments": f'<div class="content">{P}</div><div class="comment-list">' + "<div><p>A remark of a reader that is rather long, and says things. Quite so.</p></div>" * 6 + "</div>",
    "cookies": f'<div class="cookie-consent"><p>We use cookies to give you the best pages that we can. You may agree.</p></div><div id="main">{P}</div>',
    "hidden": f'<main>{P}<p style="display: none">This can not be seen by anyone who reads the page.</p><p hidden>Nor can this be seen, at all.</p></main>',
    "svg": f"<article><svg viewBox=x /><svg><text>Label</text></svg>{P}<object>{''}</article>",
    "head without end": f"<html><head><title>Name</title><meta charset=utf-8><article>{P}</article>",
    "no article": f'<body><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul><table><tr><td>{P}</td></tr></table><div class="footer">© 2020 Someone</div>',
    "list inside": f"<article>{P.replace('</p><p>', '</p><ul><li>A point that is made in the list.<li>Another point that is made.</ul><p>')}</article>",
    "breaks": f"<article>{P.replace(', with', ',<br>with')}</article>",
    "header of the article": f'<article><header class="entry-header"><h2>A heading of it</h2></header>{P}</article>',
    "aside": f"<article>{P}<aside><p>Read also this other article, which is about the same. It is good.</p></aside></article>",
    "script": f'<article><script>document.write("<p>no</p>");</script>{P}<style>p > a {{}}</style><!-- <p>no</p> --></article>',
}
MORE = {"list inside": TEXT.replace("sentences. ", "sentences. A point that is made in the list. Another point that is made. "), "header of the article": f"A heading of it {TEXT}"}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html_extract.main_text(LAYOUTS[name]) == MORE.get(name, TEXT)


@pytest.mark.parametrize("piece", ["<a '", "<b><i></u>", "<div>x ", "</x>", '<a b=" ', "<!-- ", "<p>Some words, in it.</p>", "<p><b><i><hr>t "])
def test_pages_are_read_in_linear_time(piece):
    def seconds(size):
        start = time.perf_counter()
        page = piece * (size // len(piece))
        html_extract.main_text(page)
        warc.read(page)
        return time.perf_counter() - start

    small = seconds(300_000)
    assert seconds(1_500_000) < 5 * 4 * small + 2


def test_the_classifier_keeps_to_its_sure_blocks():
    x = np.concatenate([html_extract.seen(p)[1] for p in LAYOUTS.values()])
    w = html_extract.trained(x)
    sure = np.abs(x @ html_extract.FIRST) >= 3
    assert sure.any() and ((x @ w > 0) == (x @ html_extract.FIRST > 0))[sure].all() and np.abs(w - html_extract.FIRST).max() < 1
    assert (html_extract.trained(x[:0]) == html_extract.FIRST).all()


def test_cut_is_minimal():
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.choice([-3, -1, -0.5, 0.5, 1, 2.5]) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels, odds=odds, edges=edges):
            return sum(abs(z) for z, x in zip(odds, labels, strict=True) if (z > 0) != x) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.cut(odds, edges)) == pytest.approx(best)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a.example/x", PAGE, "e"), (2, None, None, None), (None, "http://b.example/é", "", "f"), (1, "http://a.example/x", PAGE, "e")]
    made = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, block string"))
    derived = warc.derive(made)
    sources = {r.record_id: r for r in made.collect()}
    got = derived.collect()
    assert len(got) == 8 and collections.Counter(r.warc_type for r in got) == {"metadata": 4, "conversion": 4}
    for r in got:
        source, h = sources[r.headers["WARC-Refers-To"]], r.headers
        assert h["WARC-Target-URI"] == source.target_uri and h["WARC-Date"] == source.date and int(h["Content-Length"]) == len(r.block)
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and h["WARC-Source-Payload-Digest"] == source.headers["WARC-Payload-Digest"]
    both = made.drop("page_id").unionByName(derived)
    files = warc.write_warc(both, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    flat = lambda df: sorted((r.record_id, r.warc_type, r.target_uri, r.date, sorted(r.headers.items()), bytes(r.block)) for r in df.collect())
    assert files and flat(both) == flat(back)
    text = next(bytes(r.block).decode() for r in got if r.warc_type == "conversion" and r.block)
    assert "First paragraph, with some words in it. It goes on." in text.split("\n") and "<" not in text.replace("<b>", "")


def test_what_a_page_says_of_itself():
    text, about = warc.read('<head><title>A &amp; b</title><meta name=k content="v"><link href=x></head><p>One<a href="/y?a=1&amp;b">two</a><style>s</style><p>three')
    assert text == "Onetwo\nthree" and about == {"Title": "A & b", "Metas": [{"name": "k", "content": "v"}], "Links": ["x", "/y?a=1&b"]}


def test_malformed_records(spark, tmp_path):
    good = warc.encoded({"WARC-Type": "response", "Content-Length": "3"}, b"abc")
    for i, bad in enumerate((b"", b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc")):
        (tmp_path / f"{i}.warc").write_bytes(good + bad)
    assert [bytes(r.block) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [b"abc"] * 4
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).count() == 0


def test_sha_of_no_lines(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(docs).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "n_lines").first()
    assert out.h == hashlib.sha256(b"").hexdigest() and out.n_lines == 1
