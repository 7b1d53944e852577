"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fanout=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][a : a + fanout]) for a in range(0, len(out[-1]), fanout)])
    return out


def climb(tree, at, fanout=8):
    """Place and run on each level from node `at` up."""
    steps = []
    for nodes in tree[:-1]:
        first = at - at % fanout
        steps.append((at - first, nodes[first : first + fanout]))
        at //= fanout
    return steps


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r[:5])
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = levels([leaf(*r) for r in by_lang[lang]])
    crown = levels([trees[x][-1][0] for x in order])
    out = []
    for j, lang in enumerate(order):
        for i, r in enumerate(by_lang[lang]):
            steps = climb(trees[lang], i) + climb(crown, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            value = leaf(*r[:4], low if tampered else r[4])
            proof = h(*(x for p, run in steps for k, x in enumerate(run) if k != p))
            for p, run in steps:
                value = h(*run[:p], value, *run[p + 1 :])
            root = crown[-1][0]
            out.append((r[0], leaf(*r), trees[lang][-1][0], root, proof, value, value == root))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    tampered = merkle.F.coalesce(merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.F.lit(False))
    df = merkle.folded(docs, tampered, merkle.F.translate("text", merkle.UPPER, merkle.LOWER))
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def odd_rows():
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(75)] + [(100 + i, None, "fr", None, None if i % 2 else "É B") for i in range(9)]
    rows += [(200, "a", None, 1, ""), (None, "a", None, 1, "A"), (None, None, None, None, None), (201, "b", "", 2, "Xy" * 50_000), (202, "c", "Zz", 1, "1:2-3"), (3, "s", "en", 3, "Text 3"), (3, "s", "en", 3, "Other"), (203, "c", "éa", 1, "q")]
    return [(*r, 1, "x") for r in rows]


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == plain(odd_rows())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, "T", 1, "x") for i in range(n)]
    assert found(spark, rows) == plain(rows)


def test_a_language_of_several_blocks(spark, monkeypatch):
    """With blocks of 64 leaves, 700 rows have runs above their blocks, on two levels."""
    monkeypatch.setattr(merkle, "CUT", 2)
    rows = [(i, "s", "en" if i % 10 else "de", 1, f"T{i}", 1, "x") for i in range(700)] + [(5, "s", "en", 1, "same", 1, "x")] * 40
    rng = random.Random(4)
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_more_languages_than_a_run(spark):
    rows = [(i, "s", f"l{i % 30}", 1, f"T{i}", 1, "x") for i in range(90)]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("start", range(0, 40, 7))
def test_a_stack_completes_what_it_can(start):
    """Nodes of a stack over a slice: those whose leaves it has all, the others open."""
    leaves = [h(str(i)) for i in range(83)]
    tree, stack = levels(leaves, 3), merkle.Stack(83, 3, 0)
    for i in range(start, 71):
        stack.push(i, leaves[i])
    stack.flush()
    for level, i, value, is_open in stack.nodes:
        assert tree[level][i] == value
        up = range(i // 3 * 3 ** (level + 1), min(83, (i // 3 + 1) * 3 ** (level + 1)))
        assert is_open == (up[0] < start or up[-1] >= 71)
    assert len({(k, i) for k, i, *_ in stack.nodes}) == len(stack.nodes)
