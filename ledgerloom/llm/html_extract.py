"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text (what stands between block-level tags). A logistic classifier of a block's tag, ancestors, class
names, link share and wording gives the cost of each label; these costs are the capacities between a block and the two terminals.
Edges of equal capacity both ways join blocks that follow each other and blocks with a common parent, less the further apart they
are in the element tree. The maximum flow separates content from boilerplate: content is what the source still reaches.

There are no labelled pages, so the classifier trains itself: it starts from weights fixed by hand, takes the blocks of a bounded
sample of pages that these are sure of as labelled, and fits its weights to them, held near the first ones.

What a class name says of an element is a feature, and no more: an element that holds most of the page's text, its main heading or
its article isn't set apart for its name.

Scale: one map over the pages, no shuffle; `sample` pages at most are read once more, in one task. A page is read in time linear in
its length, and its graph has a number of edges linear in its blocks; blocks that no neighbours can turn leave the graph first.

Defined results: a null or empty html gives an empty text; other columns may be null; markup that ends early or lacks end tags
is read as far as it goes; repeated rows are judged alike; an empty table gives an empty table; extra columns pass through, and the
own column gets a _ behind its name where that is taken.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C
from .html_blocks import Block, Element, blocks_of

#: Elements that hold no article text; of these, some wrap whole pages at times.
APART = frozenset("nav footer aside form menu dialog button fieldset".split())
WRAPS = frozenset("form fieldset menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role. A name is split at - and _ and at capitals; a word behind "with" and the like says nothing.
APART_WORDS = frozenset(
    """ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    disclaimer sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar header comment
    comments commentlist respond responses replies disqus discussion social share sharing related recommended recommendations trending
    popular newsletter subscribe signup login popup modal overlay widget pagination pager tag tags meta byline search form contentinfo
    complementary dialog paywall skip legal copyright""".split()
)
REMARKS = frozenset("comment comments commentlist respond responses replies disqus discussion".split())
TEXT_WORDS = frozenset("article content post entry main body story text prose".split())
BEHIND = frozenset("with has no is fixed sticky without under over w".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(20_000)
def words_in(names: str) -> tuple[bool, bool, bool]:
    """Whether names set an element apart, whether for remarks of readers, and whether they mark article text."""
    apart = remarks = text = False
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        words = re.split(r"[-_]+", name)
        found = [w for i, w in enumerate(words) if (i == 0 or words[i - 1] not in BEHIND) and (w in APART_WORDS or w + "".join(words[i + 1 : i + 2]) in APART_WORDS)]
        own = any(w in TEXT_WORDS for w in words)
        if found == ["header"] and own:
            found = []
        apart |= bool(found)
        remarks |= any(w in REMARKS for w in found)
        text |= own and not found
    return apart, remarks, text


def settle(blocks: list[Block], elements: list[Element]) -> None:
    """Says of each element if it is set apart (0: no, 1: by its name, 2: by its tag, 3: hidden), and if it is within article text."""
    for b in blocks:
        b.holder.size += len(b.text)
    for e in reversed(elements):
        named = words_in(names(e))
        e.holds |= e.tag in ("h1", "main") or e.attributes.get("role") == "main" or e.tag == "article" and not named[1]
        if e.parent and not (e.tag == "header" or e.tag in APART):
            e.parent.holds |= e.holds
        if e.parent:
            e.parent.size += e.size
    half = elements[0].size / 2
    for e in elements:
        a, above = e.attributes, e.parent
        apart, remarks, text = words_in(names(e)) if e.tag not in ("html", "body", "main", "#root") else (False, False, False)
        how = 1 if apart and not e.holds and (remarks or e.size <= half) else 0
        within = (e.tag in ("article", "main") or a.get("role") == "main" or text) or bool(above and above.within)
        if e.tag in APART and not (e.tag in WRAPS and (e.holds or e.size > half)) or e.tag == "header" and not within:
            how = 2
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "style" in a and HIDDEN.search(a["style"]):
            how = 3
        e.apart = max(how, above.apart if above else 0)
        e.within = within and not e.apart


def names(e: Element) -> str:
    a = e.attributes
    return " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))) if a else ""


RIGHTS = re.compile(r"(?i)©|(?:copyright|all rights reserved|\(c\))(?!\w)")
#: First weights of features(), in their order.
FIRST = np.array([-1.0, 1.0, 1.0, -4.0, 4.0, -2.5, 1.5, 0.8, -5.0, -7.0, -9.0, -14.0, 0.0, 0.0])


def features(block: Block, has_article: bool) -> list[float]:
    """What the classifier knows of a block."""
    e, text = block.holder, block.text
    words = text.count(" ") + 1
    return [
        1.0,
        min(3.0, 0.8 * math.log1p(words)),
        text[-1] in ".!?。؟…\"'”",
        min(1.0, block.linked / max(1, len(text))),
        e.within,
        has_article and not e.within,
        e.tag in HEADINGS and e.within,
        e.tag in ("p", "blockquote", "pre"),
        bool(RIGHTS.match(text)),
        e.apart == 1,
        e.apart == 2,
        e.apart == 3,
        min(1.0, text.count(",") / words),
        words < 4,
    ]


def seen(page: str | None) -> tuple[list[Block], np.ndarray]:
    """A page's blocks and their features."""
    blocks, elements, _ = blocks_of(page or "")
    settle(blocks, elements)
    has_article = any(b.holder.within for b in blocks)
    return blocks, np.array([features(b, has_article) for b in blocks], float).reshape(len(blocks), len(FIRST))


def trained(x: np.ndarray, sure: float = 3.0, hold: float = 0.02, rounds: int = 8) -> np.ndarray:
    """Weights fitted to the blocks that the first weights are sure of, held near these: Newton's steps of a logistic loss."""
    z = x @ FIRST
    x, y = x[np.abs(z) >= sure], (z[np.abs(z) >= sure] > 0).astype(float)
    w = FIRST.copy()
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(x) + hold * (w - FIRST)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + hold * np.eye(len(w)), slope)
    return w


def near(a: Element, b: Element) -> float:
    """Smoothness of neighbours: less with each step between them in the tree."""
    steps = 0
    while a is not b and steps < 12:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        else:
            break
        steps += 1
    return 1.2 / (1 + 0.5 * steps)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between following blocks, and between following blocks with the same parent."""
    edges = [(i, i + 1, near(blocks[i].holder, blocks[i + 1].holder)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if (j := last.get(key := id(b.holder.parent or b.holder))) is not None and j < i - 1:
            edges.append((j, i, 0.6))
        last[key] = i
    return edges


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: labels (True: content) with the least sum of label costs and capacities between different labels.

    A block's cost of the label boilerplate is log(1 + e^z), of content log(1 + e^-z); what both share changes no cut, so a
    block keeps the difference z, as a capacity from the source or to the sink. A block whose difference is more than all its edges
    keeps its label in some minimum cut; it leaves the graph, and its edges become part of its neighbours' differences.
    """
    odds, near_by = list(odds), [{} for _ in odds]
    for a, b, c in edges:
        near_by[a][b] = near_by[a].get(b, 0.0) + c
        near_by[b][a] = near_by[b].get(a, 0.0) + c
    labels: list[bool | None] = [None] * len(odds)
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if labels[i] is None and abs(odds[i]) >= sum(near_by[i].values()) + 1e-9:
            labels[i] = odds[i] > 0
            for j, c in near_by[i].items():
                if labels[j] is None:
                    odds[j] += c if labels[i] else -c
                    del near_by[j][i]
                    queue.append(j)
    rest = [i for i, x in enumerate(labels) if x is None]
    place = {i: k for k, i in enumerate(rest)}
    left = flow([odds[i] for i in rest], [(place[i], place[j], c) for i in rest for j, c in near_by[i].items() if i < j and labels[j] is None])
    for i, x in zip(rest, left, strict=True):
        labels[i] = x
    return labels


def flow(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut by maximum flow: Dinic's algorithm."""
    n = len(odds)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def edge(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, z in enumerate(odds):
        if z > 0:
            edge(source, i, z, 0.0)
        elif z < 0:
            edge(i, sink, -z, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        spot = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while spot[a] < len(heads[a]):
                e = heads[a][spot[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                spot[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                spot[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None, weights: np.ndarray = FIRST) -> str:
    blocks, x = seen(page)
    labels = cut((x @ weights).tolist(), smoothness(blocks))
    return " ".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def fit(pages: DataFrame, sample: int) -> np.ndarray:
    """The classifier's weights, from at most this number of pages, those with the smallest hashes of their urls and lengths."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [seen(page)[1] for batch in batches for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"w": pa.array([trained(np.concatenate([np.empty((0, len(FIRST))), *held])).tolist()], pa.list_(pa.float64()))})

    rows = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(*(["url"] if "url" in pages.columns else []), F.octet_length("html")).alias("h"))
    some = rows.orderBy("h").limit(sample).select("html").coalesce(1).mapInArrow(run, "w array<double>").first()
    return np.array(some.w) if some else FIRST


def extract(pages: DataFrame, sample: int = 400) -> DataFrame:
    """pages with the column ``text``: the main text of ``html``. sample bounds the pages that the classifier is fitted on."""
    C.prepare(pages.sparkSession)
    weights = fit(pages, sample)
    names = [f"c{i}" for i in range(len(pages.columns))]
    i_html = names[C.place_of(pages, "html")]
    flat = pages.toDF(*names)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch[i_html].cast(pa.string()).to_pylist()]
            columns = [c for c in batch.schema.names if c != i_html]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])

    kept = [c for c in pages.columns if c != "html"]
    schema = StructType([*(f for f in flat.schema if f.name != i_html), StructField("text", StringType(), False)])
    return flat.mapInArrow(run, schema).toDF(*kept, *C.free_names(kept, "text"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
