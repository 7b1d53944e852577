"""Merkle manifest of a dataset: a tree of digests for each group of rows, a root over all groups, and a proof for each row.

A row's leaf is the digest of its fields. Within a group leaves are ordered; while a level has several nodes, each `FANOUT`
consecutive ones (the last run may be shorter, down to one) become the digest of their digests. What remains is the group's subroot,
and the subroots, in the order of the groups, form a tree of the same kind, whose top is the root. Nothing is padded.

Leaves are dealt in ranges of (group, order), and a small table of counts turns a row's place in its range into its index in the
group. Each range is then folded by a stack, like the peaks of a mountain range: a node that completes an aligned run carries into its
parent, at once over several levels if need be. What a range can't complete, at its unaligned ends, comes out as open nodes, and these
are merged level by level with those of the neighbouring ranges: a few hundred for each range, whatever it holds. A row's proof is
made from the leaves of its block (`FANOUT**CUT` leaves, all there are below one node) and the runs above the block, which are
passed down from the root, each from a node to its children.

Scale: the texts are read once. Leaves (some 150 bytes a row) are written, dealt by range, and dealt once more by block for the
proofs; nodes from CUT up are a four-thousandth of them. Groups of any size are spread over ranges and blocks; no task holds more
than a block of rows or a run of nodes. Nothing but heights and counts of levels comes to the driver.

Defined results: a null field, text or group counts as null (`-`), an empty text as `0:`; rows without a key come first in their
group, and rows with the same key are ordered by their leaves, so equal rows are leaves side by side; an empty table has no
root and gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C

#: Nodes of a run, and the level of the node over a block.
FANOUT, CUT = 8, 4
#: Rows of the table of counts that may be sent to every task; beyond, it is joined by a shuffle.
SMALL = 100_000


def part(value: Column) -> Column:
    """A field as it goes into a leaf: `-`, or its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*(part(f) for f in fields)).cast("binary"), 256)


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def wide(n: int, level: int, fanout: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // fanout**level)


class Stack:
    """Folds leaves with consecutive indexes of a group of n leaves, of whose tree it holds one open run for each level.

    nodes: what came out, as (level, index, digest, open); an open node's parent has other children outside of what the stack saw.
    Below level `cut` only open nodes come out.
    """

    def __init__(self, n: int, fanout: int, cut: int):
        self.n, self.fanout, self.cut, self.top = n, fanout, cut, height(n, fanout)
        self.runs: list[list[tuple[int, str]]] = [[] for _ in range(self.top + 1)]
        self.last = [wide(n, k, fanout) - 1 for k in range(self.top + 1)]
        self.nodes: list[tuple[int, int, str, bool]] = []

    def push(self, index: int, value: str) -> None:
        for level in range(self.top):
            run = self.runs[level]
            run.append((index, value))
            if index % self.fanout + 1 < self.fanout and index < self.last[level]:
                return
            first = index - index % self.fanout
            if run[0][0] != first:
                self.put_out(level, True)
                return
            value = digest([v for _, v in run])
            self.put_out(level, False)
            index //= self.fanout
        self.runs[self.top].append((index, value))

    def put_out(self, level: int, is_open: bool) -> None:
        if is_open or level >= self.cut:
            self.nodes += [(level, i, v, is_open) for i, v in self.runs[level]]
        self.runs[level] = []

    def flush(self) -> None:
        for level in range(self.top + 1):
            self.put_out(level, True)


class Tree(NamedTuple):
    """leaves: group, n, index, leaf and what came with them. nodes: group, level, index, digest (from CUT up). tops: group, n, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    heights: int


def same(a: str, *names: str) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names))


def indexed(rows: DataFrame, path: str) -> DataFrame:
    """rows (g, key, leaf and others) with n, the size of the group, and i, the place in it by key and leaf."""
    spark = rows.sparkSession
    stored = C.store(rows.withColumn("row", F.monotonically_increasing_id()), f"{path}/rows")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // 1000)))
    order = ("g", "key", "leaf", "row")
    dealt = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    flat = dealt.drop("row")

    @C.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = (), 0
        for batch in batches:
            places = np.empty(batch.num_rows, np.int64)
            values = batch["g"].to_pylist()
            for j, g in enumerate(values):
                if (g,) != group:
                    group, at = (g,), 0
                places[j], at = at, at + 1
            yield batch.append_column("at", pa.array(places))

    marked = flat.withColumn("part", F.spark_partition_id())
    ranges = C.store(marked.mapInArrow(place, StructType([*marked.schema, StructField("at", LongType())])), f"{path}/ranges")
    counts = ranges.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("g")
    starts = counts.select("g", "part", F.coalesce(F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("c").over(own).alias("n"))
    starts = C.store(starts, f"{path}/starts")
    if starts.count() <= SMALL:
        starts = F.broadcast(starts)
    return ranges.alias("r").join(starts.alias("o"), same("r", "g", "part")).select("r.*", "o.n", (F.col("r.at") + F.col("o.start")).alias("i")).drop("at", "key")


def tree(rows: DataFrame, path: str) -> Tree:
    """The trees of rows: g (the group), key (the order in it), leaf, and other columns that are kept with the leaves."""
    leaves, fanout, cut = indexed(rows, path), FANOUT, CUT

    @C.tidy
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, group, last = None, (), -1

        def out(at) -> Iterator[pa.RecordBatch]:
            if at and at.nodes:
                levels, index, values, is_open = zip(*at.nodes, strict=True)
                yield pa.RecordBatch.from_pydict({"g": pa.array([group[0]] * len(index), pa.string()), "n": pa.array([at.n] * len(index), pa.int64()), "level": pa.array(levels, pa.int32()), "i": pa.array(index, pa.int64()), "value": pa.array(values, pa.string()), "open": pa.array(is_open, pa.bool_())})
                at.nodes = []

        for batch in batches:
            for g, n, i, value in zip(*(batch[c].to_pylist() for c in ("g", "n", "i", "leaf")), strict=True):
                if (g,) != group or i != last + 1:
                    if stack:
                        stack.flush()
                        yield from out(stack)
                    stack, group = Stack(n, fanout, cut), (g,)
                stack.push(i, value)
                last = i
            yield from out(stack)
        if stack:
            stack.flush()
            yield from out(stack)

    folded = C.store(leaves.select("g", "part", "n", "i", "leaf").sortWithinPartitions("part", "g", "i").mapInArrow(fold, "g string, n long, level int, i long, value string, open boolean"), f"{path}/folded")
    most = folded.agg(F.max("n")).first()[0] or 0
    heights, over = height(most, fanout), lambda level: F.expr(f"(n + {fanout**level - 1}) div {fanout**level}")
    merged, levels = None, []
    for level in range(heights + 1):
        here = folded.filter(F.col("level") == level)
        opened = here.filter("open")
        if merged is not None:
            opened, here = opened.drop("open", "level").unionByName(merged), here.drop("open", "level").unionByName(merged)
        levels.append(here.select("g", "n", F.lit(level).alias("level"), "i", "value"))
        if level < heights:
            step = F.lit(fanout)
            up = opened.filter(over(level) > 1).groupBy("g", "n", F.expr(f"i div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("run"))
            expected = F.least(step, over(level) - step * F.col("up"))
            whole = F.when(F.size("run") == expected, F.concat_ws("", F.col("run.value"))).otherwise(F.raise_error(F.lit("a run of the tree is not whole")))
            merged = C.store(up.select("g", "n", F.col("up").alias("i"), F.sha2(whole.cast("binary"), 256).alias("value")), f"{path}/merged-{level + 1}")
    nodes = functools.reduce(DataFrame.unionByName, levels[min(cut, heights) :])
    # the top of a group is the only node of its level
    tops = functools.reduce(DataFrame.unionByName, levels).filter((F.col("i") == 0) & (F.col("n") <= F.pow(F.lit(float(fanout)), "level"))).select("g", "n", F.col("value").alias("subroot"))
    return Tree(leaves, nodes, C.store(tops, f"{path}/tops"), heights)


STEP = "struct<place:int,run:array<string>>"


def downward(t: Tree, path: str, above: DataFrame) -> DataFrame:
    """g, n, i, path: for each node of level CUT the runs from it up to the root. above: g and path, those above the subroots."""
    steps, fanout, cut = None, FANOUT, CUT
    for level in reversed(range(cut, t.heights)):
        here = t.nodes.filter(F.col("level") == level).withColumn("up", F.expr(f"i div {fanout}"))
        here = here.filter(F.col("n") > fanout**level)
        # a run has at most `fanout` nodes
        runs = here.groupBy("g", "n", "up").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("run"))
        top = above.select("g", F.col("path").alias("rest"))
        lone = F.col("n") <= fanout ** (level + 1)
        a = runs.filter(lone).alias("r").join(top.alias("o"), same("r", "g")).select("r.*", "o.rest")
        if steps is not None:
            b = runs.filter(~lone).alias("r").join(steps.alias("o"), same("r", "g") & (F.col("r.up") == F.col("o.i"))).select("r.*", F.col("o.path").alias("rest"))
            a = a.unionByName(b)
        each = a.select("g", "n", "rest", F.col("run.value").alias("values"), F.explode("run").alias("own"))
        place = F.pmod(F.col("own.i"), F.lit(fanout)).cast("int")
        path_ = F.concat(F.array(F.struct(place.alias("place"), F.col("values").alias("run"))).cast(f"array<{STEP}>"), "rest")
        steps = C.store(each.select("g", "n", F.col("own.i").alias("i"), path_.alias("path")), f"{path}/down-{level}")
    # groups that one block holds
    small = t.tops.filter(F.col("n") <= fanout**cut).alias("r").join(above.alias("o"), same("r", "g")).select("r.g", "r.n", F.lit(0).cast("long").alias("i"), "o.path")
    return small if steps is None else small.unionByName(steps)


def fold_up(value: str, steps: list[tuple[int, list[str]]]) -> str:
    """The digest at the top, from one at the bottom and its runs: of each, the own place and all digests, of which the own is replaced."""
    for place, run in steps:
        value = digest([*run[:place], value, *run[place + 1 :]])
    return value


def block_steps(values: list[str], levels: int, fanout: int) -> list[list[list[str]]]:
    """The runs of each level within a block of leaves, from the leaves up."""
    out = []
    for _ in range(levels):
        cut = [values[a : a + fanout] for a in range(0, len(values), fanout)]
        out.append(cut)
        values = [digest(run) for run in cut]
    return out


class Manifest(NamedTuple):
    """leaves: group, index, leaf and the carried columns. nodes: group, level, index, digest. tops: group, n, subroot. root: one row or none.

    blocks: for each block of a group the runs above it.
    """

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: DataFrame
    blocks: DataFrame


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of rows: g, key, leaf and other columns that go with the leaves."""
    path = C.workspace(rows.sparkSession, "merkle")
    t = tree(rows, f"{path}/rows")
    crown = tree(t.tops.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("leaf"), F.col("g").alias("name")), f"{path}/groups")
    root = crown.tops.select(F.col("subroot").alias("root"))
    top = downward(crown, f"{path}/groups", crown.tops.select("g", F.array().cast(f"array<{STEP}>").alias("path")))
    above = C.store(proof_steps(crown.leaves, top).select(F.col("name").alias("g"), "path"), f"{path}/above")
    return Manifest(t.leaves, t.nodes, t.tops, root, downward(t, f"{path}/rows", above))


def blocks_of(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """Leaves with their block and, in each block's first leaf, the block's path, so that it is sent once."""
    size = FANOUT**CUT
    paths = blocks.select("g", F.col("i").alias("block"), "path").alias("o")
    dealt = leaves.withColumn("block", F.expr(f"i div {size}")).withColumn("local", F.pmod(F.col("i"), F.lit(size))).alias("r")
    return dealt, paths


def per_block(leaves: DataFrame, blocks: DataFrame, put, schema: str) -> DataFrame:
    """put(leaves of a block in order, its path) for each block: an Arrow table of at most FANOUT**CUT rows."""
    dealt, paths = blocks_of(leaves, blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("local")
        steps = [(s["place"], s["run"]) for s in right["path"][0].as_py()]
        return put(left, steps)

    key = [F.coalesce(F.concat(F.lit("="), F.col("g")), F.lit("-")).alias("k"), F.col("block").alias("b")]
    a, b = dealt.select(*key, "r.*"), paths.select(*key, "o.path")
    return a.groupBy("k", "b").cogroup(b.groupBy("k", "b")).applyInArrow(run, schema)


def proof_steps(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """The carried columns of leaves with path: all runs from the leaf up."""
    names = [c for c in leaves.columns if c not in ("n", "i", "leaf", "g", "part")]
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}

    def put(rows: pa.Table, steps) -> pa.Table:
        n = rows["n"][0].as_py()
        inner = block_steps(rows["leaf"].to_pylist(), min(CUT, height(n, FANOUT)), FANOUT)
        paths = []
        for j in range(rows.num_rows):
            own, at = [], j
            for runs in inner:
                own.append({"place": at % FANOUT, "run": runs[at // FANOUT]})
                at //= FANOUT
            paths.append([*own, *({"place": p, "run": r} for p, r in steps)])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.list_(pa.string()))]))
        return rows.select(names).append_column("path", pa.array(paths, kind))

    return per_block(leaves, blocks, put, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"path array<{STEP}>"]))


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256 and folded_root of each leaf: the fold starts from `altered`, or from the leaf where that is null."""

    def put(rows: pa.Table, steps) -> pa.Table:
        n = rows["n"][0].as_py()
        levels = min(CUT, height(n, FANOUT))
        leaves = rows["leaf"].to_pylist()
        inner = block_steps(leaves, levels, FANOUT)
        tail = "".join(h for p, run in steps for h in (*run[:p], *run[p + 1 :])).encode()
        shown, folded = [], []
        for j, altered in enumerate(rows["altered"].to_pylist()):
            at, told, own = j, [], []
            for runs in inner:
                place, run = at % FANOUT, runs[at // FANOUT]
                told += run[:place] + run[place + 1 :]
                own.append((place, run))
                at //= FANOUT
            shown.append(hashlib.sha256("".join(told).encode() + tail).hexdigest())
            folded.append(fold_up(altered or leaves[j], own + steps))
        return rows.select(["doc_id", "leaf", "g"]).append_column("proof_sha256", pa.array(shown)).append_column("folded_root", pa.array(folded))

    return per_block(m.leaves, m.blocks, put, "doc_id long, leaf string, g string, proof_sha256 string, folded_root string")


def folded(docs: DataFrame, tampered: Column, altered_text: Column) -> DataFrame:
    """The proofs of docs by language: what a holder of a proof finds whose text is altered_text where `tampered` holds."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    at = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("key"), at(F.col("text")).alias("leaf"), "doc_id", F.when(tampered, at(altered_text)).alias("altered"))
    m = manifest(rows)
    found = proofs(m)
    root = m.root.first()
    tops = m.tops.select("g", "subroot", F.lit(root.root if root else None).cast("string").alias("root"))
    out = found.alias("r").join(tops.alias("o"), same("r", "g"))
    return out.select("r.doc_id", "r.leaf", "o.subroot", "o.root", "r.proof_sha256", "r.folded_root", (F.col("r.folded_root") == F.col("o.root")).alias("verified"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return folded(docs, tampered, F.translate(F.col("text"), UPPER, LOWER))


def sql(levels: int = 7, crowns: int = 3) -> str:
    """The same in DuckDB's SQL, for up to 8**levels documents of a language and 8**crowns languages."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    told = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda s, b: list_reduce([xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {bit})), 4294967295)"
    out = [
        f"docs AS (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents)",
        f"d0 AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {told('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {told('low')} ELSE {told('text')} END AS f0, '' AS p0 FROM docs)",
        "e0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d0)",
        "n0 AS (SELECT g, i, leaf AS h FROM e0)",
    ]

    def climb(name: str, first: str, levels: int, keep: str) -> str:
        """Levels of the tree over n0-like rows of `first`, and the rows of `name` with proof and fold carried along."""
        nodes, rows = first, name
        for k in range(levels):
            r, up, on = f"{first}_r{k}", f"{first}_{k + 1}", f"{name}_{k + 1}"
            out.append(f"{r} AS MATERIALIZED (SELECT g, i // 8 AS up, list(h ORDER BY i) AS run, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {nodes}) GROUP BY g, i // 8)")
            out.append(f"{up} AS MATERIALIZED (SELECT g, up AS i, CASE WHEN c > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {r})")
            at = "a.i % 8"
            out.append(
                f"{on} AS MATERIALIZED (SELECT {keep}, a.g, CASE WHEN c > 1 THEN p0 || array_to_string(run[1:{at}] || run[{at} + 2:], '') ELSE p0 END AS p0, CASE WHEN c > 1 THEN sha256(array_to_string(run[1:{at}] || [f0] || run[{at} + 2:], '')) ELSE f0 END AS f0, a.i // 8 AS i FROM {rows} a JOIN {r} r ON a.g = r.g AND a.i // 8 = r.up)"
            )
            nodes, rows = up, on
        return rows

    last = climb("e0", "n0", levels, "doc_id, leaf")
    out.append(f"m0 AS MATERIALIZED (SELECT 'all' AS g, g AS own, h, row_number() OVER (ORDER BY g) - 1 AS i FROM n0_{levels})")
    out.append(f"q0 AS MATERIALIZED (SELECT doc_id, leaf, a.g AS own, m0.h AS subroot, m0.g, p0, f0, m0.i FROM {last} a JOIN m0 ON a.g = m0.own)")
    last = climb("q0", "m0", crowns, "doc_id, leaf, subroot")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = h AS verified FROM {last}, m0_{crowns}"


SQL = sql()
