"""Jaccard self-join of n-gram sets with a prefix tree, as connected components.

Steps, each over all rows and none with a join on a hot key:
1. every text becomes its set of shingle hashes; equal sets become one node (combined before the shuffle);
2. each shingle's document frequency is counted over the nodes: tasks send their hashes, dealt by the top bits; only shingles in
   two nodes or more are kept, numbered by frequency, file and place, as a sorted table that workers map into memory;
3. a node survives if enough of its shingles are shared; its shared shingles, in the global order (rare first), are stored
   once, however many rows stand for it;
4. two linked sets share a shingle of their prefixes. For each prefix shingle one leader is chosen; survivors are probed
   against their leaders, which connects groups of near copies without forming their pairs;
5. shingles whose holders are still in two components or more are joined group by group: a prefix tree of the sets, in order of
   frequency, is traversed with partial overlaps shared along common paths, subtrees pruned by the bound on what can still
   overlap, and whole subtrees accepted where every set below must link. Groups over a size are dealt in pairs of blocks;
6. components by hooking to the smallest neighbour and contracting, until no link between components is left.

Exact but for the digests: sets are compared by whole 64-bit hashes of shingles, and nodes are 64 bits of a digest. Of n different
shingles, or sets, any two share one with a chance of n^2 / 2^65.

Defined results: texts without words (null, empty, blank) have n_shingles 0 and are linked with nothing; a row without doc_id
gets the smallest doc_id of its component, null if it has none; rows that repeat a doc_id are judged by their own texts; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C

NULL_ID = -(2**63)
#: Rows of groups with a component in common that are joined in one task.
FAMILY = 500
#: Shingles that are looked up at once.
AT_ONCE = 400_000


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and white space of ASCII only
    return np.unique(C.windows(C.word_hashes(words), min(k, len(words)))) if words else np.empty(0, C.U64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list[int | None], list[np.ndarray], list[bytes | None]]]:
    """doc_ids, sets and texts of a batch, about AT_ONCE shingles at a time."""
    ids, sets, texts, size = [], [], [], 0
    for doc_id, text in zip(batch["doc_id"].to_pylist(), C.binary(batch["text"]), strict=True):
        ids.append(doc_id)
        sets.append(shingles(text, k))
        texts.append(text)
        size += len(sets[-1])
        if size >= AT_ONCE:
            yield ids, sets, texts
            ids, sets, texts, size = [], [], [], 0
    if ids:
        yield ids, sets, texts


class Sets:
    """Stored sets by node, in the shared folder: n (full size) and the shared shingles' ranks, ascending."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.files = path, bits, {}

    def __getstate__(self):
        return self.path, self.bits

    def __setstate__(self, state):
        self.__init__(*state)

    def get(self, node: int) -> tuple[int, np.ndarray]:
        key = C.U64(node & (2**64 - 1))
        bucket = int(key >> C.U64(64 - self.bits)) if self.bits else 0
        if bucket not in self.files:
            self.files[bucket] = np.load(f"{self.path}/{bucket:05d}-index.npy"), np.load(f"{self.path}/{bucket:05d}-ranks.npy", mmap_mode="r")
        index, ranks = self.files[bucket]
        i = int(np.searchsorted(index[0].view(C.U64), key))
        return int(index[1, i]), ranks[index[2, i] : index[3, i]]


class PrefixTree:
    """Sets as paths from the root, most frequent shingle first; runs without a branch are one node.

    A node: [ranks, children, ids that end here, smallest n, largest n, most ranks below, a member if all below are known to be
    in one component].
    """

    def __init__(self, members: list[tuple[int, int, np.ndarray]], percent: int, find: Callable[[int], int] | None = None):
        """members: (id, n, ascending ranks); find: an id's component so far."""
        self.percent = percent
        rows = sorted(((r[::-1].tolist(), i, n) for i, n, r in members), key=lambda x: x[0])
        self.root = [[], [], [], 0, 0, 0, None]
        order, stack = [], [(self.root, 0, len(rows), 0)]
        while stack:
            node, a, b, depth = stack.pop()
            order.append(node)
            first, last = rows[a][0], rows[b - 1][0]
            end = depth
            while end < len(first) and end < len(last) and first[end] == last[end]:
                end += 1
            node[0] = first[depth:end]
            while a < b and len(rows[a][0]) == end:
                node[2].append((rows[a][1], rows[a][2]))
                a += 1
            while a < b:
                head, lo, hi = rows[a][0][end], a, b
                while lo < hi:  # the first row with another rank here; ranks ascend
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if rows[mid][0][end] <= head else (lo, mid)
                node[1].append(child := [[], [], [], 0, 0, 0, None])
                stack.append((child, a, lo, end))
                a = lo
        for node in reversed(order):
            sizes = [n for _, n in node[2]] + [c[3] for c in node[1]], [n for _, n in node[2]] + [c[4] for c in node[1]]
            node[3], node[4] = min(sizes[0]), max(sizes[1])
            node[5] = max((len(c[0]) + c[5] for c in node[1]), default=0)
            below = [i for i, _ in node[2]] + [c[6] for c in node[1]]
            if len(below) == 1 or find and None not in below and len({find(i) for i in below}) == 1:
                node[6] = below[0]

    def ids(self, node: list) -> Iterator[int]:
        stack = [node]
        while stack:
            node = stack.pop()
            yield from (i for i, _ in node[2])
            stack += node[1]

    def probe(self, n: int, ranks: np.ndarray, same: Callable[[int], bool], link: Callable[[int], None]) -> None:
        """Calls link(id) for the sets that link with this one, leaving out those for which same(id) holds."""
        p, ascending = self.percent, ranks.tolist()
        own = frozenset(ascending)
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if 100 * node[4] < p * n or 100 * n < p * node[3] or node[6] is not None and same(node[6]):
                continue
            if node[0]:
                overlap += len(own.intersection(node[0]))
                left = bisect_left(ascending, node[0][-1])
            else:
                left = len(ascending)
            if (100 + p) * (overlap + min(left, node[5])) < p * (n + node[3]):
                continue
            if (100 + p) * overlap >= p * (n + node[4]) and 100 * node[3] >= p * n and 100 * n >= p * node[4]:
                some = None
                for i in self.ids(node):
                    some = i
                    if not same(i):
                        link(i)
                if same(some):
                    node[6] = some
                continue
            for i, size in node[2]:
                if (100 + p) * overlap >= p * (n + size) and not same(i):
                    link(i)
            stack += [(c, overlap) for c in node[1]]


class Roots:
    """Each node's component, after rounds of hooking: a chain of tables node -> smaller node."""

    def __init__(self, tables: list[C.Table]):
        self.tables = tables

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.copy()
        for table in self.tables:
            at = np.arange(len(keys))
            while len(at):
                found, (up,) = table.get(keys[at].view(C.U64))
                at = at[found]
                keys[at] = up[found]
        return keys


def connect(edges: DataFrame, path: str) -> Roots:
    """Components of edges (a, b): each node hooks to its smallest neighbour, links are contracted, until none is left."""
    tables: list[C.Table] = []
    while not edges.isEmpty():
        at = f"{path}-{len(tables)}"
        hooks = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
        tables.append(C.write_table(hooks, at))
        last = Roots(tables[-1:])

        @C.tidy
        def contract(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = last.find(C.longs(batch["a"])), last.find(C.longs(batch["b"]))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

        edges = C.store(edges.mapInArrow(contract, "a long, b long").distinct(), f"{at}-edges")
    return Roots(tables)


def pairs_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def row_key(doc_id: int | None, text: bytes | None) -> int:
    """A digest of a row's id and text, as a signed number."""
    return xxhash.xxh3_64_intdigest(text or b"", (NULL_ID if doc_id is None else doc_id) & (2**64 - 1)) - 2**63


def linked(docs: DataFrame, k: int, percent: int, group: int) -> tuple[DataFrame, Roots, str]:
    """doc_id, n, f1, f2 (of the set) and key (of the row) of every row; the components of all f1; and the folder.

    Two rows link when 100 * intersection >= percent * union of their sets of k-word shingles. group: rows of a shingle from
    which on it is dealt in pairs of blocks.
    """
    spark = docs.sparkSession
    path = C.workspace(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # 1. sets and nodes
    @C.tidy
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets, whole in sets_of(batch, k):
                marks = [fingerprint(s) for s in sets]
                keys = [row_key(i, t) for i, t in zip(ids, whole, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)), pa.array(keys, pa.int64())], names=["doc_id", "n", "f1", "f2", "key"])

    rows = C.store(texts.mapInArrow(prints, "doc_id long, n long, f1 long, f2 long, key long"), f"{path}/rows")
    classes = rows.filter("n > 0").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.min("doc_id"), F.lit(NULL_ID)).alias("holder"), F.max("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    copied = C.write_table(classes.filter("c > 1").select("f1", "f2", "holder"), f"{path}/copied")
    bits = C.table_bits(spark, total)

    def nodes(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray]]]:
        """The sets of a batch's rows that stand for their nodes."""
        for ids, sets, _ in sets_of(batch, k):
            marks = [fingerprint(s) for s in sets]
            found, (second, holder) = copied.get(np.array([m[0] for m in marks], np.int64).view(C.U64))
            mine = [len(s) > 0 and (not f or b != m[1] or h == (NULL_ID if i is None else i)) for i, s, m, f, b, h in zip(ids, sets, marks, found.tolist(), second.tolist(), holder.tolist(), strict=True)]
            yield [m for m, x in zip(marks, mine, strict=True) if x], [s for s, x in zip(sets, mine, strict=True) if x]

    # 2. document frequencies of shared shingles
    @C.tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in nodes(batch):
                every = np.sort(np.concatenate([np.empty(0, C.U64), *sets]))
                top = (every >> C.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(top)) + 1, len(top)] if len(top) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(top[cuts[:-1]], pa.int32()), "hashes": pa.array([every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    C.os.makedirs(f"{path}/shared")

    def count(part: pa.Table) -> pa.Table:
        """Writes hash -> rank, a number of its own: the frequency (up to 2**19), the file, the place in the file."""
        bucket = part["bucket"][0].as_py()
        keys, counts = np.unique(np.frombuffer(b"".join(part["hashes"].to_pylist()), C.U64), return_counts=True)
        keys, counts = keys[counts > 1], counts[counts > 1]
        ranks = (np.minimum(counts, 2**19 - 1) << 44) | (bucket << 28) | np.arange(len(keys))
        C.save(np.stack([keys.view(np.int64), ranks]), f"{path}/shared/{bucket:05d}.npy")
        return C.only(bucket)

    shared = C.Table(f"{path}/shared", bits, 1, C.per_bucket(texts.mapInArrow(deal, "bucket int, hashes binary"), bits, count))

    # 3. survivors: nodes that share enough
    @C.tidy
    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, sets in nodes(batch):
                every = np.concatenate([np.empty(0, C.U64), *sets])
                found, (ranks,) = shared.get(every)
                out, start = [], 0
                for (f1, _), tokens in zip(marks, sets, strict=True):
                    mine = found[start : start + len(tokens)]
                    if 100 * int(mine.sum()) >= percent * len(tokens):
                        out.append((f1, len(tokens), np.sort(ranks[start : start + len(tokens)][mine]).tobytes()))
                    start += len(tokens)
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", "ranks"])

    survivors = C.store(texts.mapInArrow(survive, "node long, n long, ranks binary").dropDuplicates(["node"]), f"{path}/survivors")
    few = C.table_bits(spark, survivors.agg(F.sum("n")).first()[0] or 0)
    C.os.makedirs(f"{path}/sets")

    def keep_sets(part: pa.Table) -> pa.Table:
        bucket, node, n = part["bucket"][0].as_py(), C.longs(part["node"].combine_chunks()), C.longs(part["n"].combine_chunks())
        order = np.argsort(node.view(C.U64))
        data = part["ranks"].to_pylist()
        data = [data[i] for i in order]
        ends = np.cumsum([len(x) // 8 for x in data])
        C.save(np.frombuffer(b"".join(data), np.int64), f"{path}/sets/{bucket:05d}-ranks.npy")
        C.save(np.stack([node[order], n[order], np.r_[0, ends[:-1]], ends]), f"{path}/sets/{bucket:05d}-index.npy")
        return C.only(bucket)

    C.per_bucket(survivors.withColumn("bucket", C.bucket_of(F.col("node"), few)), few, keep_sets)
    sets = Sets(f"{path}/sets", few)

    def prefix(n: int, ranks: np.ndarray) -> np.ndarray:
        """The rarest shared shingles, of which a set that links has one at least, as evenly spread keys."""
        return C.mix(ranks[: len(ranks) + (-percent * n // 100) + 1].view(C.U64))

    def prefixes(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [prefix(n, np.frombuffer(r, np.int64)) for n, r in zip(batch["n"].to_pylist(), batch["ranks"].to_pylist(), strict=True)]

    # 4. leaders
    @C.tidy
    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = prefixes(batch)
            sizes = [len(x) for x in keys]
            fit = [1000 * len(r) // (8 * n) for n, r in zip(batch["n"].to_pylist(), batch["ranks"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([np.empty(0, C.U64), *keys]).view(np.int64)), "node": pa.array(np.repeat(C.longs(batch["node"]), sizes)), "fit": pa.array(np.repeat(np.array(fit, np.int32), sizes), pa.int32())})

    held = survivors.mapInArrow(fits, "token long, node long, fit int").groupBy("token").agg(F.max(F.struct("fit", "node")).alias("best"), F.min("node").alias("low"), F.max("node").alias("high"))
    leaders = C.write_table(held.filter("low <> high").select("token", F.col("best.node").alias("leader")), f"{path}/leaders")

    @C.tidy
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys = C.longs(batch["node"]), prefixes(batch)
            found, (leader,) = leaders.get(np.concatenate([np.empty(0, C.U64), *keys]))
            owner = np.repeat(np.arange(len(node)), [len(x) for x in keys])
            wanted = np.unique(np.stack([leader[found], owner[found]]), axis=1)
            wanted = wanted[:, wanted[0] != node[wanted[1]]]
            sizes, data = batch["n"].to_pylist(), batch["ranks"].to_pylist()
            edges: list[tuple[int, int]] = []
            for a, b in C.runs(wanted[0]):
                n, ranks = sets.get(int(wanted[0, a]))
                tree = PrefixTree([(int(node[i]), sizes[i], np.frombuffer(data[i], np.int64)) for i in wanted[1, a:b].tolist()], percent)
                tree.probe(n, ranks, lambda i: False, lambda i, to=int(wanted[0, a]): edges.append((i, to)))
            yield pairs_batch(edges)

    links = C.store(survivors.mapInArrow(star, "a long, b long").distinct(), f"{path}/star")
    roots = connect(links, f"{path}/first")

    # 5. shingles between components. The first common shingle of a linked pair is in the prefix of the larger set and in the
    # shorter index prefix of the smaller one; groups with the same holders in the same roles are joined once
    @C.tidy
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, node = prefixes(batch), C.longs(batch["node"])
            sizes = [len(x) for x in keys]
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([np.empty(0, C.U64), *keys]).view(np.int64)), "node": pa.array(np.repeat(node, sizes)), "root": pa.array(np.repeat(roots.find(node), sizes)), "indexed": pa.array(roles(batch, sizes), pa.int32())})

    def roles(batch: pa.RecordBatch, sizes: list[int]) -> np.ndarray:
        """Of each prefix shingle: 1 if it is in the index prefix."""
        short = [len(r) // 8 + (-2 * percent * n // (100 + percent)) + 1 for n, r in zip(batch["n"].to_pylist(), batch["ranks"].to_pylist(), strict=True)]
        return np.concatenate([np.empty(0, np.int32), *((np.arange(a) < b).astype(np.int32) for a, b in zip(sizes, short, strict=True))])

    # holders are known by a sum of mixed nodes, in two halves that can't overflow; a xor would lose those that come twice
    mixed = F.xxhash64("node")
    halves = {"1": mixed.bitwiseAND(F.lit(2**32 - 1)), "2": F.shiftrightunsigned(mixed, 32)}
    signs = [f(x).alias(name + i) for i, x in halves.items() for name, f in (("sig", F.sum), ("own", lambda x: F.sum(x * F.col("indexed"))))]
    open_ = survivors.mapInArrow(labelled, "token long, node long, root long, indexed int").groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.sum("indexed").alias("c2"), *signs)
    groups = open_.filter("r1 <> r2 AND c2 > 0").groupBy("c", "low", "high", "c2", "sig1", "sig2", "own1", "own2").agg(F.min(F.struct("token", "r1")).alias("t")).select("t.token", "c", "t.r1")
    groups = C.store(groups, f"{path}/groups")
    contested = C.write_table(groups, f"{path}/contested", groups.count())
    families = C.write_table(groups.groupBy("r1").agg(F.sum("c").alias("size")), f"{path}/families")

    @C.tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, node = prefixes(batch), C.longs(batch["node"])
            sizes = [len(x) for x in keys]
            every = np.concatenate([np.empty(0, C.U64), *keys])
            found, (c, r1) = contested.get(every)
            owner, token, blocks = np.repeat(node, sizes)[found], every[found].view(np.int64), -(-c[found] // group)
            role = roles(batch, sizes)[found]
            # groups of a family meet in a task, which remembers what it has compared, up to FAMILY rows; beyond, in several
            share = -(-families.get(r1[found].view(C.U64))[1][0] // FAMILY)
            family = (C.mix(r1[found].view(C.U64) + every[found] % np.maximum(1, share).astype(C.U64))).view(np.int64)
            mine = (C.mix(owner.view(C.U64)) % np.maximum(blocks, 1).astype(C.U64)).astype(np.int64)
            other = np.concatenate([np.empty(0, np.int64), *(np.arange(x) for x in blocks)])
            family, token, owner, mine, role = (np.repeat(x, blocks) for x in (family, token, owner, mine, role))
            yield pa.RecordBatch.from_pydict({"family": pa.array(family), "token": pa.array(token), "i": pa.array(np.minimum(mine, other)), "j": pa.array(np.maximum(mine, other)), "node": pa.array(owner), "indexed": pa.array(role, pa.int32())})

    @C.tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        held: dict[int, int] = {}
        at = None
        edges: list[tuple[int, int]] = []
        compared: set[tuple[int, int]] = set()

        def close() -> None:
            members = sorted(held)
            for i, root in zip(members, roots.find(np.array(members, np.int64)).tolist(), strict=True):
                if i != root and i not in parent:
                    parent[i] = root
            indexed = [i for i in members if held[i]]
            if len({find(i) for i in members}) < 2 or not indexed:
                return
            probes = members
            if len(indexed) * len(members) <= 100_000:  # else remembering costs more than comparing
                probes = [x for x in members if any((x, y) not in compared and find(x) != find(y) for y in indexed)]
                if len(compared) > 2_000_000:
                    compared.clear()
                compared.update((x, y) for x in probes for y in indexed)
            if not probes:
                return
            tree = PrefixTree([(i, *sets.get(i)) for i in indexed], percent, find)
            for x in probes:

                def link(y: int, x=x) -> None:
                    edges.append((x, y))
                    parent[find(x)] = find(y)

                tree.probe(*sets.get(x), lambda y, x=x: find(x) == find(y), link)

        for batch in batches:
            for token, i, j, node, role in zip(*(batch[c].to_pylist() for c in ("token", "i", "j", "node", "indexed")), strict=True):
                if (token, i, j) != at:
                    if held:
                        close()
                    at, held = (token, i, j), {}
                    if len(parent) > 500_000:
                        parent.clear()
                held[node] = max(role, held.get(node, 0))
            yield pairs_batch(edges)
            edges.clear()
        if held:
            close()
        yield pairs_batch(edges)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = survivors.mapInArrow(spread, "family long, token long, i long, j long, node long, indexed int").repartition(parts, "family", "i", "j").sortWithinPartitions("family", "token", "i", "j")
    more = C.store(dealt.mapInArrow(join, "a long, b long").distinct(), f"{path}/more")

    # 6. components of nodes, and their smallest doc_id
    @C.tidy
    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"a": pa.array(roots.find(C.longs(batch["a"]))), "b": pa.array(roots.find(C.longs(batch["b"])))})

    last = connect(more.mapInArrow(rooted, "a long, b long").filter("a <> b"), f"{path}/second")
    return rows, Roots(roots.tables + last.tables), path


def components(docs: DataFrame, k: int = 5, percent: int = 75, group: int = 4000) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every row; see linked()."""
    rows, every, path = linked(docs, k, percent, group)

    @C.tidy
    def with_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n"], pa.array(every.find(C.longs(batch["f1"])))], names=["doc_id", "n", "root"])

    named = rows.mapInArrow(with_root, "doc_id long, n long, root long")
    smallest = C.write_table(named.filter("n > 0").groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("low")).filter("c > 1 AND low IS NOT NULL").select("root", "low"), f"{path}/smallest")

    @C.tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = C.longs(batch["n"])
            found, (low,) = smallest.get(every.find(C.longs(batch["f1"])).view(C.U64))
            found &= n > 0
            own = batch["doc_id"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n"], pa.array([x if f else o for f, x, o in zip(found.tolist(), low.tolist(), own, strict=True)], pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return rows.mapInArrow(finish, "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75, group: int = 4000) -> DataFrame:
    """One row of each component of docs, and all rows without words.

    Each row is judged by its own text. The smallest doc_id stays, a row without one only where no row of the component has one;
    of different texts of that doc_id the one with the smallest digest; of rows with the same doc_id and text any one.
    """
    rows, every, path = linked(docs, k, percent, group)

    @C.tidy
    def with_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(every.find(C.longs(batch["f1"]))), batch["doc_id"], batch["key"]], names=["root", "doc_id", "key"])

    rooted = C.store(rows.filter("n > 0").mapInArrow(with_root, "root long, doc_id long, key long").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times")), f"{path}/rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("first")
    winners = C.store(rooted.groupBy("root").agg(F.sum("times").alias("c"), first).filter("c > 1").select("root", "first.key", "first.times"), f"{path}/winners")
    stays = C.write_table(winners.select("root", "key"), f"{path}/stays")

    @C.tidy
    def losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = C.longs(batch["key"])
            found, (best,) = stays.get(C.longs(batch["root"]).view(C.U64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[found & (key != best)])})

    gone = C.write_table(rooted.mapInArrow(losers, "key long").distinct(), f"{path}/gone")
    again = winners.filter("times > 1").select("key").distinct()
    some = not again.isEmpty()
    repeated = C.write_table(again, f"{path}/repeated")
    names = [f"c{i}" for i in range(len(docs.columns))]
    i_id, i_text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    flat = docs.toDF(*names)

    def kept(batches: Iterator[pa.RecordBatch], twice: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([row_key(i, t) for i, t in zip(batch[i_id].cast(pa.int64()).to_pylist(), C.binary(batch[i_text].cast(pa.string())), strict=True)], np.int64)
            more, _ = repeated.get(keys.view(C.U64))
            if twice:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"]).filter(pa.array(more))
            else:
                yield batch.filter(pa.array(~(gone.get(keys.view(C.U64))[0] | more)))

    out = flat.mapInArrow(C.tidy(lambda batches: kept(batches, False)), flat.schema)
    if some:
        with_key = StructType([*flat.schema, StructField("key", LongType())])
        out = out.unionByName(flat.mapInArrow(C.tidy(lambda batches: kept(batches, True)), with_key).dropDuplicates(["key"]).drop("key"))
    return out.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
