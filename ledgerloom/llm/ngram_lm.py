"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays that workers map into memory.

The order is 2 or 3. Counting: (1) words, combined in each task and in Spark; the sorted table of word hashes gives each word a
number, small for frequent ones. (2) n-grams of word numbers, counted in each task, dealt by a hash of their last two words (so the followers of a frequent
word spread over all files) as compressed differences, and merged file by file. A merge has all that stands before a pair, so it
counts the pair's continuations itself, and deals its n-grams' contexts to the files of those. (3) Sums by word, combined before
they shuffle. Discounts come from the counts of counts, which are a few numbers.

The model: words (hash -> count, probability of continuation, sum and weight as a context), pairs (hash of two numbers -> count,
or continuations, and sum and weight as a context), and, at order 3, triples (hash -> count). Scoring is one map.

A text begins with two ends, which nothing precedes; pairs of an end and a first word count as often as they are there.

Scale: what shuffles is linear in the distinct words and n-grams of each task; no table is held in memory or broadcast, and the
number of files follows the counted tokens. Of n different n-grams any two share a 64-bit hash with a chance of n^2 / 2^65.

Defined results: a null or empty text is the end token alone; rows without doc_id are scored and never learned from; repeated
rows count as often as they are there; extra columns are ignored; with no training rows each score is that of an unknown word
among one (N = V = 0); an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The hash of the end token, which is also the context of the first word; no text has this word, as it holds a space.
END = C.word_hashes([b" end "])[0]
AT_ONCE = 700_000
HALF = C.U64(32)
LOW = C.U64(2**32 - 1)


def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of some rows at a time: the rows' places, their numbers of tokens, and the hashes of all tokens, an end after each row."""
    rows, sizes, parts, total = [], [], [], 0
    for i, text in enumerate(C.binary(batch["text"])):
        words = C.word_hashes((text or b"").lower().split())
        rows.append(i)
        sizes.append(len(words) + 1)
        parts += [words, np.array([END], C.U64)]
        total += len(words) + 1
        if total >= AT_ONCE:
            yield rows, np.array(sizes), np.concatenate(parts)
            rows, sizes, parts, total = [], [], [], 0
    if rows:
        yield rows, np.array(sizes), np.concatenate(parts)


def before(tokens: np.ndarray, sizes: np.ndarray, end) -> np.ndarray:
    """What stands before each token of rows of these sizes; end before the first."""
    out = np.r_[tokens[:1], tokens[:-1]]
    out[np.r_[0, np.cumsum(sizes)[:-1]]] = end
    return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums of counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = firsts(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def grams_of(pair: np.ndarray, first: np.ndarray | None, counts: np.ndarray | None = None) -> tuple:
    """Distinct n-grams in order of their last pair and then their first word, with their counts."""
    if first is None:
        pair, counts = counted(pair, counts)
        return pair, None, counts
    order = np.lexsort((first, pair))
    pair, first = pair[order], first[order]
    starts = firsts(pair, first)
    if counts is None:
        counts = np.diff(np.r_[starts, len(pair)])
    else:
        counts = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return pair[starts], first[starts], counts


# Arrays on their way: differences of sorted keys, bytes of a place together, counts in a byte where they fit.


PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(array: np.ndarray) -> bytes:
    return PACK.compress(array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes())


def released(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(UNPACK.decompress(data), np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def packed(keys: np.ndarray, first: np.ndarray | None, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    big = counts > 254
    parts = squeezed(np.diff(keys, prepend=C.U64(0))), b"" if first is None else squeezed(first), PACK.compress(np.minimum(counts, 255).astype(np.uint8).tobytes()), counts[big].astype(np.int64).tobytes()
    return parts


def unpacked(keys: bytes, first: bytes, counts: bytes, large: bytes) -> tuple:
    out = np.frombuffer(UNPACK.decompress(counts), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return np.cumsum(released(keys, C.U64), dtype=C.U64), released(first, np.uint32) if first else None, out


SENT = "bucket int, keys binary, first binary, counts binary, large binary"


def sent(pair: np.ndarray, first: np.ndarray | None, counts: np.ndarray, bits: int, by: np.ndarray | None = None) -> pa.RecordBatch:
    """Sorted n-grams as a row for each bucket of their pair."""
    bucket = (C.mix(pair if by is None else by) >> C.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pair), np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = [(int(bucket[order[a]]), *packed(pair[o := order[a:b]], None if first is None else first[o], counts[o])) for a, b in C.runs(bucket[order])]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "first", "counts", "large"])


def received(part: pa.Table) -> tuple:
    """The n-grams of a bucket's rows, merged."""
    rows = [unpacked(*r) for r in zip(*(part[c].to_pylist() for c in ("keys", "first", "counts", "large")), strict=True)]
    keys, first, counts = zip(*rows, strict=True)
    return np.concatenate(keys), None if first[0] is None else np.concatenate(first), np.concatenate(counts)


def discounts(n: dict[int, int]) -> list[float]:
    """Discounts for counts of 0, 1, 2 and 3 or more, from the numbers of entries with counts of 1 to 4."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 0.75, 0.75]  # too few entries to tell
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(i - 0.01, max(0.01, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def triple_hash(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(pair) + C.mix(first.astype(C.U64)))


class Small:
    """Sorted hashes with a count each. Of a hash its block, an index into the array, and 32 more bits are kept, so one of 2**28
    unknown keys is taken for another. A count has a byte where it fits; large ones stand apart, with their places."""

    @staticmethod
    def save(name: str, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: sorted, evenly spread 64-bit numbers."""
        bits = max(0, len(keys).bit_length() - 5)
        block, rest = Small.parts(keys, bits)
        big = np.flatnonzero(counts > 254)
        C.save(np.searchsorted(block, np.arange((1 << bits) + 1)).astype(np.uint32), f"{name}-index.npy")
        C.save(np.stack([big, counts[big]]), f"{name}-large.npy")
        C.save(np.minimum(counts, 255).astype(np.uint8), f"{name}-counts.npy")
        C.save(rest, f"{name}-keys.npy")

    @staticmethod
    def parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        block = (keys >> C.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        return block, (keys >> C.U64(32 - bits)).astype(np.uint32)

    def __init__(self, name: str):
        self.keys, self.counts, self.large, self.index = (np.load(f"{name}-{x}.npy", mmap_mode="r") for x in ("keys", "counts", "large", "index"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and their places."""
        block, rest = Small.parts(keys, (len(self.index) - 1).bit_length() - 1)
        low, end = self.index[block].astype(np.int64), self.index[block + 1].astype(np.int64)
        high = end
        while len(self.keys) and (low < high).any():
            middle = np.minimum((low + high) >> 1, len(self.keys) - 1)
            less = self.keys[middle] < rest
            low, high = np.where(less & (low < high), middle + 1, low), np.where(less, high, np.minimum(high, middle))
        hit = np.flatnonzero(low < end)
        hit = hit[self.keys[low[hit]] == rest[hit]]
        return hit, low[hit]

    def at(self, places: np.ndarray) -> np.ndarray:
        out = self.counts[places].astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.large[1][np.searchsorted(self.large[0], places[big])]
        return out


class Pairs(Small):
    """Pairs: their count and, as contexts, the sum of what follows and how much of it has counts of 1, 2, 3 or more.

    A sum of 1 is a bit; of the others four bytes each, or more, apart, where a number is large.
    """

    @staticmethod
    def write(name: str, pairs: np.ndarray, counts: np.ndarray, sums: np.ndarray, classes: np.ndarray) -> None:
        keys = pair_hash(pairs)
        order = np.argsort(keys)
        Small.save(name, keys[order], counts[order])
        sums, classes = sums[order], classes[:, order]
        more = np.flatnonzero(sums > 1)
        about = np.concatenate([sums[None, more], classes[:, more]])
        wide = np.flatnonzero((about > 254).any(axis=0))
        C.save(np.packbits(sums == 1), f"{name}-once.npy")
        C.save(more.astype(np.uint32), f"{name}-more.npy")
        C.save(np.minimum(about, 255).astype(np.uint8), f"{name}-about.npy")
        C.save(np.concatenate([wide[None], about[:, wide]]), f"{name}-wide.npy")

    def __init__(self, name: str):
        super().__init__(name)
        self.once, self.more, self.about, self.wide = (np.load(f"{name}-{x}.npy", mmap_mode="r") for x in ("once", "more", "about", "wide"))

    def context(self, places: np.ndarray) -> np.ndarray:
        """Sums and the numbers of counts, as four rows."""
        out = np.zeros((4, len(places)), np.int64)
        out[:2] = self.once[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1
        if len(self.more):
            at = np.minimum(np.searchsorted(self.more, places), len(self.more) - 1)
            hit = np.flatnonzero(self.more[at] == places)
            at = at[hit]
            found = self.about[:, at].astype(np.int64)
            big = np.flatnonzero((found == 255).any(axis=0))
            found[:, big] = self.wide[1:, np.searchsorted(self.wide[0], at[big])]
            out[:, hit] = found
        return out


def pair_hash(pairs: np.ndarray) -> np.ndarray:
    """A hash that doesn't follow from a pair's bucket."""
    return C.mix(C.mix(pairs) ^ C.MIX_A)


class Model:
    """Where the tables are, and the constants. discount: lists by order."""

    def __init__(self, path: str, bits: int, order: int, total: int, distinct: int, unknown: float, discount: dict[int, list[float]], words: C.Table, there: np.ndarray):
        self.path, self.bits, self.order, self.total, self.distinct, self.unknown, self.discount, self.words, self.there = path, bits, order, total, distinct, unknown, discount, words, there
        self.files: dict[tuple[str, int], Small] = {}

    def __getstate__(self):
        return self.path, self.bits, self.order, self.total, self.distinct, self.unknown, self.discount, self.words, self.there

    def __setstate__(self, state):
        self.__init__(*state)

    def file(self, kind: str, bucket: int) -> Small:
        if (kind, bucket) not in self.files:
            self.files[kind, bucket] = (Pairs if kind == "pairs" else Small)(f"{self.path}/{kind}/{bucket:05d}")
        return self.files[kind, bucket]

    def by_bucket(self, mixed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets that there are, and the places of the keys that belong to each, in their order."""
        order = np.argsort(mixed)
        for a, b in C.runs((mixed[order] >> C.U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(mixed), np.int64)):
            bucket = int(mixed[order[a]] >> C.U64(64 - self.bits)) if self.bits else 0
            if self.there[bucket]:
                yield bucket, order[a:b]

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of pairs, and their sums and weights as contexts; 0 for unknown ones."""
        count, sums, left = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for bucket, own in self.by_bucket(C.mix(keys)):
            file = self.file("pairs", bucket)
            hit, at = file.find(pair_hash(keys[own]))
            count[own[hit]] = file.at(at)
            if self.order == 3:
                about = file.context(at)
                sums[own[hit]], left[own[hit]] = about[0], np.array(self.discount[3][1:]) @ about[1:]
        return count, sums, left

    def triples(self, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        count, mixed, keys = np.zeros(len(pair), np.int64), C.mix(pair), triple_hash(pair, first)
        for bucket, own in self.by_bucket(mixed):
            file = self.file("triples", bucket)
            hit, at = file.find(keys[own])
            count[own[hit]] = file.at(at)
        return count


def count_words(texts: DataFrame) -> DataFrame:
    @C.tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, hashes in tokens_of(batch):
                held.append(counted(hashes))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > 1_500_000:
                        yield pa.RecordBatch.from_pydict({"word": pa.array(held[0][0].view(np.int64)), "c": pa.array(held[0][1])})
                        held = []
        if held:
            k, c = counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield pa.RecordBatch.from_pydict({"word": pa.array(k.view(np.int64)), "c": pa.array(c)})

    return texts.mapInArrow(words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, path: str, order: int = 3) -> Model:
    """Counts the texts (column ``text``) and writes the model below path."""
    if order not in (2, 3):
        raise ValueError(f"the order is 2 or 3, not {order}")
    spark = texts.sparkSession

    # 1. words
    vocabulary = C.store(count_words(texts), f"{path}/vocabulary")
    n = vocabulary.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = n.total or 0, n.distinct or 0
    numbers = numbered(vocabulary, f"{path}/known", distinct)
    bits = C.table_bits(spark, total)

    # 2. n-grams
    @C.tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def all_held() -> tuple:
            pair, first, counts = zip(*held, strict=True)
            held.clear()
            return grams_of(np.concatenate(pair), None if order == 2 else np.concatenate(first), np.concatenate(counts))

        end = numbers.get(np.array([END]))[0]
        for batch in batches:
            for _, sizes, hashes in tokens_of(batch):
                ids = numbers.get(hashes)
                left = before(ids, sizes, end)
                pair = (left.astype(C.U64) << HALF) | ids.astype(C.U64)
                held.append(grams_of(pair, None if order == 2 else before(left, sizes, end).astype(np.uint32)))
                if sum(len(x[0]) for x in held) > 2_500_000:
                    yield sent(*all_held(), bits)
        if held:
            yield sent(*all_held(), bits)

    for kind in ("pairs", "triples", "continued"):
        os.makedirs(f"{path}/{kind}")
    end = int(numbers.get(np.array([END]))[0])

    def merge(part: pa.Table) -> pa.Table:
        """Writes the triples of a bucket, and what continues its pairs; sends the triples' contexts to their buckets."""
        bucket = part["bucket"][0].as_py()
        pair, first, counts = grams_of(*received(part))
        hashes = triple_hash(pair, first)
        by = np.argsort(hashes)
        Small.save(f"{path}/triples/{bucket:05d}", hashes[by], counts[by])
        # an end before an end is where a text begins: such pairs have their own count
        times = np.where((first == end) & (pair >> HALF == C.U64(end)), counts, 1)
        starts = firsts(pair)
        for name, data in zip(("keys", "first", "counts", "large"), packed(pair[starts], None, np.add.reduceat(times, starts)), strict=True):
            C.save(np.frombuffer(data, np.uint8), f"{path}/continued/{bucket:05d}-{name}.npy")
        context = (first.astype(C.U64) << HALF) | (pair >> HALF)
        by = np.argsort(context, kind="stable")
        away = sent(context[by], None, counts[by], bits)
        mark = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, *packed(np.empty(0, C.U64), None, np.empty(0, np.int64))), away.schema.types, strict=True)], schema=away.schema)
        return pa.Table.from_batches([away, mark]).append_column("own", pa.array([False] * len(away) + [True]))

    def settle(part: pa.Table) -> pa.Table:
        """Writes the pairs of a bucket: how often they continue, and what follows them.

        Returns sums: of pairs by their first word and count (1, 2, 3 or more), by their second word, and by count (kinds 0 to 2);
        of triples by count (3); the bucket (4); and counts of 3 and more by the first word (5).
        """
        bucket = part["bucket"][0].as_py()
        keys, _, counts = received(part)
        levels = np.zeros(6, np.int64)
        if order == 2:
            keys, counts = counted(keys, counts)
            about = np.zeros((4, len(keys)), np.int64)
        else:
            by = np.argsort(keys)
            contexts, follow = keys[by], counts[by]
            levels = np.bincount(np.minimum(follow, 5), minlength=6)
            starts = firsts(contexts)
            keys, counts = own_pairs(bucket, part)
            every = np.union1d(contexts[starts], keys)
            about, wide = np.zeros((4, len(every)), np.int64), np.zeros(len(every), np.int64)
            at = np.searchsorted(every, contexts[starts])
            for i, x in enumerate((follow, follow == 1, follow == 2, follow > 2)):
                about[i, at] = np.add.reduceat(x.astype(np.int64), starts) if len(starts) else 0
            wide[np.searchsorted(every, keys)] = counts
            keys, counts = every, wide
        Pairs.write(f"{path}/pairs/{bucket:05d}", keys, counts, about[0], about[1:])
        keys, counts = keys[counts > 0], counts[counts > 0]
        code, n = np.unique((keys >> HALF).astype(np.int64) * 4 + np.minimum(counts, 3), return_counts=True)
        often = np.flatnonzero(counts > 2)
        many, back = np.unique((keys[often] >> HALF).astype(np.int64), return_inverse=True)
        w, f = np.unique((keys & LOW).astype(np.int64), return_counts=True)
        m, q = np.unique(np.minimum(counts, 5), return_counts=True)
        sums = [(code, n), (w, f), (m, q), (np.arange(6), levels), (np.array([bucket]), np.ones(1)), (many, np.bincount(back, counts[often], len(many)))]
        column = lambda i: pa.array(np.concatenate([np.asarray(x[i]).astype(np.int64) for x in sums]))
        return pa.table({"kind": pa.array(np.repeat(np.arange(6, dtype=np.int32), [len(x[0]) for x in sums])), "k": column(0), "c": column(1)})

    def own_pairs(bucket: int, part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that merge() has written for this bucket; a mark among its rows says if it had any."""
        if not any(part["own"].to_pylist()):
            return np.empty(0, C.U64), np.empty(0, np.int64)
        keys, _, counts = unpacked(*(np.load(f"{path}/continued/{bucket:05d}-{x}.npy").tobytes() for x in ("keys", "first", "counts", "large")))
        return keys, counts

    dealt = texts.mapInArrow(deal, SENT)
    parts = max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if order == 3:
        dealt = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(merge, f"{SENT}, own boolean")
    settled = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(settle, "kind int, k long, c long")
    # 3. sums by word, and counts of counts
    parts_ = C.store(settled.groupBy("kind", "k").agg(F.sum("c").alias("c")), f"{path}/parts")
    there = np.zeros(1 << bits, bool)
    there[[r.k for r in parts_.filter("kind = 4").collect()]] = True
    C.discard(f"{path}/continued")
    discount = {2: discounts({r.k: r.c for r in parts_.filter("kind = 2").collect()})}
    if order == 3:
        discount[3] = discounts({r.k: r.c for r in parts_.filter("kind = 3").collect()})
    followers = parts_.filter("kind = 1").select(F.col("k").alias("id"), F.col("c").alias("f"))
    level = {r.k: r.n for r in followers.filter("f <= 4").groupBy(F.col("f").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    one = lambda i: F.count_if(F.col("f") == i if i < 3 else F.col("f") > 2)
    kinds = followers.agg(F.sum("f").alias("pairs"), *(one(i).alias(f"n{i}") for i in (1, 2, 3))).first()
    d1 = discount[1] = discounts(level)
    pairs_total = kinds.pairs or 1
    free = sum(d1[i] * kinds[f"n{i}"] for i in (1, 2, 3)) / pairs_total if kinds.pairs else 1.0
    unknown = free / (distinct + 1)

    # 4. the model's words
    often = F.col("kind") == 5
    worth = F.when(~often, F.element_at(F.array(*(F.lit(x) for x in discount[2])), (F.col("k") % 4 + 1).cast("int")) * F.col("c"))
    times = F.when(often, F.col("c")).when(F.col("k") % 4 < 3, F.col("k") % 4 * F.col("c"))
    by_first = parts_.filter("kind IN (0, 5)").groupBy(F.when(often, F.col("k")).otherwise(F.shiftright("k", 2)).alias("id"))
    contexts = by_first.agg(F.sum(worth).alias("left"), F.sum(times).alias("sum"))
    ids = known_numbers(vocabulary, numbers).join(followers, "id", "left").join(contexts, "id", "left")
    taken = F.when(F.col("f") == 1, d1[1]).when(F.col("f") == 2, d1[2]).otherwise(d1[3])
    continued = F.when(F.col("f").isNull(), F.lit(unknown)).otherwise((F.col("f") - taken) / pairs_total + unknown)
    words = C.write_table(ids.select("word", "id", "c", continued.alias("p"), F.coalesce("sum", F.lit(0)).alias("sum"), F.coalesce(F.col("left") / F.col("sum"), F.lit(1.0)).alias("left")), f"{path}/words", distinct)
    for name in ("known", "vocabulary", "parts"):
        C.discard(f"{path}/{name}")
    return Model(path, bits, order, total, distinct, unknown, discount, words, there)


class Numbers:
    """The number of each word, the first value of a table."""

    def __init__(self, table: C.Table):
        self.table = table

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 0; -1 for unknown words."""
        distinct, back = np.unique(hashes, return_inverse=True)
        found, (out, *_) = self.table.get(distinct)
        return np.where(found, out, -1)[back]


def numbered(vocabulary: DataFrame, path: str, distinct: int) -> Numbers:
    """Numbers the words (word, c): by powers of two of their counts, the largest first, then by file and place."""
    os.makedirs(path)
    bits = C.table_bits(vocabulary.sparkSession, distinct)
    level = F.length(F.bin("c"))
    rows = vocabulary.select("word", level.alias("level"), C.bucket_of(F.col("word"), bits).alias("bucket"))
    sizes = sorted((-r.level, r.bucket, r.n) for r in rows.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # 63 a file at most
    base = dict(zip([(-a, b) for a, b, _ in sizes], np.cumsum([0, *(n for *_, n in sizes)]).tolist(), strict=False))

    def put(part: pa.Table) -> pa.Table:
        bucket, word, own = part["bucket"][0].as_py(), C.longs(part["word"].combine_chunks()), C.longs(part["level"].combine_chunks())
        order = np.argsort(word.view(C.U64))
        word, own = word[order], own[order]
        numbers, by = np.empty(len(word), np.int64), np.argsort(own, kind="stable")
        for a, b in C.runs(own[by]):
            numbers[by[a:b]] = base[int(own[by[a]]), bucket] + np.arange(b - a)
        C.save(np.stack([word, numbers]), f"{path}/{bucket:05d}.npy")
        return C.only(bucket)

    return Numbers(C.Table(path, bits, 1, C.per_bucket(rows, bits, put)))


def known_numbers(vocabulary: DataFrame, numbers: Numbers) -> DataFrame:
    """word, c and id of the vocabulary."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(numbers.get(C.longs(batch["word"]).view(C.U64)))], names=["word", "c", "id"])

    return vocabulary.mapInArrow(run, "word long, c long, id long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = {k: np.array(v) for k, v in model.discount.items()}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, sizes, hashes in tokens_of(batch):
                distinct, back = np.unique(hashes, return_inverse=True)
                found, (ids, count, p, total, left) = model.words.get(distinct)
                end = np.searchsorted(distinct, END)
                prob = np.where(found, p.view(np.float64), model.unknown)
                weight = np.where(found & (total > 0), left.view(np.float64), 1.0)
                base = np.log10((count + 1) / (model.total + model.distinct + 1))
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                prev = before(back, sizes, end)
                score = weight[prev] * prob[back]
                both = np.flatnonzero(found[prev] & found[back])
                keys = (ids[prev[both]].astype(C.U64) << HALF) | ids[back[both]].astype(C.U64)
                c, sums, rest = model.pairs(keys)
                score[both] += np.where(c > 0, (c - cut[2][np.minimum(c, 3)]) / np.maximum(total[prev[both]], 1), 0.0)
                if model.order == 3:
                    # what a pair says as a context holds for the token behind it; a text begins after two ends
                    about = np.zeros((2, len(hashes)))
                    about[:, both] = sums, rest
                    about = np.stack([before(x, sizes, 0.0) for x in about])
                    if found[end]:
                        _, s, r = model.pairs(np.array([(int(ids[end]) << 32) | int(ids[end])], C.U64))
                        about[:, starts] = np.stack([s, r])
                    context = about[0] > 0
                    score[context] *= about[1][context] / about[0][context]
                    all_known = both[context[both]]
                    older = before(prev, sizes, end)
                    c = model.triples((ids[prev[all_known]].astype(C.U64) << HALF) | ids[back[all_known]].astype(C.U64), ids[older[all_known]])
                    score[all_known] += np.where(c > 0, (c - cut[3][np.minimum(c, 3)]) / about[0][all_known], 0.0)
                score = np.log10(score)
                for x, y in zip(out, (sizes, np.add.reduceat(found[back].astype(np.int64), starts), np.add.reduceat(base[back], starts), np.add.reduceat(score, starts)), strict=True):
                    x.append(y)
            columns = [np.concatenate(x) if x else np.empty(0) for x in out]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    path = C.workspace(spark, "lm")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")), path)
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
