"""Plumbing that the operators share: the shared folder, word hashes, sorted memory-mapped tables and twin Bloom filters.

Large lookups (repeated lines, n-gram counts, set fingerprints) are kept neither in a broadcast nor in a join with hot keys.
A Spark job writes them once, as sorted arrays dealt over files by the top bits of a hash, into the folder that the cluster
names in ``spark.checkpoint.dir``; Python workers map these files into memory and look keys up by binary search. The files
are written under a temporary name and then renamed, so a task that runs twice leaves the same table.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import math
import os
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.shipping import ship

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


UNMIX_A, UNMIX_B = U64(pow(int(MIX_A), -1, 2**64)), U64(pow(int(MIX_B), -1, 2**64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31)) ^ (x >> U64(62))) * UNMIX_B
        x = (x ^ (x >> U64(27)) ^ (x >> U64(54))) * UNMIX_A
        return x ^ (x >> U64(30)) ^ (x >> U64(60))


#: Rows that go to a Python worker at once: with long texts, Spark's own default makes large batches.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, and makes Arrow batches smaller unless the session has its own setting."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def tidy(f: Callable) -> Callable:
    """f, a function for mapInArrow, that gives freed memory back when a task ends; workers live on, and other tasks need it."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The names of an operator's own columns: as wanted, with a _ behind those that the input has already (case is ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def place_of(df: DataFrame, name: str) -> int:
    """Where the column of this exact name is, the first if there are several."""
    return df.columns.index(name)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a local path. Where that is unset, as in tests, it is below a temporary one,
    which only a session of one machine may use.

    Workers map files of this folder into memory, so it has to be a file system that all machines mount.
    """
    prepare(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all machines mount")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    at = urlparse(root)
    if at.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a folder that all machines mount, as a path or file://; it is {root}")
    path = os.path.join(at.path, f"{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def store(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet into a shared folder and reads it again: this cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(f"file://{path}")
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{path}")


def discard(path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    shutil.rmtree(path, ignore_errors=True)


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def longs(column: pa.Array) -> np.ndarray:
    """An Arrow column of integers without nulls."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def whole(column: pa.ChunkedArray) -> np.ndarray:
    """A column of integers, or of doubles as their bits."""
    column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).view(np.int64) if pa.types.is_floating(column.type) else longs(column)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, given the hashes of the words; n = 1 or more, at least n words."""
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for j in range(1, n):
            out *= U64(0x9E3779B97F4A7C15)
            out += hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


#: Rows that a file of a table holds, about.
FILE_ROWS = 2_000_000


def table_bits(spark: SparkSession, rows: int = 0) -> int:
    """Files of a table, as a power of two: one for each shuffle partition, and more where they would hold over FILE_ROWS rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(16, max(0, math.ceil(math.log2(parts)), (rows // FILE_ROWS).bit_length()))


def bucket_of(key, bits: int):
    """The column of a key's file: its top bits."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def per_bucket(df: DataFrame, bits: int, put: Callable[[pa.Table], pa.Table]) -> np.ndarray:
    """Runs put, which writes a file and returns its ``bucket``, on the rows of each bucket; a flag for each that has rows.

    One bucket of a partition after the other is held by a task. The flags are at most 2**16.
    """
    parts = max(1 << bits, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    there = np.zeros(1 << bits, bool)
    for r in df.repartition(parts, "bucket").groupBy("bucket").applyInArrow(put, "bucket int").collect():
        there[r.bucket] = True
    return there


def only(bucket: int) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket], pa.int32())})


class Table:
    """A sorted table in the shared folder: key (64 bits, evenly spread) -> values (64-bit integers). Picklable; workers map it.

    there: which of its files exist. A file that is in the list and not in the folder is an error, never an empty file.
    """

    def __init__(self, path: str, bits: int, width: int, there: np.ndarray):
        self.path, self.bits, self.width, self.there, self.files = path, bits, width, there, {}

    def __getstate__(self):
        return self.path, self.bits, self.width, self.there

    def __setstate__(self, state):
        self.__init__(*state)

    def file(self, bucket: int) -> np.ndarray | None:
        if bucket not in self.files:
            self.files[bucket] = np.load(f"{self.path}/{bucket:05d}.npy", mmap_mode="r") if self.there[bucket] else None
        return self.files[bucket]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each key: whether the table has it, and its values (0 where it hasn't)."""
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(self.width)]
        if not len(keys):
            return found, out
        order = np.argsort(keys)
        ordered = keys[order]
        tops = (ordered >> U64(64 - self.bits)) if self.bits else np.zeros(len(keys), U64)
        starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            if (data := self.file(int(tops[a]))) is None or not data.shape[1]:
                continue
            have = data[0].view(U64)
            at = np.searchsorted(have, ordered[a:b])
            hit = np.flatnonzero(have[np.minimum(at, len(have) - 1)] == ordered[a:b])
            where = order[a:b][hit]
            found[where] = True
            for v in range(self.width):
                out[v][where] = data[1 + v][at[hit]]
        return found, out


def save(array: np.ndarray, name: str) -> None:
    """Writes a file of a table, under a temporary name first."""
    part = f"{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, name)


def write_table(df: DataFrame, path: str, rows: int = 0) -> Table:
    """Writes df, whose first column is an evenly spread 64-bit key without repeats and the others are long or double, as a Table.

    rows: how many there are, where that is known; it sets the number of files.
    """
    os.makedirs(path, exist_ok=True)
    bits, names = table_bits(df.sparkSession, rows), df.columns

    def put(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        rows = np.stack([whole(group[c]) for c in names])
        save(rows[:, np.argsort(rows[0].view(U64))], f"{path}/{bucket:05d}.npy")
        return only(bucket)

    return Table(path, bits, len(names) - 1, per_bucket(df.withColumn("bucket", bucket_of(F.col(names[0]), bits)), bits, put))


class Twice:
    """The filter of hashes seen twice, made by twin Bloom filters; workers map it from the shared folder.

    there: which of its segments have a file; the others have no bit. A listed file that is missing is an error.
    """

    def __init__(self, path: str, bits: int, there: np.ndarray):
        self.path, self.bits, self.there, self.data = path, bits, there, None

    def __getstate__(self):
        return self.path, self.bits, self.there

    def __setstate__(self, state):
        self.__init__(*state)

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.data is None:
            step = 1 << (SEGMENT_BITS - 3)
            data = np.zeros(len(self.there) * step, np.uint8)
            for s in np.flatnonzero(self.there).tolist():
                data[s * step : (s + 1) * step] = np.load(f"{self.path}/{s:05d}.npy", mmap_mode="r")
            self.data = data
        return has_bits(self.data, keys, self.bits)


SEGMENT_BITS = 20


def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return keys >> U64(64 - bits), (keys * MIX_A) >> U64(64 - bits)


def has_bits(data: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for p in places(keys, bits):
        out &= (data[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return out


def put_bits(data: np.ndarray, keys: np.ndarray, bits: int) -> None:
    for p in places(keys, bits):
        np.bitwise_or.at(data, p >> U64(3), np.uint8(1) << (p & U64(7)).astype(np.uint8))


#: Bits of the largest filter: 128 MB, of which a task holds two.
MOST_BITS = 30


def filter_bits(keys: int) -> int:
    """Bits of a filter, as a power of two: 8 or more for each key, up to MOST_BITS."""
    return min(MOST_BITS, max(SEGMENT_BITS, (8 * max(1, keys) - 1).bit_length()))


def twice_seen(df: DataFrame, keys_of, path: str, bits: int) -> Twice:
    """Twin Bloom filters over all rows of df; keys_of(batch) gives the 64-bit keys of an Arrow batch, as arrays.

    Each task fills a once-seen filter and, with what it finds there already, a twice-seen filter. Tasks send the segments of
    both, compressed; a segment's filters are merged one by one: seen twice is what any task has seen twice, or two tasks once.
    bits: see filter_bits(). Beyond 2**MOST_BITS / 8 keys more and more single keys pass, which the exact step behind sorts out.
    """
    os.makedirs(path, exist_ok=True)
    step = 1 << (SEGMENT_BITS - 3)

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, some = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8), False
        for batch in batches:
            for keys in keys_of(batch):
                if not len(keys):
                    continue
                some = True
                keys, counts = np.unique(keys, return_counts=True)
                put_bits(twice, keys[(counts > 1) | has_bits(once, keys, bits)], bits)
                put_bits(once, keys, bits)
        if some:
            for s in range(1 << (bits - SEGMENT_BITS)):
                a, b = once[s * step : (s + 1) * step], twice[s * step : (s + 1) * step]
                if a.any():
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": pa.array([zlib.compress(a, 1)], pa.binary()), "twice": pa.array([zlib.compress(b, 1)], pa.binary())})

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(batch[c].to_pylist() for c in ("segment", "once", "twice")), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (a, b))
                if s in held:
                    held[s][1] |= b | (held[s][0] & a)
                    held[s][0] |= a
                else:
                    held[s] = [a, b]
        for s, (_, b) in held.items():
            save(b, f"{path}/{s:05d}.npy")
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.int32())})

    n = max(1, min(1 << (bits - SEGMENT_BITS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = df.mapInArrow(fill, "segment int, once binary, twice binary").repartition(n, "segment")
    there = np.zeros(1 << (bits - SEGMENT_BITS), bool)
    for r in parts.mapInArrow(merge, "segment int").collect():  # at most 2**(bits - SEGMENT_BITS) numbers
        there[r.segment] = True
    return Twice(path, bits, there)
