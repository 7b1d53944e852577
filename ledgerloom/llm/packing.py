"""Sum-of-squares packing of tokenised documents into windows of a fixed capacity.

Scale: one map over the documents, no shuffle. Each task packs the documents of its own partition and keeps nothing but a level
array (the number of open windows at each fill level) and the pieces in its open windows, of which there are at most max_open.
Whole windows of long documents are cut off at once; only what remains of a document is placed.

Defined results: a null or empty text is the end id alone; a row without doc_id is packed like the others; repeated rows are
packed once each; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common as C

#: A vocabulary, and the same as ranks: the ids are equal, and pieces of words are merged faster.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A space inside a run of white space: there a text can't be cut before the space without changing the ids.
RUN = re.compile(r" (?=\s|\Z)(?<=\s )")
#: White space so long that the encoder of ranks, whose pattern goes back over it step by step, may run out of stack.
LONG = re.compile(r"\s{10000}")


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers; pieces between spaces are remembered, up to a number of them.

    Texts with very long white space go to the tokenizer of the vocabulary itself.
    """

    def __init__(self, ranks: str, vocabulary: str, remembered: int = 200_000):
        self.vocabulary, self.tokenizer = vocabulary, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.spaced = np.zeros(max(table.values()) + 1, bool)
        self.spaced[[i for x, i in table.items() if x[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}
        self.most = remembered

    def plain(self, text: str) -> bytes:
        if LONG.search(text):
            self.tokenizer = self.tokenizer or Tokenizer.from_file(self.vocabulary)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return np.array(self.bpe.encode_ordinary(text), np.uint32).tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces with a space before them; those without white space at an end are encoded as one text."""
        even = [p for p in pieces if p and p == p.strip()]
        new = {p: self.plain(f" {p}") for p in pieces if not p or p != p.strip()}
        if even:
            ids = np.array(self.bpe.encode_ordinary(" " + " ".join(even)), np.uint32)
            cuts = np.flatnonzero(self.spaced[ids]) * 4
            data, ends = ids.tobytes(), [*cuts[1:].tolist(), 4 * len(ids)]
            new.update((p, data[a:b]) for p, a, b in zip(even, cuts.tolist(), ends, strict=True))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        if len(new) <= self.most:
            self.known.update(x for x in new.items() if len(x[0]) <= 64)
        return new

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.uint32(SPECIAL_ID).tobytes().join(map(self.encode, text.split(SPECIAL)))
        if RUN.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        found = list(map(self.known.get, rest))
        if None in found:
            new = self.learn({p for p, ids in zip(rest, found, strict=True) if ids is None})
            found = [new[p] if ids is None else ids for p, ids in zip(rest, found, strict=True)]
        return (self.plain(first) if first else b"") + b"".join(found)


class SumOfSquares:
    """Online packing of items shorter than a window. Pieces are tuples (doc, start, ids), ids as bytes."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def place(self, size: int) -> int:
        """The fill level that an item joins, 0 for a new window: the one after which the squares of the counts sum to least.

        Of equal ones, the fullest; an open window before a new one.
        """
        cap, n = self.capacity, self.level
        cost = 2 * (n[1 + size :] - n[1 : cap - size + 1]) + 2
        cost[-1:] -= 1  # a window that gets full leaves the counts
        cost[n[1 : cap - size + 1] == 0] = np.iinfo(np.int64).max
        if len(cost) and cost[h := len(cost) - 1 - int(np.argmin(cost[::-1]))] <= 2 * n[size] + 1:
            return h + 1
        return 0

    def add(self, piece: tuple) -> list[list[tuple]]:
        """Windows that are complete now."""
        size = len(piece[2]) // 4
        h = self.place(size)
        window = self.windows[h].pop() if h else []
        window.append(piece)
        self.n_open += (not h) - (h + size == self.capacity)
        self.level[h] -= h > 0
        if h + size == self.capacity:
            return [window]
        self.level[h + size] += 1
        self.windows[h + size].append(window)
        return self.settle(whole=True) if self.n_open > self.max_open else []

    def settle(self, whole: bool = False) -> list[list[tuple]]:
        """Closes all windows: the fullest are filled up with what the emptiest hold, which is cut where they are full.

        What is left in the end is cut into lengths that are powers of two, or, with whole, stays open.
        """
        left = [w for ws in self.windows[::-1] for w in ws]
        self.windows, self.n_open = [[] for _ in range(self.capacity)], 0
        self.level[:] = 0
        out: list[list[tuple]] = []
        i, j, window, room = 0, len(left) - 1, [], self.capacity
        while i <= j:
            window = left[i]
            room = self.capacity - sum(len(p[2]) for p in window) // 4
            while room and i < j:
                doc, start, ids = left[j].pop()
                window.append((doc, start, ids[: 4 * room]))
                if len(ids) > 4 * room:
                    left[j].append((doc, start + room, ids[4 * room :]))
                room -= len(window[-1][2]) // 4
                j -= not left[j]
            i += 1
            if not room:
                out.append(window)
                window = []
        if window and whole:
            fill = self.capacity - room
            self.windows[fill], self.n_open = [window], 1
            self.level[fill] = 1
        elif window:
            out += powers_of_two(window)
        return out


def powers_of_two(window: list[tuple]) -> list[list[tuple]]:
    """A window's pieces as windows whose lengths are powers of two, the longest first."""
    total = sum(len(ids) for _, _, ids in window) // 4
    out = []
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            part, room = [], 1 << bit
            while room:
                doc, start, ids = window[0]
                part.append((doc, start, ids[: 4 * room]))
                took = min(room, len(ids) // 4)
                window[:1] = [(doc, start + took, ids[4 * took :])] if 4 * took < len(ids) else []
                room -= took
            out.append(part)
    return out


def pack(docs: DataFrame, capacity: int = 1024, ranks: str | None = None, vocabulary: str | None = None, end_id: int = 0, max_open: int = 2048) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    ranks and vocabulary are files of one tokenizer; without them, those of a public one. A document is the ids of its text and end_id. A sequence is full, or its length is a power of two: there is no padding.
    Windows that sum-of-squares packing leaves open at a partition's end are merged, cutting pieces where a window is full.
    """
    ranks, vocabulary = ranks or public_tokenizers.path(RANKS), vocabulary or public_tokenizers.path(VOCABULARY)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, serial = Encoder(ranks, vocabulary), SumOfSquares(capacity, max_open), [TaskContext.get().partitionId() << 40]
        end, step = np.uint32(end_id).tobytes(), 4 * capacity

        def rows(windows: list[list[tuple]]) -> Iterator[tuple]:
            for window in windows:
                offset = 0
                for (doc_id, tokens), start, ids in window:
                    yield doc_id, start, len(ids) // 4, ids, tokens, serial[0], offset
                    offset += len(ids) // 4
                serial[0] += 1

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

        found: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                doc = doc_id, len(ids) // 4
                whole = len(ids) - len(ids) % step
                found += rows([[(doc, a // 4, ids[a : a + step])] for a in range(0, whole, step)])
                if whole < len(ids):
                    found += rows(packer.add((doc, whole // 4, ids[whole:])))
                if len(found) > 5000:
                    yield batch_of(found)
                    found = []
        yield batch_of(found + list(rows(packer.settle())))

    C.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def query(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
