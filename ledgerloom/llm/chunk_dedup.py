"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where it matches a mask (on average every `average` bytes) within least and
most sizes, so that chunk borders depend on the last 16 bytes alone and fall into step again after an insertion. Chunks are
compared by digest. A chunk is a repeat if an earlier place has it: a smaller doc_id, or an earlier place of the same document.
Each repeated chunk is then extended byte by byte, as far as the text around it is that around its first place. What is covered
goes where it holds at least min_words words or min_chars characters (texts without spaces); the rest stays, as it is phrases
that texts share by chance. A repeated passage is missed where it holds no whole common chunk, or all its chunks occur still
earlier in other company.

Scale: four scans of the texts, each a map, and one that only measures them to size the filters. Twin Bloom filters pick the digests seen twice; only those shuffle, as 16-byte
digests with their place, combined before the shuffle, so a passage in a third of all documents costs each task a row a chunk.
First places go into a sorted table that workers map into memory, and so do the texts that hold one, each once.

Defined results: a null or empty text has no chunks; a row without doc_id counts as later than all others; different texts of
one doc_id, or of none, go by their digests, and equal ones hold the same first place, so all keep it; no cut splits a
character; extra columns pass through, and an own column whose name is taken gets a _ behind it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common as C

#: A random 16-bit number for each byte.
GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)
LAST = 2**63 - 1


def borders(text: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of a text's chunks."""
    size = len(text)
    if size <= least:
        return [size] if size else []
    data = np.frombuffer(text, np.uint8)
    rolled = GEAR[data]
    for step in (1, 2, 4, 8):  # after these, the sum over the last 16 bytes, each shifted by its distance
        shifted = rolled[:-step] << np.uint16(step) if size > step else rolled[:0]
        rolled = rolled.copy()
        rolled[step:] += shifted
    bits = max(1, average - least).bit_length() - 1
    ends = np.flatnonzero(rolled[:-1] >> np.uint16(16 - bits) == 0) + 1
    if not text.isascii():  # a match within a character counts at its end, else there'd be few in scripts of several bytes
        starts = np.r_[np.flatnonzero((data & 0xC0) != 0x80), size]
        ends = np.unique(starts[np.searchsorted(starts, ends)])
        ends = ends[ends < size]
    out, start, found = [], 0, ends.tolist()
    for end in [*found, size]:
        if end - start < least and end < size:
            continue
        while end - start > most:
            cut = start + most
            while cut > start + 1 and cut < size and text[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            start = cut
        if end - start >= least or end == size and end > start:
            out.append(end)
            start = end
    return out


def digests(text: bytes, ends: list[int]) -> np.ndarray:
    starts = [0, *ends[:-1]]
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts, ends, strict=True)]), C.U64).reshape(-1, 2)


def name_of(doc: int, text: bytes) -> int:
    """A document's key: its text's digest, seeded by its doc_id; as a signed number."""
    return xxhash.xxh3_64_intdigest(text, doc & (2**64 - 1)) - 2**63


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    most = min(len(a), len(b))
    at, step = 0, 64
    while at < most and a[at : (end := min(most, at + step))] == b[at:end]:
        at, step = end, 2 * step
    if at == most:
        return most
    end = min(most, at + step)
    differ = int.from_bytes(a[at:end], "little") ^ int.from_bytes(b[at:end], "little")
    return at + ((differ & -differ).bit_length() - 1) // 8


#: Bytes that are compared at once.
STRIDE = 4096
#: Bytes of first texts that a task holds.
KNOWN = 1_000_000


def extended(text: bytes, a: int, b: int, other: bytes, at: int) -> tuple[int, int]:
    """text[a:b], which equals other[at:at + b - a], as far as both texts agree around it; borders of characters."""
    while a > 0 and at > 0:
        n = min(a, at, STRIDE)
        same = agreeing(text[a - n : a][::-1], other[at - n : at][::-1])
        a, at = a - same, at - same
        if same < n:
            break
    b_at = at + b - a
    while b < len(text) and b_at < len(other):
        n = min(len(text) - b, len(other) - b_at, STRIDE)
        same = agreeing(text[b : b + n], other[b_at : b_at + n])
        b, b_at = b + same, b_at + same
        if same < n:
            break
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


class Texts:
    """Texts by their key, in the shared folder."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.files = path, bits, {}

    def __getstate__(self):
        return self.path, self.bits

    def __setstate__(self, state):
        self.__init__(*state)

    def get(self, key: int) -> bytes:
        wanted = C.U64(key & (2**64 - 1))
        bucket = int(wanted >> C.U64(64 - self.bits)) if self.bits else 0
        if bucket not in self.files:
            self.files[bucket] = np.load(f"{self.path}/{bucket:05d}-index.npy", mmap_mode="r"), np.load(f"{self.path}/{bucket:05d}-bytes.npy", mmap_mode="r")
        index, data = self.files[bucket]
        i = int(np.searchsorted(index[0].view(C.U64), wanted))
        return data[index[1, i] : index[2, i]].tobytes()


def dedup_chunks(docs: DataFrame, least: int = 12, average: int = 44, most: int = 96, min_words: int = 16, min_chars: int = 100) -> DataFrame:
    """docs with repeated passages taken out of ``text``, and ``n_chunks``, ``n_repeated`` (chunks), ``n_dropped`` (characters)
    and ``spans`` (the dropped passages' first characters and those after their last, in the text as it was)."""
    path = C.workspace(docs.sparkSession, "chunks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def marks(text: bytes | None) -> tuple[list[int], np.ndarray]:
        ends = borders(text or b"", least, average, most)
        return ends, digests(text, ends) if ends else np.empty((0, 2), C.U64)

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in C.binary(batch["text"]):
            held.append(marks(text)[1][:, 0])
            size += len(held[-1])
            if size > 200_000:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    size = texts.agg(F.sum(F.octet_length("text")), F.count_if(F.octet_length("text") > 0)).first()
    twice = C.twice_seen(texts, keys_of, f"{path}/twice", C.filter_bits((size[0] or 0) // max(1, average) + size[1]))

    @C.tidy
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), C.binary(batch["text"]), strict=True):
                ends, own = marks(text)
                at = np.flatnonzero(twice.has(own[:, 0]))
                if len(at):
                    doc = LAST if doc_id is None else doc_id
                    rows.append((own[at], np.full(len(at), doc), np.full(len(at), name_of(doc, text)), np.array([0, *ends])[at]))
                if len(rows) >= 500:
                    yield sent(rows)
                    rows = []
            yield sent(rows)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        both = np.concatenate([np.empty((0, 2), C.U64), *(r[0] for r in rows)]).view(np.int64)
        return pa.RecordBatch.from_pydict({"h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1]), **{c: pa.array(np.concatenate([np.empty(0, np.int64), *(r[i] for r in rows)])) for i, c in ((1, "doc"), (2, "name"), (3, "at"))}})

    place = F.struct("doc", "name", "at")
    counted = texts.mapInArrow(suspects, "h1 long, h2 long, doc long, name long, at long").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = C.store(counted.filter("first <> last").select("h1", "h2", F.col("first.name").alias("name"), F.col("first.at").alias("at")), f"{path}/first-places")
    table = C.write_table(firsts, f"{path}/firsts", firsts.count())

    # the texts that hold a first place; a name is a digest, so evenly spread
    holders = C.write_table(firsts.select("name").distinct(), f"{path}/holders")

    @C.tidy
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = batch["doc_id"].to_pylist(), C.binary(batch["text"])
            key = np.array([name_of(LAST if i is None else i, t or b"") for i, t in zip(*rows, strict=True)], np.int64)
            at = np.flatnonzero(holders.get(key.view(C.U64))[0])
            at = np.array([i for i, k in zip(at.tolist(), key[at].tolist(), strict=True) if not (k in seen or seen.add(k))], np.int64)
            yield pa.RecordBatch.from_pydict({"name": pa.array(key[at]), "text": pa.array([rows[1][i] for i in at.tolist()], pa.binary())})

    few = C.table_bits(docs.sparkSession, (size[0] or 0) // 32)  # files of 64 MB at most, of texts that all hold a first place
    C.os.makedirs(f"{path}/texts")

    def keep_texts(part: pa.Table) -> pa.Table:
        bucket, name, data = part["bucket"][0].as_py(), C.longs(part["name"].combine_chunks()), part["text"].combine_chunks()
        _, order = np.unique(name.view(C.U64), return_index=True)
        ends = np.cumsum([len(data[i].as_buffer()) for i in order.tolist()])
        whole = np.empty(int(ends[-1]), np.uint8)
        for i, b in zip(order.tolist(), ends.tolist(), strict=True):
            one = np.frombuffer(data[i].as_buffer(), np.uint8)
            whole[b - len(one) : b] = one
        C.save(whole, f"{path}/texts/{bucket:05d}-bytes.npy")
        C.save(np.stack([name[order], np.r_[0, ends[:-1]], ends]), f"{path}/texts/{bucket:05d}-index.npy")
        return C.only(bucket)

    C.per_bucket(texts.mapInArrow(held, "name long, text binary").withColumn("bucket", C.bucket_of(F.col("name"), few)), few, keep_texts)
    sources = Texts(f"{path}/texts", few)

    names = [f"c{i}" for i in range(len(docs.columns))]
    i_id, i_text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    flat = docs.toDF(*names).withColumn(i_text, F.col(i_text).cast("string"))

    def judge(batch: pa.RecordBatch) -> Iterator[tuple[list, int, int, int, list]]:
        """For each row: the parts that stay, and the counts and spans."""
        parsed = [(i, t or b"", *marks(t)) for i, t in zip(batch[i_id].to_pylist(), C.binary(batch[i_text]), strict=True)]
        every = np.concatenate([np.empty((0, 2), C.U64), *(p[3] for p in parsed)])
        repeated = twice.has(every[:, 0])
        some = np.flatnonzero(repeated)
        hit, (second, name, at) = table.get(every[some, 0])
        sizes = [len(p[2]) for p in parsed]
        own = np.repeat(np.array([name_of(LAST if p[0] is None else p[0], p[1]) for p in parsed], np.int64), sizes)
        mine = np.concatenate([np.empty(0, np.int64), *([0, *p[2][:-1]] for p in parsed if p[2])]).astype(np.int64)
        repeated[some] = hit & (second.view(C.U64) == every[some, 1]) & ((name != own[some]) | (at != mine[some]))
        first = np.zeros((2, len(every)), np.int64)
        first[:, some] = name, at
        known: dict[int, bytes] = {}
        start = 0
        for (_, text, ends, _), size in zip(parsed, sizes, strict=True):
            flags, (name, at) = repeated[start : start + size], first[:, start : start + size].tolist()
            start += size
            kept, spans, last, dropped, chars = [], [], 0, 0, 0
            begins, covered, reach = [0, *ends], [], None
            for i in np.flatnonzero(flags).tolist():
                a, b, line = begins[i], begins[i + 1], (name[i], at[i] - begins[i])
                if line == reach and b <= covered[-1][1]:
                    continue  # the chunk before has the same neighbours
                if name[i] not in known:
                    if sum(map(len, known.values())) >= KNOWN:
                        known.clear()
                    known[name[i]] = sources.get(name[i])
                a, b = extended(text, a, b, known[name[i]], at[i])
                reach = line
                while covered and covered[-1][1] >= a:
                    before = covered.pop()
                    a, b = min(a, before[0]), max(b, before[1])
                covered.append((a, b))
            for a, b in covered:
                n = len((part := text[a:b]).decode())
                if n >= min_chars or len(part.split()) >= min_words:
                    before = text[last:a].decode()
                    kept.append(before)
                    chars += len(before)
                    spans.append([chars, chars + n])
                    chars += n
                    dropped += n
                    last = b
            kept.append(text[last:].decode())
            yield kept, size, int(flags.sum()), dropped, spans

    @C.tidy
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                rows = list(judge(batch))
                null = batch[i_text].is_null().to_pylist()
                texts = pa.array([None if x else "".join(r[0]) for r, x in zip(rows, null, strict=True)], pa.string())
                columns = [texts if c == i_text else batch[c] for c in batch.schema.names]
                more = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.list_(pa.list_(pa.int64()))))]
                yield pa.RecordBatch.from_arrays(columns + more, names=[*batch.schema.names, "n_chunks", "n_repeated", "n_dropped", "spans"])

    new = [StructField("n_chunks", LongType()), StructField("n_repeated", LongType()), StructField("n_dropped", LongType()), StructField("spans", ArrayType(ArrayType(LongType())))]
    schema = StructType([*(StructField(f.name, StringType() if f.name == i_text else f.dataType) for f in flat.schema), *new])
    return flat.mapInArrow(clean, schema).toDF(*docs.columns, *C.free_names(docs.columns, "n_chunks", "n_repeated", "n_dropped", "spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
