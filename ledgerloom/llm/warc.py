"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A record is a row: record_id, warc_type, target_uri, date, headers (map of all named fields) and block (bytes). derive() makes of
each response a metadata record (JSON: the source's named fields and HTTP headers, title, description, links) and a conversion
record (plain text, a line for each block of the page). Both refer to the response by its identifier, keep its URI and date, and
carry digests of their own blocks and of the source's payload.

Scale: one map, no shuffle; records are made and written one by one. write_warc() writes one file for each partition, each
record as a gzip member of its own, under a temporary name first, so a task that runs twice leaves the same file.

Defined results: a null or empty html is an empty payload, with an empty conversion record; a null url is the URI
urn:page:<page_id>; records of other types, and rows without a block, give no derivatives; repeated rows give equal records with
equal identifiers; an empty table gives an empty table; extra columns of pages are ignored. When files are read, what follows a
record without a Content-Length, or with one beyond the end, is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .html_blocks import blocks_of

RECORD = "record_id string, warc_type string, target_uri string, date string, headers map<string,string>, block binary"
ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)), payload


ABOUT = frozenset("title meta a area link".split())


def read(page: str) -> tuple[str, dict]:
    """A page's text, a line for each block, and what it says of itself; in time linear in the page."""
    blocks, _, found = blocks_of(page, ABOUT)
    title, metas, links = None, [], []
    for tag, attributes, text in found:
        if tag == "title":
            title = " ".join(entities.unescape(text).split()) if title is None else title
        elif tag == "meta":
            if "name" in attributes and "content" in attributes:
                metas.append({"name": entities.unescape(attributes["name"]), "content": entities.unescape(attributes["content"])})
        elif "href" in attributes:
            links.append(entities.unescape(attributes["href"]))
    return "\n".join(b.text for b in blocks), {"Title": title, "Metas": metas, "Links": links}


def derivatives(record_id: str, uri: str, date: str, headers: dict[str, str], block: bytes) -> Iterator[tuple]:
    """The metadata and the conversion record of a response."""
    status, fields, payload = split_http(block)
    source = digest(payload)
    charset = re.search(r"charset=\"?([\w-]+)", fields.get("Content-Type", ""), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text, about = read(page)
    envelope = {"WARC-Header": headers, "HTTP-Status": status, "HTTP-Headers": fields, "Payload-Digest": source, "Payload-Length": len(payload), "HTML": about}
    for kind, content_type, data in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = identifier(kind, record_id)
        named = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": content_type, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data), "WARC-Source-Payload-Digest": source}
        yield own, kind, uri, date, list(named.items()), data


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html), with page_id behind them."""
    C.prepare(pages.sparkSession)
    schema = ARROW.append(pa.field("page_id", pa.int64()))

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), C.binary(batch["html"]), strict=True):
                payload, uri = page or b"", url if url is not None else f"urn:page:{page_id}"
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                own = identifier("response", str(page_id), uri, hashlib.sha1(payload).hexdigest())
                named = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)), "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
                rows.append((own, "response", uri, date, list(named.items()), block, page_id))
            yield batch_of(rows, schema)

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, f"{RECORD}, page_id long")


def derive(records: DataFrame, *keep: str) -> DataFrame:
    """Metadata and conversion records of the responses among records; keep: columns to carry along."""
    C.prepare(records.sparkSession)
    plain = records.select("record_id", "warc_type", "target_uri", "date", "headers", "block", *keep)
    extra = plain.schema.fields[6:]

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                rows, source = [], []
                for i, (own, kind, uri, date, headers, block) in enumerate(zip(*(batch[c].to_pylist() for c in ARROW.names), strict=True)):
                    if kind == "response" and block is not None:
                        rows += derivatives(own, uri, date, dict(headers or ()), block)
                        source += [i, i]
                made = batch_of(rows, ARROW)
                yield pa.RecordBatch.from_arrays([*made.columns, *(batch[f.name].take(pa.array(source, pa.int64())) for f in extra)], names=[*ARROW.names, *(f.name for f in extra)])

    schema = ", ".join([RECORD, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    return plain.mapInArrow(run, schema)


def encoded(headers: dict[str, str], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> list[str]:
    """Writes records as .warc.gz files into a folder that all machines mount: one for each partition; their paths."""
    C.prepare(records.sparkSession)
    os.makedirs(folder, exist_ok=True)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        part, some = f"{name}.{uuid.uuid4().hex}", False
        with open(part, "wb") as f:
            for batch in batches:
                for headers, block in zip(batch["headers"].to_pylist(), batch["block"].to_pylist(), strict=True):
                    f.write(gzip.compress(encoded(dict(headers or ()), block or b""), 6, mtime=0))
                    some = True
        if some:
            os.replace(part, name)
        else:
            os.remove(part)
        yield pa.RecordBatch.from_pydict({"file": pa.array([name] if some else [], pa.string())})

    return sorted(r.file for r in records.select("headers", "block").mapInArrow(run, "file string").collect())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc or .warc.gz files, by Spark's reader of binary files: a file to a task."""
    C.prepare(spark)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, rows = 0, []
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
                    named = dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
                    size = int(x) if (x := named.get("Content-Length", "")).isdigit() else -1
                    if not 0 <= size <= len(data) - end - 4:
                        break
                    rows.append((named.get("WARC-Record-ID"), named.get("WARC-Type"), named.get("WARC-Target-URI"), named.get("WARC-Date"), list(named.items()), data[end + 4 : end + 4 + size]))
                    at = end + 8 + size
                    if len(rows) >= 1000:
                        yield batch_of(rows, ARROW)
                        rows = []
                yield batch_of(rows, ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    made = derive(responses(pages), "page_id")
    field = lambda k: F.col("headers")[k]
    return made.select("page_id", "warc_type", "record_id", field("WARC-Refers-To").alias("refers_to"), "target_uri", F.col("date").alias("warc_date"), field("Content-Type").alias("content_type"), F.octet_length("block").cast("long").alias("content_length"), field("WARC-Block-Digest").alias("block_digest"), field("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.decode("block", "UTF-8").alias("content"))
