"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so that a record can be read by its byte range. The
capture index has two levels: captures sorted by reversed-host URL key are cut into compressed
blocks, and a sparse directory keeps the first and last key of each block. A lookup binary-searches the
directory, then the block, and reads only the ranges found. The directory, which is broadcast, has at most MAX_BLOCKS
entries and DIRECTORY_BYTES of keys: blocks grow with the number of captures and, if need be, the length of keys.

Payloads that are equal and have at least ``min_bytes`` are stored once: the record with the
largest key is a response, the others are revisits that refer to it.

Every write task opens files of its own under a fresh name; only files named in the committed table of
captures are ever read, so a repeated or lost task does no harm. Files are written and read through
pyarrow.fs, so the shared folder can be any store that it knows.

Defined results: a null payload counts as empty; a null URL is archived as ``urn:page:`` and the key;
a null key takes part, but never is the response that others refer to, unless all equal payloads have null
keys: then all are responses; rows that repeat the key of a response with its payload are responses, too;
an empty table makes no archives and an empty index; a very long payload is one record in an archive of its own size; only the named
columns of the input are used, so others may have any names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raywalk.llm import shared
from raywalk.llm.urls import host_of

BLOCK_LINES = 512
MAX_BLOCKS, DIRECTORY_BYTES = 200_000, 64 << 20
#: Neighbouring bytes of an archive that one task reads.
STRETCH_BYTES = 16 << 20
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Rows from which on a digest counts as hot: each comes with its payload.
HOT_PAGES = 2000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def url_key(url: Column) -> Column:
    """Reversed host labels, ``)``, and what follows the host without the fragment; a URL without ``://`` stays as it is."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), rest)).otherwise(url)


def record(kind: str, record_id: str, uri: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response, or a revisit that keeps the HTTP head only."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        body += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + END + body + END


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; field names in lower case."""
    head, found, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if rest[len(body) :] != END:
        raise ValueError("a record's length is wrong")
    http, _, payload = body.partition(END)
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _roles(df: DataFrame, payload: str, key: str, min_bytes: int) -> DataFrame:
    """Rows with ``_sha`` and ``_first``, the key of the response with the same payload if there are several. Digests are counted without payloads;
    payload-bearing rows are shuffled once, and those of a hot digest are spread over all tasks."""
    rows = df.withColumn("_payload", F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")))
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    often = rows.where(F.length("_payload") >= min_bytes).groupBy("_sha").agg(F.max(key).alias("_first"), F.count("*").alias("rows"))
    often = shared.write_table(often.where("rows > 1 AND _first IS NOT NULL"), "digests")
    total = often.agg(F.sum("rows")).first()[0] or 0
    return shared.with_value(rows, often, "_sha", "_first", total, HOT_PAGES)


def write_archives(df: DataFrame, path: str, url: str = "url", payload: str = "html", key: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write the archives below ``path``; return their captures: ``surt``, ``uri``, ``record_type``, ``digest``, ``file``, ``offset``, ``length``."""
    spark = df.sparkSession
    shared.bounded_batches(spark)
    rows = _roles(df.select(F.col(url).alias("_url"), F.col(payload).alias("_html"), F.col(key).alias("_key")), "_html", "_key", min_bytes)
    uri = F.coalesce(F.col("_url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("_key").cast("string"), F.lit("null"))))
    rows = rows.select(uri.alias("uri"), url_key(uri).alias("surt"), F.col("_key").cast("string").alias("key"), F.col("_first").cast("string").alias("first"), "_sha", "_payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        names = ["surt", "uri", "record_type", "digest", "file", "offset", "length"]
        out, name, at, made = None, "", 0, []

        def done() -> Iterator[pa.RecordBatch]:
            out.close()
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in names]))

        for batch in batches:
            for r in batch.to_pylist():
                if out is not None and at >= ARCHIVE_BYTES:
                    yield from done()
                    out = None
                if out is None:
                    name, at, made = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                revisit = r["first"] is not None and r["first"] != r["key"]
                digest, data = base32(r["_sha"]), r["_payload"]
                kind = "revisit" if revisit else "response"
                raw = record(kind, f"urn:page:{'null' if r['key'] is None else r['key']}", r["uri"].replace("\r", "%0D").replace("\n", "%0A"), digest, len(data), data, f"urn:page:{r['first']}")
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = member.compress(raw) + member.flush()
                out.write(packed)
                made.append({"surt": r["surt"], "uri": r["uri"], "record_type": kind, "digest": digest, "file": name, "offset": at, "length": len(packed)})
                at += len(packed)
        if out is not None:
            yield from done()

    captures = rows.mapInArrow(run, "surt string, uri string, record_type string, digest string, file string, offset long, length long")
    return shared.write_table(captures, "captures")


@dataclass
class Index:
    """``blocks``: block, n, packed (a zlib-compressed JSON list of captures in key order); ``directory``: first key, last key, block."""

    archives: str
    blocks: DataFrame
    directory: list[tuple[str, str, int]]
    captures: int


def build_index(captures: DataFrame, archives: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort the captures by key and cut them into compressed blocks with a sparse directory."""
    n = captures.count()
    lines = max(block_lines, -(-n * 2 // MAX_BLOCKS))
    columns = ["surt", "uri", "record_type", "digest", "file", "offset", "length"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(part: list[tuple]) -> pa.RecordBatch:
            packed = zlib.compress(json.dumps(part).encode(), 6)
            return pa.RecordBatch.from_pydict({"first": [part[0][0]], "last": [part[-1][0]], "n": pa.array([len(part)], pa.int32()), "packed": pa.array([packed], pa.binary())})

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in columns))
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    while True:
        packed = captures.select(*columns).orderBy("surt", "file", "offset").mapInArrow(pack, "first string, last string, n int, packed binary")
        blocks = shared.write_table(packed.withColumn("block", F.monotonically_increasing_id()), "index")
        size, most = blocks.agg(F.sum(F.octet_length("first") + F.octet_length("last")), F.count("*")).first()
        if not most or size <= DIRECTORY_BYTES or lines >= n:
            break
        shared.drop_table(blocks)
        lines *= -(-2 * size // DIRECTORY_BYTES)
    # at most MAX_BLOCKS rows and DIRECTORY_BYTES
    directory = sorted((r["first"], r["last"], r["block"]) for r in blocks.select("first", "last", "block").collect())
    return Index(archives, blocks.select("block", "packed"), directory, n)


def lookup(index: Index, keys: DataFrame, key: str = "surt") -> DataFrame:
    """Captures of the distinct keys asked for: directory search, block search."""
    spark = keys.sparkSession
    shared.bounded_batches(spark)
    asked = keys.select(F.col(key).alias("surt")).where(F.col(key).isNotNull()).distinct()
    directory = spark.sparkContext.broadcast(([d[0] for d in index.directory], [d[1] for d in index.directory], [d[2] for d in index.directory]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, blocks = directory.value
        for batch in batches:
            out = [(k, blocks[i]) for k in batch.column("surt").to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_pydict({"surt": pa.array([x[0] for x in out], pa.string()), "block": pa.array([x[1] for x in out], pa.int64())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wanted, packed in zip(batch.column("wanted").to_pylist(), batch.column("packed").to_pylist()):
                lines = json.loads(zlib.decompress(packed))
                surts = [x[0] for x in lines]
                for k in wanted:
                    out += lines[bisect.bisect_left(surts, k) : bisect.bisect_right(surts, k)]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], pa.int64() if i > 4 else pa.string()) for i, n in enumerate(("surt", "uri", "record_type", "digest", "file", "offset", "length"))})

    # keys that meet in one block: at most its own lines, besides misses, which are dealt out
    part = F.pmod(F.xxhash64("surt"), F.lit(1 + asked.count() // max(1, 2 * index.captures)))
    hits = asked.mapInArrow(find, "surt string, block long").groupBy("block", part.alias("part")).agg(F.collect_list("surt").alias("wanted"))
    found = hits.join(index.blocks, "block").select("wanted", "packed")
    return found.mapInArrow(search, "surt string, uri string, record_type string, digest string, file string, offset long, length long")


def read_records(captures: DataFrame, archives: str) -> DataFrame:
    """Range reads of captures: ``record_id``, ``uri``, ``record_type``, ``refers_to``, ``payload_bytes`` (of the full payload),
    ``payload_digest`` and ``payload`` (null for a revisit). A payload that doesn't have the digest of its record raises ``ValueError``."""
    shared.bounded_batches(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(archives)
        opened, name = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = store.open_input_file(f"{base}/{file}"), file
                fields, http, payload = parse(zlib.decompress(opened.read_at(length, offset), 31))
                kind, digest, refers = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file} at {offset}: the payload doesn't have its digest")
                rows.append((fields["warc-record-id"][1:-1], fields["warc-target-uri"], kind, refers[1:-1] if refers else None, int(http["content-length"]), digest, payload if kind == "response" else None))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if opened is not None:
            opened.close()

    # neighbours are read by one task, as many tasks as the session shuffles to, whatever the size of the index
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = captures.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, "record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
