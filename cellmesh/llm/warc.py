"""WARC archives: writing pages as records, reading records back, and putting segments together.

A record longer than ``segment_bytes`` is split: a first record and continuation records that name its id as
their origin.  Readers group these by origin, order them by segment number, check the total length, and take
the HTTP chunk framing off the payload.  Each record is a gzip member of its own; archives are rolled at
``archive_bytes``, so readers share the work by archive and hold one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, stash
from .text import chunks

CRLF = b"\r\n"
MIN_REVISIT = 1000
#: Bytes of archives that one task reads, where there are more archives than cores keep busy.
READ_BYTES = 256 << 20


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """HTTP/1.1 chunk framing of a payload."""
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk does not end where its length says")
        parts.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A gzip member that holds one record."""
    # A line break in a value would end the header.
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress(head + block + CRLF * 2) + packer.flush()


def record_id(page_id: object, url: object, digest: str) -> str:
    """The id of a page's record: a function of the page, so that others can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest)))}>"


def records_of(page: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    payload = (page["html"] or "").encode()
    origin = record_id(page["page_id"], page["url"], page["digest"])
    common = [
        ("WARC-Record-ID", origin),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", page["url"]),
        ("WARC-Payload-Digest", f"sha1:{page['digest']}"),
        ("X-Page-Id", page["page_id"]),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if page["refers_to"] is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        target = record_id(page["refers_to"], page["refers_to_url"], page["digest"])
        refers = [("WARC-Refers-To", target), ("WARC-Refers-To-Target-URI", page["refers_to_url"]), ("WARC-Refers-To-Date", "2024-01-01T00:00:00Z"), ("X-Refers-To-Page-Id", page["refers_to"])]
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), *refers], head)
        return
    block = head + chunked(payload)
    pieces = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        yield record([("WARC-Type", "response"), *common], block)
        return
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}{k}')}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), *last], piece)


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, digest, refers_to, refers_to_url``: which pages another page's record stands for.

    Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the largest page_id has the response and the
    others refer to it.  Repeated rows of that id are each a response, and that of the last URL is referred to; pages without
    an id are responses.  Other columns are left out.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(payload).alias("digest"))
    large = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.octet_length(payload).alias("n"), F.sha1(payload).alias("same")).where(F.col("n") >= MIN_REVISIT)
    # Groups of one need no join; the table of the others is often small enough to be sent to each task.
    last = F.max(F.struct("page_id", "url")).alias("last")
    groups = stash(large.groupBy("same").agg(last, F.count("*").alias("n")).where("n > 1").select("same", F.col("last.page_id").alias("first"), F.col("last.url").alias("first_url")), "warc-groups")
    both = rows.join(groups, F.col("digest") == F.col("same"), "left")
    other = F.col("page_id") < F.col("first")
    return both.withColumns({"refers_to": F.when(other, F.col("first")), "refers_to_url": F.when(other, F.col("first_url"))}).drop("first", "first_url", "same")


def write_archives(pages: DataFrame, segment_bytes: int = 16384, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the pages of :func:`revisits`; a stored table ``uri, bytes, records`` of the archives.

    Archives of failed attempts are not in the table.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = uri = None
        size = n = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"uri": uri, "bytes": size, "records": n}], schema=listing)

        for batch in chunks(batches, "html"):  # some megabytes of pages at a time
            for page in batch.to_pylist():
                for member in records_of(page, segment_bytes):
                    if out is None:
                        uri, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, path = filesystem(uri)
                        out = fs.open_output_stream(path)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield row()
        if out is not None:
            out.close()
            yield row()

    listing = pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
    return stash(pages.mapInArrow(write, "uri string, bytes bigint, records bigint"), "warc-listing")


def members(uri: str) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        unzip, parts, data = zlib.decompressobj(wbits=31), [], src.read(1 << 20)
        while data:
            parts.append(unzip.decompress(data))
            if unzip.eof:
                yield b"".join(parts)
                data, unzip, parts = unzip.unused_data or src.read(1 << 20), zlib.decompressobj(wbits=31), []
            else:
                data = src.read(1 << 20)
        if any(parts):
            raise ValueError(f"{uri} ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    end = member.index(CRLF * 2)
    lines = member[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, member[end + 4 : end + 4 + int(headers["content-length"])]


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, without its chunk framing if it has one."""
    head, _, body = block.partition(CRLF * 2)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


PAGE = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, complete boolean, payload binary"
PAGE_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("payload", pa.binary())]
)
#: What one pass over the archives finds: whole records as pages, and segments with their ``origin``; a segment's block is its payload.
READ = f"{PAGE}, origin string, segment bigint, total bigint"
READ_ARROW = pa.schema([*PAGE_ARROW, ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64())])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _page(headers: dict, block: bytes | None, keep: bool) -> dict:
    """A result row.  ``block`` None: segments are missing."""
    out = {"page_id": _number(headers.get("x-page-id")), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "complete": block is not None}
    if headers["warc-type"] == "revisit":
        n, digest = headers.get("x-payload-length"), headers.get("warc-payload-digest", ":").partition(":")[2]
        return out | {"refers_to": _number(headers.get("x-refers-to-page-id")), "payload_bytes": _number(n), "payload_digest": digest or None}
    if block is None:
        return out
    payload = http_payload(block)
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if keep else None}


def read_archives(listing: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per response and revisit in the archives of ``listing`` (``uri, bytes``): the columns of ``PAGE``.

    Whole records go out as they are read.  Only segments are shuffled, by origin; a record whose segments do
    not reach the total length has ``complete`` false and no payload.  A revisit has the payload length and
    digest that its record states.  Without archives there are no rows.
    """
    known = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    spread = listing.select("uri").repartition(max(1, min(known["n"], max(4 * cores, known["bytes"] // READ_BYTES))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for member in members(uri):
                    headers, block = parse(member)
                    if "warc-segment-number" in headers:
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        segment = {"origin": origin, "segment": int(headers["warc-segment-number"]), "total": _number(headers.get("warc-segment-total-length"))}
                        held.append(segment | {"page_id": _number(headers.get("x-page-id")), "url": headers.get("warc-target-uri"), "payload": block})
                    elif headers["warc-type"] in ("response", "revisit"):
                        held.append(_page(headers, block, keep_payload))
                    size += len(block)
                    if size > 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=READ_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=READ_ARROW)

    def join(table: pa.Table) -> pa.Table:
        # A record written twice has each segment twice: one of each number counts.
        parts = {x["segment"]: x for x in table.to_pylist()}
        first, last = parts.get(1, {}), parts[max(parts)]
        block = b"".join(parts[k]["payload"] for k in sorted(parts))
        whole = sorted(parts) == list(range(1, len(parts) + 1)) and last["total"] == len(block)
        page = {"warc-type": "response", "warc-target-uri": first.get("url")} | ({} if first.get("page_id") is None else {"x-page-id": first["page_id"]})
        copies = sum(x == 1 for x in table.column("segment").to_pylist()) or 1
        return pa.Table.from_pylist([_page(page, block if whole else None, keep_payload)] * copies, schema=PAGE_ARROW)

    # One pass: what it finds is kept in the shared folder, not read out of the archives again.
    found = stash(spread.mapInArrow(rows, READ), "warc-read", 500)
    whole = found.where("origin is null").select(*PAGE_ARROW.names)
    parts = found.where("origin is not null").select("origin", "segment", "total", "page_id", "url", "payload")
    return whole.unionByName(parts.groupBy("origin").applyInArrow(join, PAGE))


def through_archives(spark: SparkSession, pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Write all pages as records and read the archives back."""
    return read_archives(write_archives(revisits(pages)), keep_payload)
