"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response keeps its record id, target URI, date, headers and digests.  Its metadata record lists what the source said (status,
content type, headers, digests); its conversion record holds the page's text.  Both name the response in
WARC-Refers-To, carry its target URI and date, and have ids that follow from the response's, so reruns agree.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, n_bytes long, record binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LINE_END = re.compile(r"[\r\n]+")
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)|<!\[CDATA\[|\]\]>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|html|blockquote|pre|dl|dt|dd|form|aside|main|hr)\b[^>]*>", re.I)
_MARKUP = re.compile(r"<[/!?a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)")


def digest(data: bytes) -> str:
    """As WARC writes it: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, named fields, the block's length, a blank line, the block and two line ends.  Line ends in a value become a space, so none starts a field."""
    head = b"".join(f"{k}: {_LINE_END.sub(' ', v)}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def opened(data: bytes) -> bytes:
    """The bytes of gzip members, as far as they go: a cut or broken member ends the reading.  Other bytes stay as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            break
        if not d.eof:
            break
        data = d.unused_data.lstrip(b"\x00")
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of consecutive records; gzip members are opened.  What is no record is passed over up to the next that begins; a record cut short ends the reading."""
    data = opened(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        fields: dict[str, str] = {}
        last = ""
        for line in data[at:end].split(b"\r\n")[1:] if end >= 0 else ():
            text = line.decode("utf-8", "replace")
            if text[:1] in " \t" and last:
                fields[last] += " " + text.strip()
            elif ":" in text:
                last, _, value = text.partition(":")
                last, value = last.strip().lower(), value.strip()
                fields[last] = f"{fields[last]}, {value}" if last in fields else value
        length = fields.get("content-length", "")
        if not length.isdecimal():
            at = data.find(b"\nWARC/", at) + 1
            if not at:
                return
            continue
        n = int(length)
        if len(data) < end + 4 + n:
            return
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order (repeated ones too) and body of an HTTP response; without headers all of it is the body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in rest) if k.strip()], body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def decoded_body(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its transfer and content codings (chunked, gzip, deflate), as far as it can be decoded; unknown codings stay."""
    named = lambda k: [x.strip().lower() for name, v in headers if name == k for x in v.split(",")]
    if "chunked" in named("transfer-encoding"):
        body = _dechunked(body)
    for coding in reversed(named("content-encoding")):
        if coding in ("gzip", "x-gzip"):
            body = opened(body)
        elif coding == "deflate":
            for bits in (15, -15):
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
    return body


def plain_text(page: str) -> str:
    """All text of a page, a line per block."""
    text = _MARKUP.sub("", _BREAK.sub("\x00", _DROP.sub(" ", page)))
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in text.split("\x00")) if x)


def response_of(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    """A response record of a page."""
    body = (page or "").encode("utf-8")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return record_bytes(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url} {digest(body)}')}>"), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
            ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def derived(fields: dict[str, str], block: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response: their fields and blocks."""
    source = fields.get("warc-record-id", "")
    status, headers, body = http_parts(block)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", next((v for k, v in headers if k == "content-type"), ""), re.I)
    plain = decoded_body(headers, body)
    try:
        page = plain.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    held = fields.get("warc-payload-digest") or digest(body)
    facts = [("source-status", status), *((f"source-{k}", v) for k, v in headers), ("source-block-digest", fields.get("warc-block-digest") or digest(block)), ("source-payload-digest", held), ("source-bytes", str(len(body)))]
    meta = "".join(f"{k}: {_LINE_END.sub(' ', v)}\r\n" for k, v in facts).encode()
    for kind, content, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
        yield [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{source} {kind}')}>"), ("WARC-Refers-To", source), ("WARC-Date", fields.get("warc-date", "")),
            ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Block-Digest", digest(data)), ("WARC-Payload-Digest", held if kind == "metadata" else digest(data)), ("Content-Type", content),
        ], data


def _rows(page_id, records) -> list[tuple]:
    out = []
    for head, data in records:
        f = dict(head)
        out.append((page_id, f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Target-URI"], f["WARC-Date"], f["Content-Type"], f["WARC-Block-Digest"], f["WARC-Payload-Digest"], len(data), record_bytes(head, data)))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id and the WARC response record (bytes) of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response_of(i, u, h, date) for i, u, h in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null) and record of the WARC files at path: each file's bytes (2 GB at most, compressed or not) are the records of one row."""
    return spark.read.format("binaryFile").load(path).select(F.lit(None).cast("long").alias("page_id"), F.col("content").alias("record"))


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response in records (page_id, record: WARC bytes, gzipped or not).

    Records of other types, and bytes that are no record, give no rows; a null record gives none; of a cut gzip stream all whole records count.  Headers
    are listed in their order, repeated ones as often as they come; the text is that of the decoded body, digests are of the bytes as held.  Repeated rows give repeated records
    with equal ids; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for page_id, data in zip(batch.column(0).slice(i, 500).to_pylist(), batch.column(1).slice(i, 500).to_pylist(), strict=True):
                    for fields, block in parse_records(data or b""):
                        if fields.get("warc-type") == "response":
                            rows += _rows(page_id, derived(fields, block))
                yield _batch(rows)

    return records.select("page_id", "record").mapInArrow(run, SCHEMA)
