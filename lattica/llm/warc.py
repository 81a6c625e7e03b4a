"""WARC derivatives: metadata and plain-text conversion records from response records (WARC 1.1, ISO 28500)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ship, tidied

CRLF = "\r\n"
_SPACE = uuid.UUID("6f3c1f0e-6f0f-5c1e-9d2a-0d5f6a1b7c11")
# Elements whose content isn't shown, and elements that end a line.
_HIDDEN = "script style title noscript template iframe object svg canvas"
# Of these, the ones that hide all the rest of a page which doesn't close them.
_RAW = frozenset(("script", "style"))
_BREAKS = "address article aside blockquote br button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"

_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(_HIDDEN.split()) + r")\b[^>]*>|<[!?][^>]*>", re.I | re.S)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in _HIDDEN.split()}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_BREAKING = frozenset(_BREAKS.split())


def _shown(page: str) -> str:
    """The page without comments, declarations and hidden elements. One that is never closed hides its tag only, unless it is in _RAW."""
    out, at, unclosed = [], 0, set()
    while m := _DROP.search(page, at):
        out += [page[at : m.start()], " "]
        at, name = m.end(), (m[1] or "").lower()
        if name and not (name == "svg" and m[0].endswith("/>")) and name not in unclosed:
            close = _CLOSE[name].search(page, at)
            if close:
                at = close.end()
            elif name in _RAW:
                at = len(page)
            else:
                unclosed.add(name)  # nor is any later one closed
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The shown text of an HTML page: the title, then a line for each block; white space is folded, empty lines go."""
    title = _TITLE.search(page)
    body = _TAG.sub(lambda m: "\n" if m[1].lower() in _BREAKING else "", _shown(re.sub(r"[\n\r\t\f]+", " ", page)))
    lines = [" ".join(html.unescape(x).split()) for x in [title[1] if title else "", *body.split("\n")]]
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same id, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = CRLF.join(["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response_record(url: str, page: bytes, date: str, content_type: str = "text/html; charset=utf-8") -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a response record for a page as fetched; control characters of the url are escaped, so it stays one header line."""
    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(page)}\r\n\r\n".encode() + page
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, digest(page))), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(page)),
    ]
    return headers, block


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzipped as a whole or record by record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        length = int(next(v for k, v in headers if k.lower() == "content-length"))
        start = end + 4
        if start + length > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start : start + length]
        at = start + length


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields (the status line under ``:status``) and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return [], block
    status, *lines = head.decode("iso-8859-1").split(CRLF)
    return [(":status", status), *[(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]], payload


def derive(headers: list[tuple[str, str]], block: bytes, date: str) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(type, headers, block) of the metadata and the conversion record of a response.

    Both refer to the response by its id, name its target and are concurrent to each other. The
    metadata block keeps the response's own headers and HTTP headers, its digests and what was found
    in the page; the conversion block is the plain text. A digest that the response states and its
    payload doesn't have is kept and said to be wrong.
    """
    head = {k.lower(): v for k, v in headers}
    source, target = head.get("warc-record-id", ""), head.get("warc-target-uri", "")
    fields, payload = split_http(block)
    media = next((v for k, v in fields if k.lower() == "content-type"), "text/html")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", media)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page) if "html" in media.lower() else page
    body, stated = text.encode(), head.get("warc-payload-digest")
    ids = {kind: record_id(kind, source, digest(block)) for kind in ("metadata", "conversion")}
    facts = [
        *[(f"source-{k}", v) for k, v in headers], *[(f"http-{k.lstrip(':')}", v) for k, v in fields], ("payload-digest", digest(payload)), ("payload-bytes", str(len(payload))),
        ("digest-ok", "unstated" if stated is None else str(stated == digest(payload)).lower()), ("conversion-id", ids["conversion"]), ("conversion-digest", digest(body)), ("text-characters", str(len(text))), ("links", str(len(re.findall(r"<a\s[^>]*href", page, re.I)))),
    ]
    described = "".join(f"{k}: {' '.join(v.split())}{CRLF}" for k, v in facts).encode()
    made = []
    for kind, media, content, other in (("metadata", "application/warc-fields", described, "conversion"), ("conversion", "text/plain; charset=utf-8", body, "metadata")):
        out = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target),
            *[(f"WARC-Refers-To-{name}", head[f"warc-{name.lower()}"]) for name in ("Target-URI", "Date") if f"warc-{name.lower()}" in head],
            ("WARC-Source-Payload-Digest", stated or digest(payload)), ("Content-Type", media), ("WARC-Block-Digest", digest(content)), ("WARC-Payload-Digest", digest(content)),
        ]
        made.append((kind, out, content))
    return made


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("source_digest", pa.string()), ("block_digest", pa.string()),
    ("n_bytes", pa.int64()), ("headers", pa.string()), ("content", pa.string()),
])
_DDL = "page_id long, url string, record_type string, record_id string, refers_to string, source_digest string, block_digest string, n_bytes long, headers string, content string"


def _row(page_id: int | None, kind: str, headers: list[tuple[str, str]], block: bytes) -> dict:
    head = dict(headers)
    return {
        "page_id": page_id, "url": head["WARC-Target-URI"], "record_type": kind, "record_id": head["WARC-Record-ID"], "refers_to": head["WARC-Refers-To"], "source_digest": head["WARC-Source-Payload-Digest"],
        "block_digest": head["WARC-Block-Digest"], "n_bytes": len(block), "headers": "\n".join(f"{k}: {v}" for k, v in headers), "content": block.decode(),
    }


def derive_pages(pages: DataFrame, date: str = "2025-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A metadata and a conversion row for each row of ``pages``, taken as responses fetched at ``date``.

    Each row has its headers and its content, so ``record()`` gives the bytes of the WARC record. Null
    urls and pages count as empty; repeated rows give repeated records with the same ids; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out = []
                for page_id, url, page in zip(*[c.to_pylist() for c in batch.slice(k, 200).columns]):
                    headers, block = response_record(url or "", (page or "").encode(), date)
                    out += [_row(page_id, *x) for x in derive(headers, block, date)]
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(tidied(run), _DDL)


def derive_files(files: DataFrame, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """The same rows for the response records of WARC files, from (path, content) as Spark's binaryFile source reads them; page_id is the record's number in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for k, (headers, block) in enumerate(read_records(content.as_py())):
                    if dict(headers).get("WARC-Type") == "response":
                        out += [_row(k, *x) for x in derive(headers, block, date)]
                    if len(out) >= 200:
                        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    ship(files.sparkSession)
    return files.select("content").mapInArrow(tidied(run), _DDL)
