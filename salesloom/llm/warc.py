"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is a row of ordered headers (name, value) and a block of bytes. For each response,
the builder makes

* a ``conversion`` record: the text of the HTML payload, as text/plain in UTF-8, and
* a ``metadata`` record: the response's HTTP status and headers, its digests, title, language,
  outlinks, and the identifier of the conversion, as application/warc-fields.

Both carry the response's identifier in WARC-Refers-To, its target URI and date, and digests of
their own block. Identifiers are name-based UUIDs of the response's, so a task that runs again
makes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import slices

Headers = list[tuple[str, str]]

VERSION = "WARC/1.1"
CRLF = "\r\n"
HEADERS_TYPE = "array<struct<name:string,value:string>>"
_ARROW_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SLICE_BYTES = 4_000_000

#: Elements that start a new line in the text; those whose content is no text.
BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul"
).split()
HIDDEN_TAGS = "script style noscript template svg head".split()

# Possessive runs that end at the next angle bracket: a tag that is left open is passed over
# once, however many follow it.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN_TAGS) + r")\b[^<>]*+>.*?(?:</\1\s*+>|\Z)|<[!?/]?([a-zA-Z][a-zA-Z0-9]*+)?[^<>]*+>",
    re.S | re.I,
)
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*+>", re.I), re.compile(r"</title\s*+>", re.I)
_ANCHOR, _HTML = re.compile(r"<a\b([^<>]*+)", re.I), re.compile(r"<html\b([^<>]*+)", re.I)
_HREF = re.compile(r"\shref\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))", re.I)
_LANG = re.compile(r"\slang\s*+=\s*+[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?\s*+([A-Za-z0-9_.:-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^<>]*?charset\s*+=\s*+[\"']?\s*+([A-Za-z0-9_.:-]+)", re.I)
#: Bytes at the front of a page that may name its encoding.
_META_BYTES = 1024
_BLOCK = frozenset(BLOCK_TAGS)


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def one_line(value: str) -> str:
    """A header value without control characters and line ends."""
    return " ".join("".join(c if c >= " " and c != "\x7f" else " " for c in value).split())


def serialise(headers: Headers, block: bytes) -> bytes:
    """The record as it stands in a WARC file."""
    head = CRLF.join([VERSION, *(f"{n}: {v}" for n, v in headers), "", ""])
    return head.encode() + block + (CRLF * 2).encode()


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The records of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = [tuple(x.split(": ", 1)) for x in lines]
        size = int(dict(headers)["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def plain_text(markup: str) -> str:
    """The visible text: one line for each block element, white space folded, entities
    resolved. What is left open (a comment, a script) reaches to the end."""
    text = _MARKUP.sub(lambda m: "\n" if m[1] or m[2] and m[2].lower() in _BLOCK else "", markup)
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """(status line, headers, payload) of an HTTP response block; a block without a header is
    all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split(CRLF)
    pairs = [x.split(":", 1) for x in lines if ":" in x]
    return status, [(n.strip(), v.strip()) for n, v in pairs], payload if gap else b""


def value_of(headers: Headers, name: str, default: str = "") -> str:
    """The first value of a header, whatever the case of its name."""
    return next((v for n, v in headers if n.lower() == name.lower()), default)


def _unchunked(payload: bytes) -> bytes:
    """A chunked body put together; of a broken one, as far as it goes."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) or payload
        if size <= 0:
            break
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _inflated(payload: bytes, kind: int) -> bytes:
    """What a compressed body holds; of a broken one, as far as it goes; the body itself if it
    is not compressed at all."""
    unpack, out = zlib.decompressobj(kind), []
    try:
        for i in range(0, len(payload), 1 << 16):
            out.append(unpack.decompress(payload[i : i + (1 << 16)]))
        out.append(unpack.flush())
    except zlib.error:
        return b"".join(out) or payload
    return b"".join(out)


def markup_of(http: Headers, payload: bytes) -> str:
    """The page's text: the body without its transfer and content encodings (chunked, gzip,
    deflate), decoded as a byte-order mark, the Content-Type or a ``meta`` tag says, else as
    UTF-8. An unknown encoding counts as UTF-8; bytes that do not fit become U+FFFD."""
    if "chunked" in value_of(http, "Transfer-Encoding").lower():
        payload = _unchunked(payload)
    packed = value_of(http, "Content-Encoding").lower()
    if "gzip" in packed:
        payload = _inflated(payload, 31)
    elif "deflate" in packed:
        payload = _inflated(payload, 15 if payload[:1] == b"\x78" else -15)
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    named = _CHARSET.search(value_of(http, "Content-Type"))
    meta = None if named else _META_CHARSET.search(payload[:_META_BYTES])
    name = named[1] if named else meta[1].decode("ascii") if meta else "utf-8"
    try:
        return payload.decode(codecs.lookup(name).name, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def title_of(markup: str) -> str | None:
    begin = _TITLE.search(markup)
    end = begin and _TITLE_END.search(markup, begin.end())
    return html.unescape(markup[begin.end() : end.start()]) if end else None


def links_of(markup: str) -> Iterator[str]:
    """The targets of links, in order."""
    for tag in _ANCHOR.finditer(markup):
        if m := _HREF.search(tag[1]):
            yield html.unescape(next(x for x in m.groups() if x is not None))


def response_of(key: str, url: str | None, payload: bytes, date: str) -> tuple[Headers, bytes]:
    """A response record for a stored page."""
    head = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    block = head.encode() + payload
    sums = digest(payload)
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", key, url or "", sums)),
        *([("WARC-Target-URI", one_line(url))] if url and one_line(url) else []),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", sums),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response. Header names match in any case;
    every WARC header of the response, repeated ones too, is a ``source-`` field of the metadata."""
    own_id = value_of(headers, "WARC-Record-ID")
    status, http, payload = split_http(block)
    markup = markup_of(http, payload)
    text = plain_text(markup).encode("utf-8", "replace")
    shared = [(n, value_of(headers, n)) for n in ("WARC-Target-URI", "WARC-Date") if any(h.lower() == n.lower() for h, _ in headers)]

    def record(kind: str, content_type: str, body: bytes) -> tuple[Headers, bytes]:
        return [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(kind, own_id, value_of(headers, "WARC-Block-Digest"))),
            ("WARC-Refers-To", own_id),
            *shared,
            ("WARC-Block-Digest", digest(body)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(body))),
        ], body

    conversion = record("conversion", "text/plain; charset=utf-8", text)
    title, page = title_of(markup), _HTML.search(markup)
    lang = page and _LANG.search(page[1])
    base = value_of(headers, "WARC-Target-URI")
    fields: Headers = [("conversion-id", value_of(conversion[0], "WARC-Record-ID"))]
    fields += [(f"source-{one_line(n).lower()}", v) for n, v in headers]
    fields += [("http-status", status)] if status else []
    fields += [(f"http-header-{n.lower()}", v) for n, v in http]
    fields += [("title", title)] if title is not None else []
    fields += [("language", lang[1])] if lang else []
    seen: dict[str, None] = {}
    for link in links_of(markup):
        seen.setdefault(_absolute(base, link))
    fields += [("outlink", x) for x in seen if x]
    body = "".join(f"{n}: {one_line(v)}{CRLF}" for n, v in fields).encode("utf-8", "replace")
    return [record("metadata", "application/warc-fields", body), conversion]


def _absolute(base: str, link: str) -> str:
    try:
        return one_line(urljoin(base, link.strip()))
    except ValueError:  # not a URL
        return one_line(link)


def _listed(headers: Headers) -> list[dict[str, str]]:
    return [{"name": n, "value": v} for n, v in headers]


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of stored pages: id, ``headers``, ``block``, one for each row.

    A null page is an empty payload; a null or blank URL leaves the target URI out; a null id
    counts as empty text in the record's identifier. Repeated rows give equal records. ``date``
    is the capture date, which the table does not have.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).tolist()
            for a, b in slices(sizes, _SLICE_BYTES):
                part = batch.slice(a, b - a)
                made = [
                    response_of("" if k is None else str(k), u, (p or "").encode("utf-8", "replace"), date)
                    for k, u, p in zip(*(c.to_pylist() for c in part.columns))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_listed(h) for h, _ in made], _ARROW_HEADERS), pa.array([x for _, x in made], pa.binary())],
                    names=[id_col, "headers", "block"],
                )

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, headers {HEADERS_TYPE}, block binary")


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """For each response record (columns id, ``headers``, ``block``) two rows: id,
    ``record_type``, ``record_id``, ``refers_to``, ``headers``, ``block``.

    Null headers count as none and a null block as empty: the records then refer to an empty
    identifier. Records of other types give no rows. Repeated rows give equal records; other
    columns are not read. An empty table gives no rows. A map without shuffle; a task holds a
    slice of records (or one).
    """
    id_type = records.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).tolist()
            for a, b in slices(sizes, _SLICE_BYTES):
                keys, heads, blocks = (c.to_pylist() for c in batch.slice(a, b - a).columns)
                out = []
                for key, listed, block in zip(keys, heads, blocks):
                    headers = [(h["name"], h["value"]) for h in listed or [] if h and h["name"] and h["value"] is not None]
                    if value_of(headers, "WARC-Type", "response").lower() == "response":
                        out += [(key, h, x) for h, x in derive(headers, block or b"")]
                names = [dict(h) for _, h, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in out], batch.column(0).type),
                        *(pa.array([n[f] for n in names], pa.string()) for f in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To")),
                        pa.array([_listed(h) for _, h, _ in out], _ARROW_HEADERS),
                        pa.array([x for _, _, x in out], pa.binary()),
                    ],
                    names=[id_col, "record_type", "record_id", "refers_to", "headers", "block"],
                )

    return records.select(id_col, "headers", "block").mapInArrow(
        work, f"`{id_col}` {id_type}, record_type string, record_id string, refers_to string, headers {HEADERS_TYPE}, block binary"
    )


def as_warc(records: DataFrame) -> DataFrame:
    """``records`` plus ``warc``, each record's bytes in a WARC file; put end to end they are
    one. A column of that name is replaced."""

    @F.pandas_udf("binary")
    def warc(headers, block):
        return headers.combine(block, lambda h, b: serialise([(x["name"], x["value"]) for x in h], b))

    return records.withColumn("warc", warc("headers", "block"))
