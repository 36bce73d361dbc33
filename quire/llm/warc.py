"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

For every response record two records are built: ``metadata`` (application/warc-fields: status,
source headers, source digests, title, language, charset, links) and ``conversion`` (the page as
plain text).  Both refer to the response by its record id, target and date, and to each other
through WARC-Concurrent-To; their own ids follow from the response's id, so a repeated task
builds the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read_table

VERSION = "WARC/1.1"

# Of a head, only these hold text; whatever else stands before </head> or without it belongs to the body.
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|svg|title)\b", re.I)
_CLOSE = re.compile(r"</(script|style|noscript|template|svg|title)\s*>", re.I)
_BODY = re.compile(r"</head\b|<body\b", re.I)
_EMPTY_SVG, _TITLE_TAG = re.compile(r"<svg\b[^<>]*/>", re.I), re.compile(r"<title\b[^<>]*>", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANGUAGE = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^<>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_SPACES, _LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _without_hidden(page: str) -> str:
    """The page with a space for each comment, script, style, closed noscript, template and svg, empty svg, and title.

    An unclosed comment, script or style hides the rest; of what is otherwise unclosed only the tag goes (later), of a
    title what stands before the next tag.  End tags are listed once and looked up, so the time is linear whatever is left open."""
    closes: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for m in _CLOSE.finditer(page):
        closes[m[1].lower()].append(m.span())
    bodies = [m.start() for m in _BODY.finditer(page)]
    out, kept, at = [], 0, 0
    while found := _OPEN.search(page, at):
        begin, kind, end = found.start(), (found[1] or "").lower(), None
        ends = closes[kind]
        after = bisect_left(ends, (found.end(), 0))
        close = ends[after] if after < len(ends) else None
        if not kind:
            stop = page.find("-->", found.end())
            end = stop + 3 if stop >= 0 else len(page)
        elif kind in ("script", "style"):
            end = close[1] if close else len(page)
        elif kind == "title":
            tag = _TITLE_TAG.match(page, begin)
            if tag:
                after = bisect_left(ends, (tag.end(), 0))
                close = ends[after] if after < len(ends) else None
                body = bisect_left(bodies, tag.end())
                stop = page.find("<", tag.end())
                end = close[1] if close and (body == len(bodies) or bodies[body] >= close[0]) else stop if stop >= 0 else len(page)
        else:
            empty = _EMPTY_SVG.match(page, begin) if kind == "svg" else None
            end = empty.end() if empty else close[1] if close else None
        if end is None:
            at = found.end()
        else:
            out += [page[kept:begin], " "]
            kept = at = end
    return "".join(out) + page[kept:]


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, entities decoded, white space collapsed; in linear time."""
    page = _without_hidden(page)
    page = html.unescape(_TAG.sub("", _BLOCK.sub("\n", page)))
    return _LINES.sub("\n", _SPACES.sub(" ", page)).strip()


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload; a block without an empty line is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(name.strip(), value.strip()) for name, colon, value in (line.partition(":") for line in lines[1:]) if colon]
    return lines[0].strip(), headers, payload


def _clean(value: str | None) -> str:
    """A header value: no line can be smuggled in."""
    return _CONTROL.sub(" ", value or "").strip()


def record_bytes(header: str, block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return header.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} of {record_id}')}>"


def _header(kind: str, own: str, other: str | None, source: dict, content_type: str, block: bytes) -> str:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["target_uri"]),
              ("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", source["target_uri"]),
              ("WARC-Refers-To-Date", source["date"]), ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(block)),
              ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return "\r\n".join([VERSION, *(f"{name}: {_clean(value)}" for name, value in fields if _clean(value))])


def derive(source: dict) -> list[tuple]:
    """The derivative records of one response (record_id, target_uri, date, block, block_digest,
    payload_digest): (type, id, refers to, concurrent to, content type, header, block)."""
    status, headers, payload = parse_http(source["block"] or b"")
    named = {name.lower(): value for name, value in reversed(headers)}
    kind, _, parameters = named.get("content-type", "").partition(";")
    kind = kind.strip().lower()
    textual = kind.startswith("text/") or kind.endswith(("xml", "json")) or not kind
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", parameters)
    inner = _META_CHARSET.search(payload[:4096])
    charset = charset[1] if charset else inner[1].decode("ascii") if inner else "utf-8"
    try:
        page = payload.decode(charset, "replace") if textual else ""
    except LookupError:  # an unknown charset
        charset, page = "utf-8", payload.decode("utf-8", "replace")
    marked = textual and (kind in ("", "text/html", "application/xhtml+xml"))
    title, language = (_TITLE.search(page), _LANGUAGE.search(page)) if marked else (None, None)
    metadata_id = _derived_id(source["record_id"] or "", "metadata")
    conversion_id = _derived_id(source["record_id"] or "", "conversion") if textual else None
    fields = [("http-status", status), *((f"http-header-{name}", value) for name, value in headers),
              ("source-block-digest", source["block_digest"]), ("source-payload-digest", source["payload_digest"] or digest(payload)),
              ("charset", charset if textual else ""), ("language", language[1] if language else named.get("content-language", "")),
              ("title", html.unescape(title[1]) if title else "")]
    if marked:
        for link in _LINK.finditer(page):
            try:
                fields.append(("outlink", urljoin(source["target_uri"] or "", html.unescape(link[1] or link[2] or link[3] or ""))))
            except ValueError:  # not an address
                continue
    block = "".join(f"{name}: {_clean(value)}\r\n" for name, value in fields if _clean(value)).encode("utf-8", "replace")
    out = [("metadata", metadata_id, conversion_id, "application/warc-fields", block)]
    if textual:
        text = (plain_text(page) if marked else page).encode("utf-8", "replace")
        out.append(("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", text))
    return [(t, own, source["record_id"], other, c, _header(t, own, other, source, c, b), b) for t, own, other, c, b in out]


_SOURCE = ("record_id", "target_uri", "date", "block", "block_digest", "payload_digest")
_DERIVED = ("record_type", "record_id", "refers_to", "concurrent_to", "content_type", "header", "block")


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``responses`` (record_id, target_uri, date, block_digest, payload_digest string; block binary: the HTTP
    response) to its derivative records: the columns ``keep``, target_uri, date, payload_digest of the
    source, record_type, record_id, refers_to, concurrent_to, content_type, header string, block binary.

    A null block counts as empty, null fields are left out of the records; a payload that is no text
    gives a metadata record alone.  Equal rows give equal records; an empty table gives none.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.num_columns - len(_SOURCE)
            for at in range(0, batch.num_rows, 256):  # so that long pages don't pile up
                part = batch.slice(at, 256)
                rows, out = [], []
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[first:]))):
                    found = derive(dict(zip(_SOURCE, values)))
                    rows += [i] * len(found)
                    out += found
                if out:
                    place = pa.array(rows, pa.int64())
                    kept = [*part.columns[:first], part.column(first + 1), part.column(first + 2), part.column(first + 5)]
                    columns = [pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(_DERIVED, zip(*out))]
                    yield pa.RecordBatch.from_arrays([*(c.take(place) for c in kept), *columns],
                                                     names=[*part.schema.names[:first], "target_uri", "date", "payload_digest", *_DERIVED])

    source = responses.select(*keep, *(F.col(c).alias(f"_q_{c}") for c in _SOURCE))
    schema = "".join(f"`{c}` {t}, " for c, t in responses.select(*keep).dtypes)
    return source.mapInArrow(build, f"{schema}target_uri string, date string, payload_digest string, "
                             "record_type string, record_id string, refers_to string, concurrent_to string, content_type string, header string, block binary")


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw pages (page_id, url, html) as response records: the rows that a crawl would have written."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ").cast("binary"),
                     F.octet_length(body).cast("string").cast("binary"), F.lit("\r\n\r\n").cast("binary"), body)
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url")))
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select("page_id", record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), block.alias("block"),
                        F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("block_digest"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("payload_digest"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page."""
    return derivatives(responses_of_pages(read_table(spark, sf_dir, "pages")), keep=("page_id",))
