import hashlib
import random
import re
import time
from html.parser import HTMLParser

import pytest

from quire.llm import warc


def parse(data):
    """Records of a WARC file as (headers, block)."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        out.append((headers, rest[:n]))
        data = rest[n + 4:]
    return out


PAGE = ('<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><script>var t="</p>";</script>'
        '<p>Eins &lt;zwei&gt;</p><div>drei<br>vier <a href="/x?a=1&amp;b=2">Link</a> <b>fett</b></div></body></html>')


def response(**more):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Own: 1\r\n\r\n" + PAGE.encode()
    return {"record_id": "<urn:uuid:1>", "target_uri": "http://h.example/p/q", "date": "2024-01-01T00:00:00Z", "block": block,
            "block_digest": "sha1:AA", "payload_digest": "sha1:BB"} | more


def test_round_trip_and_links():
    rows = warc.derive(response())
    (meta, fields), (conv, text) = parse(b"".join(warc.record_bytes(r[5], r[6]) for r in rows))
    assert (meta["WARC-Type"], conv["WARC-Type"]) == ("metadata", "conversion")
    for h, block in ((meta, fields), (conv, text)):
        assert h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Refers-To-Date"] == "2024-01-01T00:00:00Z"
        assert h["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] == "http://h.example/p/q"
        assert h["WARC-Block-Digest"] == warc.digest(block)
    assert meta["WARC-Concurrent-To"] == conv["WARC-Record-ID"] and conv["WARC-Concurrent-To"] == meta["WARC-Record-ID"]
    assert text.decode() == "Eins <zwei>\ndrei\nvier Link fett"
    lines = fields.decode().split("\r\n")
    for line in ("http-status: HTTP/1.1 200 OK", "http-header-X-Own: 1", "source-block-digest: sha1:AA", "source-payload-digest: sha1:BB", "charset: utf-8",
                 "language: de", "title: A & B", "outlink: http://h.example/x?a=1&b=2"):
        assert line in lines


def test_odd_responses():
    binary = response(block=b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    assert [r[0] for r in warc.derive(binary)] == ["metadata"]
    nothing = dict.fromkeys(response())
    assert [r[0] for r in warc.derive(nothing)] == ["metadata", "conversion"] and warc.derive(nothing)[1][6] == b""
    latin = response(block="HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\nß".encode("latin-1"))
    assert warc.derive(latin)[1][6] == "ß".encode()
    strange = response(block=b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=nonsense\r\n\r\nabc")
    assert warc.derive(strange)[1][6] == b"abc"
    evil = warc.derive(response(target_uri="http://h/\r\nWARC-Type: response"))
    assert all("\r\nWARC-Type: response" not in r[5] for r in evil)


def test_unclosed_elements_keep_the_body():
    for page in ("<html><head><title>T</title><meta charset=utf-8><body><p>whole body", "<head><title>T</title><script>x</script><p>whole body",
                 "<head><title>T<body>whole body", "<head></head><svg width='1'/><p>whole body", "<SVG/>whole <svg><text>no</text></svg>body",
                 "<noscript>whole body", "<template><p>whole body</p>", "<head><title>a < b</title></head>whole body"):
        assert warc.plain_text(page) == "whole body"
    for page in ("text <!-- no", "text <script>no", "text <style>no</p>", "text <noscript>no</noscript>", "text <template>no</template>"):
        assert warc.plain_text(page) == "text"


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE, "x"), (2, None, None, None), (2, None, None, None), (None, "u", "", "x")],
                                  "page_id long, url string, html string, record_type string")
    rows = warc.derivatives(warc.responses_of_pages(pages), keep=("page_id",)).collect()
    assert len(rows) == 8 and {r.record_type for r in rows} == {"metadata", "conversion"}
    assert all(r.payload_digest == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest() for r in rows if r.page_id == 1)
    assert warc.derivatives(warc.responses_of_pages(pages.where("false"))).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.derivatives(warc.responses_of_pages(pages), keep=("page_id",)).collect()
    assert len(rows) == 2 * pages.count() and len({r.record_id for r in rows}) == len(rows)
    assert not any(b"<p" in r.block or b"&amp;" in r.block for r in rows if r.record_type == "conversion")


#: What is hidden, as one pattern (of quadratic time).
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<svg\b[^<>]*/>|<(noscript|template|svg)\b.*?</\2\s*>"
                    r"|<title\b[^<>]*>(?:(?:(?!</head\b|<body\b).)*?</title\s*>|[^<]*)", re.S | re.I)


def test_hidden_parts_by_the_pattern():
    rng = random.Random(8)
    pieces = ["<svg", "<svg>", "<SVG/>", "</svg>", "<svg a='1' />", "<noscript>", "</noscript >", "<template x>", "</template>", "<script>", "</script>", "<style", "</STYLE>", "<title>", "<title", "</title>",
              "</title\n>", "</head>", "<body>", "<!--", "-->", "<!-->", "a", " b\n", "<p>", ">", "<", "/>", "<titles>", "<svgx>"]
    for _ in range(20_000):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert warc._without_hidden(page) == HIDDEN.sub(" ", page), page


@pytest.mark.parametrize("piece", ["<svg>", "<noscript>a", "<title>a</b>", "<template", "<script", "<!--", "</title <title>", "<a href=\"", "<svg /", "\n ", "&amp", "<title><body>"])
def test_time_is_linear_in_the_page(piece):
    took = []
    for size in (200_000, 1_600_000):
        page = piece * (size // len(piece))
        begin = time.process_time()
        warc.derive(response(block=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode()))
        took.append(time.process_time() - begin)
    assert took[1] < 20 * took[0] + 1.0  # eight times the length


class Reader(HTMLParser):
    """An independent reader of the visible words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "svg", "title")
        self.words.append(" " if tag in ("p", "div", "br", "li", "td", "tr", "h1", "h2", "h3", "ul", "ol", "table", "nav", "footer", "header", "section", "article", "pre") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "svg", "title")
        self.handle_starttag("p", None) if tag in ("p", "div", "li", "td", "tr", "h1", "h2", "h3", "ul", "ol", "table", "nav", "footer", "header", "section", "article", "pre") else None

    def handle_data(self, data):
        self.words.append(data if not self.hidden else "")


def test_plain_text_against_an_independent_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    for page in pages + [PAGE]:
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert warc.plain_text(page).split() == "".join(reader.words).split()
