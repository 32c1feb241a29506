"""WARC derivatives: hostile pages, odd files, and the query's rows against Python's own HTML reader."""

import gzip
import html.parser
import time

import pytest

from siltbed.llm import warc


class Reader(html.parser.HTMLParser):
    """Text by the rules of warc.read_page, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.out.append("\n" if tag in warc.BLOCKS else "")
        if tag == "a" and dict(attrs).get("href") is not None and not self.hidden:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def handle_comment(self, data):
        self.out.append(" ")


def test_query_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {(r.page_id, r.warc_type): r for r in warc.op1_warc_derivatives(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 2 * len(pages)
    for p in pages:
        r = Reader()
        r.feed(p.html or "")
        r.close()
        text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(r.out).split("\n")) if x)
        conversion, metadata = got[p.page_id, "conversion"], got[p.page_id, "metadata"]
        assert conversion.text == text, p.page_id
        assert conversion.refers_to == metadata.refers_to and conversion.target_uri == metadata.target_uri == p.url
        assert conversion.source_payload_digest == warc.digest((p.html or "").encode())
        lines = metadata.text.split("\r\n")
        assert [x[9:] for x in lines if x.startswith("outlink: ")] == r.links
        assert f"conversion-block-digest: {conversion.block_digest}" in lines and f"conversion-record-id: {conversion.record_id}" in lines


@pytest.mark.parametrize("part", ["<a ", "<p ", "<p", "<!--", "<a href='", '<a b="', "<script>", "</", "<a href=x ", "&", "<title>", "<a b='\"", "a=  "])
def test_linear(part):
    page = part * (1_000_000 // len(part))
    for p in (page, page + ">", "<a " + page + "'>"):
        began = time.perf_counter()
        warc.read_page(p)
        assert time.perf_counter() - began < 4, part


def test_pages():
    read = warc.read_page
    assert read("<p>a<b>b</b> c<br>d&amp;e <!-- x > y --> f</p>g") == ("ab c\nd&e f\ng", None, [])
    assert read("<TITLE> T &lt; t </TITLE><script>'<p>'</SCRIPT >x<a title='a>b' HREF=/u>y</a><a href='v'>z</a>") == ("T < t\nxyz", "T < t", ["/u", "v"])
    assert read("1 < 2 and 3 > 2")[0] == "1 < 2 and 3 > 2"
    assert read("a<style>b")[0] == "a" and read("a<!-- b")[0] == "a<!-- b" and read("a<!-- b>")[0] == "a" and read("")[0] == ""
    assert read("<script>var a = '<a href=no>'</script><!-- <a href=no> --><a href=yes>")[2] == ["yes"]


def record(spark, block, headers=(), kind="response"):
    schema = warc.RECORDS.format(id="long") + ", text string"
    row = (1, kind, "<urn:x>", None, "http://a/", None, [{"name": k, "value": v} for k, v in headers], block, "clash")
    return {r.warc_type: r for r in warc.derivatives(spark.createDataFrame([row], schema)).collect()}


def test_payloads(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\n%s\r\n"
    page = "<p>É one".encode()
    conversion = lambda block: bytes(record(spark, block)["conversion"].block).decode()
    chunked = b"3\r\n" + page[:3] + b"\r\n%x;x=y\r\n" % (len(page) - 3) + page[3:] + b"\r\n0\r\n\r\n"
    assert conversion(head % (b"utf-8", b"") + page) == "É one"
    assert conversion(head % (b"latin-1", b"") + "<p>É one".encode("latin-1")) == "É one"
    assert conversion(head % (b"no-such", b"") + page) == "É one"
    assert conversion(head % (b"utf-8", b"Transfer-Encoding: chunked\r\n") + chunked) == "É one"
    assert conversion(head % (b"utf-8", b"content-encoding: gzip\r\n") + gzip.compress(page)) == "É one"
    assert conversion(page) == "É one" and conversion(b"") == ""
    for block in (b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", head % (b"utf-8", b"Content-Encoding: br\r\n") + page, b"\0\1\2"):
        assert list(record(spark, block)) == ["metadata"]
    assert record(spark, page, kind="request") == {}
    own = [("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("warc-block-digest", "sha1:OWN")]
    meta = bytes(record(spark, page, own)["metadata"].block).decode().split("\r\n")
    assert "source-block-digest: sha1:OWN" in meta and meta.count("source-warc-concurrent-to: <a>") == meta.count("source-warc-concurrent-to: <b>") == 1


def test_parse():
    one = b"WARC/1.1\r\nWARC-Type: response\r\ncontent-length: 5\r\nX-Name: \xe9t\xe9\r\n  more\r\nX-Name: b\r\n\r\nhello\r\n\r\n"
    want = ([("WARC-Type", "response"), ("content-length", "5"), ("X-Name", "été more"), ("X-Name", "b")], b"hello")
    assert list(warc.parse(one * 2)) == [want] * 2 == list(warc.parse(gzip.compress(one) * 2)) == list(warc.parse(b"junk\r\n" + one + one))
    assert list(warc.parse(one + one[:-7])) == [want, (want[0], b"he")]
    cut = list(warc.parse(gzip.compress(one) + gzip.compress(one)[:-12]))
    assert cut[0] == want and list(warc.parse(b"")) == []
    assert list(warc.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")) == [([("Content-Length", "x")], b"")]


def response(body, *http, kind="text/html"):
    lines = [f"Content-Type: {kind}"] if kind else []
    return ("\r\n".join(["HTTP/1.1 200 OK", *lines, *http]) + "\r\n\r\n").encode() + body


def derived(spark, block, most=warc.MOST_BYTES):
    d = spark.createDataFrame([(1, "response", "<urn:a>", None, "u", "d", [], bytearray(block))], warc.RECORDS.format(id="long"))
    return {r.warc_type: bytes(r.block) for r in warc.derivatives(d, most).collect()}


@pytest.mark.parametrize("block,text", [
    (response(b"FFFFFFFFFFFFFFFFFFFF\r\nhello", "Transfer-Encoding: chunked"), b"hello"),
    (response(b"+5\r\nhello", "Transfer-Encoding: chunked"), b"+5 hello"),
    (response(b"5\r\nhello\r\n0\r\n\r\n", "Transfer-Encoding: chunked"), b"hello"),
    (response(b"hello", kind="text/html; charset=idna"), b"hello"),
    (response(b"hello", kind="text/html; charset=undefined"), b"hello"),
    (response(gzip.compress(b"hello ") + gzip.compress(b"world") + b"rest", "Content-Encoding: gzip"), b"hello world"),
    (response(gzip.compress(gzip.compress(b"hello")), "Content-Encoding: gzip, gzip"), b"hello"),
    (response(gzip.compress(b"hello") + b"\x1f\x8bno", "Content-Encoding: gzip"), None),
    (response(b"x" * 5000 + b"\0", kind=""), None),
])
def test_odd_payloads(spark, block, text):
    got = derived(spark, block)
    assert (got["conversion"].split() if "conversion" in got else None) == (None if text is None else text.split())


def test_a_payload_that_grows(spark):
    block = response(gzip.compress(b"word " * 400_000), "Content-Encoding: gzip")
    got = derived(spark, block, 1_000_000)
    assert set(got) == {"metadata"} and b"payload-longer-than: 1000000\r\n" in got["metadata"]
    assert len(derived(spark, block, 2_000_000)["conversion"].split()) == 400_000
    with pytest.raises(warc.TooLong):
        warc.decoded(gzip.compress(b"\0" * 300_000_000), [("Content-Encoding", "gzip")])


def test_lengths_of_many_digits():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %s\r\n\r\n"
    assert [b for _, b in warc.parse(head % (b"9" * 5000) + b"all of it")] == [b"all of it"]
    assert [b for _, b in warc.parse(head % (b"0" * 5000 + b"3") + b"all of it")] == [b"all"]
