"""Operator 1: WARC derivatives. Each response record gives a metadata and, if its payload is text, a plain-text conversion record."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import table

RECORDS = "page_id {id}, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, headers array<struct<name:string,value:string>>, block binary"
DATE = "2024-01-01T00:00:00Z"
#: A payload whose codings are taken off may have so many bytes, unless a caller says more; it is unzipped in steps.
MOST_BYTES, STEP = 1 << 26, 1 << 20
#: Bytes of blocks that a batch of read records has at most, but for the last one's.
BATCH = 8 << 20

#: Elements whose content is not text; comments and unclosed ones of these reach to the end of the page.
HIDDEN = ("script", "style", "noscript", "template", "svg")
#: Elements that begin or end a line.
BLOCKS = frozenset(
    "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 title head body section article header footer nav main aside blockquote pre form dd dt hr".split()
)
#: Media types with text besides text/*.
TEXTUAL = ("application/xhtml+xml", "application/xml", "application/json", "application/javascript")

# each pattern is only matched at one place and takes what it has read, so a page is read in linear time
_NEXT = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)(>)?)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in HIDDEN}


def _tag(page: str, at: int, wanted: bool) -> tuple[dict[str, str], int]:
    """The attributes that begin at a place, the first of each name, if wanted, and the place after the tag's end."""
    found: dict[str, str] = {}
    end = page.find(">", at)
    if end >= 0 and not wanted:  # most tags end at the next such sign: it is in no value if quotes are even before it
        inside = page[at:end]
        if inside.count('"') % 2 == 0 and "'" not in inside:
            return found, end + 1
    while m := _ATTRIBUTE.match(page, at):
        name, *values = m.groups()
        found.setdefault(name.lower(), next((x for x in values if x is not None), ""))
        at = m.end()
    end = page.find(">", at)
    return found, len(page) if end < 0 else end + 1


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """Text, title and links of a page: no scripts, styles or comments, a line per block, blanks folded, entities decoded."""
    out: list[str] = []
    links: list[str] = []
    title: list[int] | None = None
    at, closed = 0, page.rfind(">")  # no tag ends beyond that
    while (m := _NEXT.search(page, at)) and m.start() < closed:
        out.append(page[at : m.start()])
        comment, mark, slash, name, gt = m.groups()
        at = m.end()
        if name:
            name = name.lower()
            attributes, at = ({}, at) if gt else _tag(page, at, name == "a" and not slash)
            if name in BLOCKS:
                out.append("\n")
                if name == "title":
                    if not slash:
                        title = title or [len(out)]
                    elif title and len(title) == 1:
                        title.append(len(out))
            elif name == "a":
                if "href" in attributes:
                    links.append(html.unescape(attributes["href"]).translate({13: None, 10: None}))
            elif name in HIDDEN and not slash:
                end = _HIDDEN_END[name].search(page, at)
                out.append(" ")
                at = end.start() if end else len(page)
        elif mark:
            at = page.find(">", at) + 1
        else:
            end = page.find("-->", m.start() + 2)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
    out.append(page[at:])
    lines = (" ".join(html.unescape(line).split()) for line in "".join(out).split("\n"))
    named = " ".join(html.unescape("".join(out[title[0] : title[1]])).split()) if title and len(title) == 2 else None
    return "\n".join(line for line in lines if line), named, links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _record(page_id, kind: str, record_id: str, refers: str | None, uri: str | None, date: str | None, content_type: str, block: bytes, extra=()) -> tuple:
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    pairs += [("WARC-Block-Digest", digest(block)), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return page_id, kind, record_id, refers, uri, date, [{"name": k, "value": v} for k, v in pairs if v is not None], block


def _value(pairs: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header, whose name is of any case."""
    return next((v for k, v in pairs if k.lower() == name), None)


def _split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload; a block that is no HTTP message is payload. Continued lines are joined."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, found, body = block.partition(b"\n\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("latin-1")).splitlines()
    return first, [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines) if colon], body


def _dechunked(body: bytes) -> bytes:
    """A chunked body's data, as far as its sizes can be read; one that does not begin with a size is returned as it is."""
    out, f = [], io.BytesIO(body)
    while line := f.readline():
        size = line.split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out) if out else body
        size = min(int(size, 16), len(body))
        if not size:
            break
        out.append(f.read(size))
        f.readline()
    return b"".join(out)


class TooLong(Exception):
    """A payload that is longer than asked for when its coding is taken off."""


def _unzipped(body: bytes, most: int) -> bytes | None:
    """What gzip members laid end to end, or a zlib or raw stream, hold; None if it is none or is broken, and TooLong beyond `most` bytes."""
    for bits in (47, -15):  # with a header of gzip or zlib, or raw
        out, left, total = [], body, 0
        try:
            while True:
                unzip = zlib.decompressobj(bits)
                while left and not unzip.eof:
                    out.append(unzip.decompress(left, STEP))
                    left = unzip.unconsumed_tail
                    total += len(out[-1])
                    if total > most:
                        raise TooLong
                if not unzip.eof:
                    out.append(unzip.flush())
                left = unzip.unused_data
                if not left.startswith(b"\x1f\x8b"):
                    return b"".join(out)
        except zlib.error:
            continue
    return None


def decoded(body: bytes, http: list[tuple[str, str]], most: int = MOST_BYTES) -> bytes | None:
    """The payload without its transfer and content codings; None if a coding is unknown or broken, TooLong beyond `most` bytes."""
    if "chunked" in (_value(http, "transfer-encoding") or "").lower():
        body = _dechunked(body)
    for coding in reversed([x.strip().lower() for x in (_value(http, "content-encoding") or "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            body = _unzipped(body, most)
            if body is None:
                return None
        elif coding not in ("", "identity"):
            return None
    return body


def _derive(row, most: int) -> list[tuple]:
    own = [] if row.headers is None else [(h["name"] or "", h["value"] or "") for h in row.headers if h is not None]
    block = row.block or b""
    status, http, body = _split_http(block)
    kind = _value(http, "content-type") or ""
    media = kind.split(";")[0].strip().lower()
    charset = re.search(r"charset=\s*\"?([\w-]+)", kind)
    body_text, over = None, False
    if not media or media.startswith("text/") or media in TEXTUAL:
        try:
            body_text = decoded(body, http, most)
        except TooLong:
            over = True
    if body_text is not None and not media and b"\0" in body_text:  # undeclared and binary
        body_text = None
    block_digest, payload_digest = _value(own, "warc-block-digest") or digest(block), _value(own, "warc-payload-digest") or digest(body)
    meta_id, text_id = _urn(row.record_id, "metadata"), _urn(row.record_id, "conversion")
    fields = [("source-record-id", row.record_id), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest)]
    fields += [("http-status", (status.split(" ", 2) + ["", ""])[1])] if status else []
    fields += [(f"source-http-{k.lower()}", v) for k, v in http]
    fields += [(f"source-{k.lower()}", v) for k, v in own]
    fields += [("payload-longer-than", str(most))] if over else []
    out = []
    if body_text is not None:
        try:
            page = body_text.decode(charset[1] if charset else "utf-8", "replace")
        except (LookupError, UnicodeError):  # no codec, or none for texts
            page = body_text.decode("utf-8", "replace")
        markup = media in ("", "text/html", "application/xhtml+xml")
        text, title, links = read_page(page) if markup else (page, None, [])
        text = text.encode("utf-8", "replace")
        fields += [("conversion-record-id", text_id), ("conversion-block-digest", digest(text))]
        fields += [("title", title)] if title is not None else []
        fields += [("outlink", x) for x in links]
        kept = [("WARC-Concurrent-To", meta_id), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Content-Type", kind or None)]
        out.append(_record(row.page_id, "conversion", text_id, row.record_id, row.target_uri, row.warc_date, "text/plain; charset=utf-8", text, kept))
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    linked = [("WARC-Concurrent-To", text_id)] if out else []
    return [_record(row.page_id, "metadata", meta_id, row.record_id, row.target_uri, row.warc_date, "application/warc-fields", meta, linked), *out]


_COLUMNS = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "headers", "block"]


def _batches(records: Iterator[tuple], size=lambda r: len(r[7])) -> Iterator[pd.DataFrame]:
    """Records as frames of about BATCH bytes."""
    rows: list[tuple] = []
    n = 0
    for r in records:
        rows.append(r)
        n += size(r)
        if n >= BATCH:
            yield pd.DataFrame(rows, columns=_COLUMNS)
            rows, n = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def derivatives(records: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The metadata and the conversion record of every response record, in the columns of RECORDS.

    Records of other types give none. A payload that is not text (by its media type, an unknown or broken coding, or
    zero bytes where no type is given) gives a metadata record alone. Chunked, gzip and deflate payloads are decoded, all
    members of them; one that has more than `most` bytes then gives a metadata record with payload-longer-than, and
    its text with a higher `most`.
    Metadata lists every header of the source, repeated ones too, and its digests, which are computed where the source
    has none. A null block is an empty one; null headers are no headers. Identifiers follow from the source's, so a
    rerun gives the same, and repeated records give repeated derivatives. Other columns are dropped; an empty table
    gives an empty table.
    """
    kind = records.schema["page_id"].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batches(r for batch in batches for row in batch.itertuples(index=False) for r in _derive(row, most))

    return records.where("warc_type = 'response'").select(*_COLUMNS).mapInPandas(build, RECORDS.format(id=kind))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response record for every row of pages; a null url stays null and null html is an empty payload.

    Identifiers follow from id and url, so repeated rows give repeated records; a null id is an id. Other columns are
    dropped, clashing ones too; an empty table gives an empty table.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append(_record(page_id, "response", _urn(page_id, url), None, url, date, "application/http; msgtype=response", block, [("WARC-Payload-Digest", digest(body))]))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return d.mapInPandas(build, RECORDS.format(id=d.schema["page_id"].dataType.simpleString()))


def to_bytes(headers: list, block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in headers) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_members(records: DataFrame) -> DataFrame:
    """records with the column member: each record as a gzip member, which laid end to end make a .warc.gz file.

    Headers and block must not be null. Repeated records stay, other columns are dropped, an empty table gives an empty one.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(member=[gzip.compress(to_bytes(h, b), mtime=0) for h, b in zip(batch["headers"], batch["block"], strict=True)])

    d = records.select(*_COLUMNS)
    return d.mapInPandas(build, RECORDS.format(id=d.schema["page_id"].dataType.simpleString()) + ", member binary")


class _Members(io.RawIOBase):
    """The content of gzip members laid end to end, up to where it breaks or is cut short."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.rest, self.unzip = data, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data + self.rest, zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.data[self.at : self.at + (1 << 16)]
                self.at += len(self.rest)
            if not self.rest:
                return 0
            try:
                part = self.unzip.decompress(self.rest, len(buffer))
            except zlib.error:
                self.rest, self.at = b"", len(self.data)
                return 0
            self.rest = b"" if self.unzip.eof else self.unzip.unconsumed_tail
            if part:
                buffer[: len(part)] = part
                return len(part)


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, gzipped or not.

    Lines before a version line are passed over. Header lines are UTF-8, or else Latin-1; a line that begins with a
    blank continues the one before. A length that is no number counts as 0, one of many
    digits as all that is left. A file that is cut short, or whose
    compression breaks, ends with what could be read: a block may then be shorter than its length.
    """
    f = io.BufferedReader(_Members(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while start := f.readline():
        if not start.startswith(b"WARC/"):
            continue
        headers: list[tuple[str, str]] = []
        while (raw := f.readline()).strip():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            if text[0] in " \t" and headers:
                headers[-1] = headers[-1][0], f"{headers[-1][1]} {text.strip()}"
            elif ":" in text:
                k, _, v = text.partition(":")
                headers.append((k.strip(), v.strip()))
        length = (_value(headers, "content-length") or "").lstrip("0")
        left, parts = (int(length[:18]) if len(length) < 19 else len(data)) if length.isascii() and length.isdigit() else 0, []
        while left > 0 and (part := f.read(min(left, 1 << 20))):
            parts.append(part)
            left -= len(part)
        yield headers, b"".join(parts)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at path, a file a task, in the columns of RECORDS with a null page_id.

    A file may have up to 2 GB, Spark's limit for one value; records leave the task in batches of bounded size. A header
    that a record lacks is null. Records come as often as they stand in the files; empty files give none.
    """

    def row(pairs: list[tuple[str, str]], block: bytes) -> tuple:
        names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")
        return None, *(_value(pairs, n) for n in names), [{"name": k, "value": v} for k, v in pairs], block

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield from _batches(row(*r) for r in parse(data))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(build, RECORDS.format(id="bigint"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]
    return derivatives(responses(table(spark, sf_dir, "pages"))).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", value("WARC-Block-Digest").alias("block_digest"),
        value("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("text"),
    )
