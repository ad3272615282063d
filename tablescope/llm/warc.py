"""WARC records: reading, writing, and a builder of derivatives.

`derive` turns every response record into a metadata record, with what its HTTP and HTML headers
say, and a conversion record with its plain text. Both refer to the response by id, target and
date and keep the digest of its payload, so the three can be linked and checked later.

A WARC file is text as far as Spark's readers and writers are concerned, with a separator of its
own between records: they stream record by record, from any store Spark knows, gzipped or not."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_python, text_bytes

DATE = "2024-01-01T00:00:00Z"
_GAP = "\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
#: Elements whose text is not shown, and elements that end a line.
HIDDEN = {"script", "style", "noscript", "template", "head", "iframe", "object", "svg"}
#: Those among them whose text is shown after all if they are never closed: it may be the page's.
FALLBACK = {"noscript", "iframe", "object", "svg"}
#: What may stand in a head; anything else ends one whose end tag is left out.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript",
           "script", "style", "template", "title"}
#: Elements that hold nothing and have no end tag.
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "link",
        "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that follows from its parts, so that a retried task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"\s*[\r\n]+\s*", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its headers in order, without the two line breaks that end it."""
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _GAP.encode() + block


def fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header fields; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, the first of each, and the block. No record: no headers."""
    head, gap, block = record.partition(_GAP.encode())
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return {}, b""
    headers: dict[str, str] = {}
    for name, value in fields(lines[1:]):
        headers.setdefault(name.lower(), value)
    size = headers.get("content-length", "")
    return headers, block[:int(size)] if size.isdigit() else block


@dataclass
class Http:
    status: str
    headers: list[tuple[str, str]]
    payload: bytes

    def get(self, name: str) -> str:
        return next((v for k, v in self.headers if k.lower() == name), "")


def parse_http(block: bytes) -> Http:
    """The response in a block; a block without a status line is all payload."""
    head, _, payload = block.partition(_GAP.encode())
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"HTTP/"):
        return Http("", [], block)
    status = lines[0].split(b" ", 2)
    return Http(status[1].decode("latin-1") if len(status) > 1 else "", fields(lines[1:]), payload)


def decoded(http: Http) -> bytes:
    """The body without transfer and content coding; as much of it as can be decoded."""
    data = http.payload
    if "chunked" in http.get("transfer-encoding").lower():
        out, rest = [], data
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(rest[:n])
            rest = rest[n + 2:]
        data = b"".join(out)
    coding = http.get("content-encoding").lower()
    try:
        if "gzip" in coding:
            data = gzip.decompress(data)
        elif "deflate" in coding:
            data = zlib.decompressobj(-15 if data[:1] not in (b"\x78",) else 15).decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    return data


def charset(http: Http, body: bytes) -> str:
    """From the HTTP header, else the document's own declaration, else UTF-8."""
    named = re.search(r"charset=[\"']?([\w.:-]+)", http.get("content-type"), re.I)
    own = re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", body[:4096], re.I)
    name = named[1] if named else own[1].decode("ascii", "replace") if own else "utf-8"
    try:
        b"".decode(name)
        return name
    except (LookupError, ValueError):
        return "utf-8"


class _Page(HTMLParser):
    """Collects the shown text, the title, the language and the links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Text, and None where a line ends.
        self.parts: list[str | None] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.lang, self.in_title = "", False
        self.open: list[str] = []
        self.opened: dict[str, int] = {}
        #: The open elements that hide: number among the open ones, tag, where their text begins.
        self.hidden: list[tuple[int, str, int]] = []

    def _end(self, tag: str) -> None:
        """Close the innermost element of a tag and with it what is unclosed inside."""
        last = ""
        while last != tag:
            last = self.open.pop()
            self.opened[last] -= 1
            if self.hidden and self.hidden[-1][0] == len(self.open):
                start = self.hidden.pop()[2]
                if last != "head" and (last == tag or last not in FALLBACK):
                    self.parts[start:] = [p for p in self.parts[start:] if p is None]

    def _end_head(self) -> None:
        """Something comes that can't stand in a head: one that is open, and nothing in it, ends."""
        if self.hidden and self.hidden[-1][1] == "head":
            self._end("head")

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Whatever begins with `<![` ends at the next `>`, as browsers have it."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        if tag == "html":
            self.lang = known.get("lang") or self.lang
        if tag == "a" and known.get("href") and known["href"] not in self.links[-1:]:
            self.links.append(known["href"])
        if tag == "title":
            self.in_title = True
        if tag == "body" and self.opened.get("head"):
            self._end("head")
        elif tag not in IN_HEAD:
            self._end_head()
        if tag in HIDDEN:
            self.hidden.append((len(self.open), tag, len(self.parts)))
        if tag not in VOID:
            self.open.append(tag)
            self.opened[tag] = self.opened.get(tag, 0) + 1
        if tag in BLOCKS:
            self.parts.append(None)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.opened.get(tag):
            self._end(tag)
        if tag in BLOCKS:
            self.parts.append(None)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
            return
        if data.strip():
            self._end_head()
        self.parts.append(data)

    def close(self) -> None:
        super().close()
        for _, tag, start in self.hidden[::-1]:
            if tag != "head" and tag not in FALLBACK:
                self.parts[start:] = [p for p in self.parts[start:] if p is None]


def read_page(body: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links): shown lines without empty ones, blanks folded."""
    page = _Page()
    page.feed(body)
    page.close()
    lines = (" ".join(line.split()) for line in "".join(
        "\n" if p is None else p for p in page.parts).split("\n"))
    return ("\n".join(line for line in lines if line), " ".join("".join(page.title).split()),
            page.lang, page.links)


def derive_record(record: bytes) -> list[dict]:
    """The metadata and conversion records of a response; nothing for any other record."""
    headers, block = parse(record)
    if headers.get("warc-type", "").lower() != "response":
        return []
    http = parse_http(block)
    body = decoded(http)
    coding = charset(http, body)
    text, title, lang, links = read_page(body.decode(coding, "replace"))
    source = headers.get("warc-record-id", "")
    payload = headers.get("warc-payload-digest") or digest(http.payload)
    uri, date = headers.get("warc-target-uri", ""), headers.get("warc-date", "")
    said = [("source-record-id", source), ("source-payload-digest", payload),
            ("source-block-digest", headers.get("warc-block-digest") or digest(block)),
            ("http-status", http.status), ("charset", coding), ("language", lang), ("title", title),
            *((f"http-header-{k.lower()}", v) for k, v in http.headers),
            *(("outlink", link) for link in links)]
    metadata = "".join(f"{k}: {_line(v)}\r\n" for k, v in said if v).encode("utf-8", "replace")
    out = []
    for kind, content, made in (
            ("metadata", "application/warc-fields", metadata),
            ("conversion", "text/plain; charset=UTF-8", text.encode("utf-8", "replace"))):
        own, checked = record_id(kind, source, uri, payload), digest(made)
        named = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source),
                 ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                 ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", checked),
                 ("WARC-Source-Payload-Digest", payload), ("Content-Type", content)]
        out.append({"warc_type": kind, "record_id": own, "refers_to": source, "target_uri": uri,
                    "warc_date": date, "content_type": content, "block_digest": checked,
                    "source_payload_digest": payload, "block": made,
                    "record": build([(k, v) for k, v in named if v], made)})
    return out


_KINDS = {"warc_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(),
          "target_uri": pa.string(), "warc_date": pa.string(), "content_type": pa.string(),
          "block_digest": pa.string(), "source_payload_digest": pa.string(), "block": pa.binary(),
          "record": pa.binary()}


def derive(records: DataFrame, record: str = "record", key: str | None = None) -> DataFrame:
    """Two rows per response: its metadata and its conversion record, whole in `record`.

    `key` names a column to carry along. Records of other types, null and broken ones give no
    rows; repeated responses repeat their derivatives, with the same ids; other columns are
    ignored. Every record is worked on alone, without a shuffle."""
    carried = F.col(key) if key else F.lit(None).cast("string")
    kind = records.schema[key].dataType.simpleString() if key else "string"
    schema = f"`key` {kind}, " + ", ".join(
        f"{n} {'binary' if t == pa.binary() else 'string'}" for n, t in _KINDS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place: list[int] = []
            rows: list[dict] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                made = derive_record(value or b"")
                rows += made
                place += [i] * len(made)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())),
                 *(pa.array([r[n] for r in rows], t) for n, t in _KINDS.items())],
                names=["key", *_KINDS])

    narrow = records.select(carried.alias("key"), F.col(record).cast("binary").alias("record"))
    made = for_python(narrow).mapInArrow(run, schema)
    return made.withColumnRenamed("key", key) if key else made.drop("key")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = DATE) -> DataFrame:
    """(key, record): pages as response records. A null page has an empty payload, a null
    address no target; ids follow from key, address and payload."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, target, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = digest(body)
                block = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         f"Content-Length: {len(body)}{_GAP}").encode() + body
                named = [("WARC-Type", "response"),
                         ("WARC-Record-ID", record_id("response", str(k), target or "", payload)),
                         ("WARC-Target-URI", target or ""), ("WARC-Date", date),
                         ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)),
                         ("Content-Type", "application/http; msgtype=response")]
                made.append(build([(n, v) for n, v in named if v], block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())],
                                             names=["key", "record"])

    narrow = pages.select(F.col(key).alias("key"), F.col(url), text_bytes(F.col(html)))
    return for_python(narrow).mapInArrow(run, f"`key` {kind}, record binary").withColumnRenamed("key", key)


def write_warc(records: DataFrame, path: str, record: str = "record",
               compression: str = "none") -> None:
    """Write whole records as WARC files, one per partition; null records are left out."""
    records.where(F.col(record).isNotNull()).select(
        F.col(record).cast("string").alias("value")).write.option("lineSep", _GAP).option(
            "compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of WARC files, read as a stream.

    The reader cuts at a record's end followed by the next one's first line. A payload may hold
    just that, so pieces are put together again until the record has its full length."""
    pieces = spark.read.option("lineSep", _GAP + "WARC/1.").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gap = b"", _GAP.encode()

        def length() -> int | None:
            """What the held record should have, if its headers say so."""
            head = held.partition(gap)[0]
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            return len(head) + len(gap) + int(size[1]) if size else None

        for batch in batches:
            out = []
            for piece in batch.column(0).to_pylist():
                if held:
                    if len(held) < (length() or 0):
                        held += gap + b"WARC/1." + piece
                        continue
                    out.append(held[:length()])
                held = piece if piece.startswith(b"WARC/") else b"WARC/1." + piece
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[:length()]], pa.binary())],
                                             names=["record"])

    return for_python(pieces.select(F.col("value").cast("binary").alias("piece"))).mapInArrow(
        run, "record binary")


def derivative_report(pages: DataFrame) -> DataFrame:
    made = derive(responses(pages), key="page_id")
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date",
                       "content_type", "block_digest", "source_payload_digest",
                       F.octet_length("block").cast("long").alias("block_bytes"),
                       F.decode("block", "UTF-8").alias("block"))
