"""WARC derivatives (operator 10): each response becomes a metadata record and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as html_entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is not text, and elements that end a line of text.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = set(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9]*)")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RESPONSE = "record_id string, target_uri string, warc_date string, http_headers array<struct<name string, value string>>, payload binary"
RECORD = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_headers array<struct<name string, value string>>, block binary"
)


def digest(data: bytes) -> str:
    """The digest form that WARC headers carry."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_html(source: str) -> tuple[str, str, list[str]]:
    """(title, text, links) in one pass over the tags; unclosed tags, comments and hidden elements end with the page.

    Text: hidden elements, comments and the title left out, block elements end lines, entities resolved, white space
    within a line collapsed, empty lines dropped.
    """
    out, links, title = [], [], []
    hidden = ""
    first, *parts = source.split("<")
    out.append(first)
    comment = False
    for part in parts:
        if comment:
            end = part.find("-->")
            if end < 0:
                continue
            comment = False
            out.append(part[end + 3 :])
            continue
        if not hidden and part.startswith("!--"):
            end = part.find("-->", 3)
            comment = end < 0
            out.append("" if comment else part[end + 3 :])
            continue
        named = _NAME.match(part)
        name = named[1].lower() if named else ""
        if hidden and hidden != "title" and not (part.startswith("/") and name == hidden):
            continue
        if not named and part[:1] not in ("!", "?", "/"):
            (title if hidden == "title" else out).append("<" + part)
            continue
        tag, closed, text = part.partition(">")
        if not closed:
            continue
        closing = part.startswith("/")
        if hidden and closing and name == hidden:
            hidden = ""
        elif not closing and (name in HIDDEN or name == "title") and not tag.endswith("/"):
            hidden = name
        if name == "a" and not closing and (m := _HREF.search(tag)):
            links.append(html_entities.unescape(m[1] or m[2] or m[3] or ""))
        if name in BLOCKS:
            out.append("\n")
        if hidden == "title":
            title.append(text)
        elif not hidden:
            out.append(text)
    # white space of the source is one blank; only block elements (marked by "\n" entries) end lines
    lines, now = [], []
    for piece in out:
        if piece == "\n":
            lines.append("".join(now))
            now = []
        else:
            now.append(piece)
    lines.append("".join(now))
    lines = [" ".join(html_entities.unescape(x).split()) for x in lines]
    return " ".join(html_entities.unescape("".join(title)).split()), "\n".join(x for x in lines if x), links


def _header(headers: list[dict], name: str) -> str:
    return next((h["value"] or "" for h in headers if (h["name"] or "").lower() == name), "")


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; what does not follow the form is taken as it stands."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else body


def entity(headers: list[dict], payload: bytes) -> bytes:
    """A payload as the page's bytes: without transfer and content encodings. One that cannot be undone stays, and so does
    a payload that was stored decoded under headers that say otherwise."""
    if "chunked" in _header(headers, "transfer-encoding").lower():
        payload = unchunked(payload)
    for coding in reversed([c.strip() for c in _header(headers, "content-encoding").lower().split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(31).decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"x" else -15).decompress(payload)
        except zlib.error:
            break
    return payload


def page_text(headers: list[dict], payload: bytes) -> str:
    """A page decoded by the character set that its byte order mark, its header or its first bytes name; UTF-8 otherwise."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if payload.startswith(mark):
            return payload.decode(name, "replace")
    named = _CHARSET.search(_header(headers, "content-type").encode("latin-1", "replace")) or _CHARSET.search(payload[:2048])
    try:
        name = codecs.lookup(named[1].decode("ascii")).name if named else "utf-8"
        return payload.decode({"iso8859-1": "cp1252"}.get(name, name), "replace")
    except (LookupError, UnicodeDecodeError, ValueError):
        return payload.decode("utf-8", "replace")


def derive(record_id: str, uri: str, date: str, headers: list[dict], payload: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of RECORD. Their ids follow from the response's."""
    source = digest(payload)
    title, text, links = read_html(page_text(headers, entity(headers, payload)))
    envelope = {
        "headers": [[h["name"], h["value"]] for h in headers],
        "links": links,
        "payload-digest": source,
        "payload-length": len(payload),
        "refers-to": record_id,
        "target-uri": uri,
        "title": title,
    }
    out = []
    for kind, content_type, block in (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        ("conversion", "text/plain", text.encode("utf-8", "replace")),
    ):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {record_id}')}>"
        out.append((own, kind, record_id, uri, date, content_type, len(block), digest(block), source, headers, block))
    return out


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table, ``(id, *RESPONSE)``; the record id is a hash of page id, address and content.
    A null page is an empty payload, a null address an empty one."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.md5(body.cast("binary"))).cast("binary"))
    parts = [F.substr(key, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    return pages.select(
        F.col(id_col),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.array(
            header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(body).cast("string"))
        ).alias("http_headers"),
        body.cast("binary").alias("payload"),
    )


def build_derivatives(responses: DataFrame, id_col: str | None = None) -> DataFrame:
    """Two rows of RECORD for each row of RESPONSE, after its ``id_col`` if one is named.

    Repeated responses give repeated records with equal ids. Null record ids, addresses and dates stay null, a null
    payload is empty, null headers are none. Text and links come from the page without its transfer and content encodings,
    in the character set it names; digests and lengths of the source are those of the payload as it is stored. An empty
    table gives an empty result; other columns are not read. A very long page costs what its length does. A map over rows.
    """
    names = ["record_id", "target_uri", "warc_date", "http_headers", "payload"]
    ids = [id_col] if id_col else []
    schema = responses.select(*ids).schema
    for field in responses.sparkSession.createDataFrame([], RECORD).schema:
        schema = schema.add(field)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        headers_type = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), headers_type, pa.binary()]
        for batch in batches:
            rows, at = [], []
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for i, (rid, uri, date, headers, payload) in enumerate(zip(*columns)):
                rows += derive(rid.as_py(), uri.as_py(), date.as_py(), headers.as_py() or [], payload.as_py() or b"")
                at += [i, i]
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            own = [batch.column(0).take(pa.array(at, pa.int64()))] if ids else []
            yield pa.RecordBatch.from_arrays(own + arrays, names=schema.names)

    return responses.select(*ids, *names).mapInArrow(run, schema)


def serialise(record: dict) -> bytes:
    """One WARC/1.1 record as a gzip member; a file is a concatenation of members."""
    head = [
        ("WARC-Type", record["warc_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Refers-To", record.get("refers_to")),
        ("WARC-Refers-To-Target-URI", record.get("target_uri") if record.get("refers_to") else None),
        ("WARC-Refers-To-Date", record.get("warc_date") if record.get("refers_to") else None),
        ("WARC-Target-URI", record.get("target_uri")),
        ("WARC-Date", record.get("warc_date")),
        ("Content-Type", record["content_type"]),
        ("Content-Length", len(record["block"])),
        ("WARC-Block-Digest", digest(bytes(record["block"]))),
        ("WARC-Payload-Digest", record.get("source_payload_digest")),
    ]
    lines = [f"{k}: {v}" for k, v in head if v is not None]
    return gzip.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + bytes(record["block"]) + b"\r\n\r\n", mtime=0)


#: Bytes of a file that are decompressed at once.
PIECE = 1 << 20


def _plain(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, decompressed member by member."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + PIECE]) for k in range(0, len(view), PIECE))
        return
    member = zlib.decompressobj(31)
    for k in range(0, len(view), PIECE):
        rest = bytes(view[k : k + PIECE])
        while rest:
            yield member.decompress(rest)
            rest = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record in a WARC file, compressed by members or plain. One record at a
    time is held beside the file."""
    held, pieces = b"", _plain(data)
    more = lambda: next(pieces, None)
    while True:
        while (start := held.find(b"WARC/")) < 0 or (end := held.find(b"\r\n\r\n", start)) < 0:
            if (piece := more()) is None:
                return
            held = held[-4:] + piece if start < 0 and held else held + piece
        lines = held[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head.get("content-length", 0))
        parts, have = [held[end + 4 :]], len(held) - end - 4
        while have < size and (piece := more()) is not None:
            parts.append(piece)
            have += len(piece)
        body = b"".join(parts)
        yield head, body[:size]
        held = body[size:]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE rows of the WARC files at ``path`` (2 GB each at most, compressed); records of other types are passed over.
    A file is a row of one task, decompressed and handed on in pieces."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        headers_type = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        types = [pa.string(), pa.string(), pa.string(), headers_type, pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["record_id", "target_uri", "warc_date", "http_headers", "payload"])

        for batch in batches:
            rows, size = [], 0
            for content in batch.column(0):
                for head, block in parse(content.as_py()):
                    if head.get("warc-type") == "response":
                        top, _, payload = block.partition(b"\r\n\r\n")
                        lines = [x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:]]
                        headers = [{"name": k.strip(), "value": v.strip()} for k, _, v in lines]
                        rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), headers, payload))
                        size += len(payload)
                        if size > 16 * PIECE:
                            yield made(rows)
                            rows, size = [], 0
            yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)
