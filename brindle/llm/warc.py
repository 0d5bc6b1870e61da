"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives two records. The metadata record holds a JSON document: the response's envelope (its own WARC headers
and digests), its HTTP status and headers, title, language and links. The conversion record holds the page's visible text.
Both refer to the response by WARC-Refers-To, repeat its target and date, carry digests of their own blocks and keep the
response's headers and digests; the metadata record also names the conversion record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html as pages_html

DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
# Where elements hold addresses.
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src"}

RESPONSE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("warc_date", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType())])
DERIVED = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, headers map<string,string>, source_headers map<string,string>, content string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def urn(*parts: object) -> str:
    """A record id that is the same on every run: a UUID from the MD5 of the parts, null and empty told apart."""
    h = hashlib.md5("\x00".join("\x01" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record as it stands in a file. Line ends inside a header value become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers.items())]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file's bytes."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and body of an HTTP response; without a status line all of it is body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", {}, block
    status, *rest = head.decode("utf-8", "replace").split("\r\n")
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, body


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[dict[str, str], bytes]:
    """The response record of a page; null html is an empty body, a null url gives no target."""
    body = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {"WARC-Type": "response", "WARC-Record-ID": urn("response", page_id, url, html), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = url
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return headers, block


def link(name: str, attributes: str, base: str) -> dict[str, str] | None:
    """The address that an element holds, made absolute where that is possible; None if it holds none."""
    if name not in _LINKS:
        return None
    target = pages_html._attributes(attributes).get(_LINKS[name])
    if target is None:
        return None
    try:
        whole = urljoin(base, target.strip())
    except ValueError:
        whole = target
    return {"path": f"{name}@{_LINKS[name]}", "url": whole}


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response record."""
    status, http, body = split_http(block)
    html = body.decode("utf-8", "replace")
    title = _TITLE.search(html)
    title_text = " ".join(unescape(title[1]).split()) if title else ""
    lang = _LANG.search(html)
    found: list[dict[str, str] | None] = []  # lines and links in one pass over the markup
    lines = pages_html.lines(html, lambda name, attributes: found.append(link(name, attributes, headers.get("WARC-Target-URI", ""))))
    text = "\n".join([title_text] * bool(title_text) + [x.text for x in lines])
    source = headers["WARC-Record-ID"]
    shared = {k: headers[k] for k in ("WARC-Date", "WARC-Target-URI") if k in headers} | {"WARC-Refers-To": source}
    conversion_id = urn("conversion", source)
    meta = {"envelope": {"headers": headers, "block_digest": headers.get("WARC-Block-Digest"), "payload_digest": headers.get("WARC-Payload-Digest")}, "http": {"status": status, "headers": http, "entity_length": len(body), "entity_digest": digest(body)}, "html": {"title": title_text, "lang": lang[1] if lang else None, "links": [x for x in found if x]}, "conversion": conversion_id}
    out = []
    for kind, record_id, mime, content in (("metadata", urn("metadata", source), "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", conversion_id, "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "surrogatepass")
        own = {"WARC-Type": kind, "WARC-Record-ID": record_id, **shared, "Content-Type": mime, "WARC-Block-Digest": digest(data), "Content-Length": str(len(data))}
        out.append((own, data))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, headers, block): a response record for each row of ``pages`` (page_id, url, html).

    Null html is an empty body; pages of any length are written whole. Repeated rows are each a record, an empty table gives none;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(i, u, h, date) for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))]
            heads = [h for h, _ in made]
            yield pa.record_batch({"page_id": batch.column("page_id").cast(pa.int64()), "record_id": [h["WARC-Record-ID"] for h in heads], "target_uri": pa.array([h.get("WARC-Target-URI") for h in heads], pa.string()), "warc_date": [h["WARC-Date"] for h in heads], "headers": pa.array([list(h.items()) for h in heads], pa.map_(pa.string(), pa.string())), "block": pa.array([b for _, b in made], pa.binary())})

    return pages.select("page_id", "url", "html").mapInArrow(run, RESPONSE)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each response record (page_id, headers, block); see DERIVED for the columns.

    Repeated responses give repeated rows; an empty table gives none. Columns beyond those three are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {f.split()[0]: [] for f in DERIVED.split(", ")}
            for page_id, items, block in zip(*(batch.column(c).to_pylist() for c in ("page_id", "headers", "block"))):
                source = dict(items)
                for own, data in derive(source, block):
                    row = (page_id, own["WARC-Type"], own["WARC-Record-ID"], own["WARC-Refers-To"], own.get("WARC-Target-URI"), own["WARC-Date"], own["Content-Type"], len(data), own["WARC-Block-Digest"], source.get("WARC-Block-Digest"), source.get("WARC-Payload-Digest"), list(own.items()), list(source.items()), data.decode("utf-8", "replace"))
                    for c, v in zip(cols.values(), row):
                        c.append(v)
            kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "source_headers": pa.map_(pa.string(), pa.string())}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()})

    return records.select("page_id", "headers", "block").mapInArrow(run, DERIVED)


def serialized(records: DataFrame) -> DataFrame:
    """``record``: each row's record as WARC bytes, from ``headers`` and ``content`` (text) or ``block`` (bytes)."""
    body = "block" if "block" in records.columns else "content"

    @F.pandas_udf("binary")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for heads, blocks in batches:
            yield pd.Series([to_bytes(dict(h), bytes(b)) for h, b in zip(heads, blocks)])

    return records.withColumn("record", of("headers", F.col(body).cast("binary")))
