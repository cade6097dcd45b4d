"""Web archive derivatives: each response becomes a metadata and a plain-text conversion record that refer to it.

Records follow WARC/1.1. Both carry the response's record id in ``WARC-Refers-To``, its target and date, and
the digests of their own block and of the response's payload. The metadata block is JSON with the response's WARC and
HTTP headers, title, meta tags and links; the conversion block is the text between tags, one line per block element.
Where a response brings its own WARC headers (column ``warc``, a line each), all of them are kept, and its payload digest is
handed on as it is; without one the digest is computed.

Pages are read in time that grows with their length: tags are looked for up to the last ``>`` only, and a title's end once.

A null or empty body gives records with no text; a null target leaves ``WARC-Target-URI`` out; null
headers count as none. Repeated responses give repeated records with one id, which is a function of the response's. A
response without an id gives no records, for nothing could refer to it. An empty table gives an empty result;
columns not asked for are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DIGEST = "sha1"
# Elements whose beginning or end breaks a line, and those whose content is no text.
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section table td th title tr ul".split())
HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
OPENED = re.compile(r"<!--")
# Stands behind the last tag while hidden elements are cut out; a character that no text can hold.
END = "\udfff"
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LINKS = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def closed(body: str) -> tuple[str, str]:
    """The page up to its last ``>``, behind which there is no tag, and the rest, from a comment or hidden element on left out."""
    end = body.rfind(">") + 1
    hidden = OPENED.search(body, end)
    return body[:end], body[end:hidden.start() if hidden else len(body)]


def page_text(body: str) -> str:
    """Visible text, white space folded, a line per block."""
    out, at = [], 0
    body, rest = closed(body)
    # A comment or hidden element that never ends hides the rest, too.
    body = HIDDEN.sub(" ", f"{body}{END}")
    body, rest = (body[:-1], rest) if body.endswith(END) else (body, "")
    body = body.replace(END, "")
    for tag in TAG.finditer(body):
        out.append(body[at:tag.start()].replace("\n", " "))
        out.append("\n" if (tag[2] or "").lower() in BREAKS else "")
        at = tag.end()
    out.append((body[at:] + rest).replace("\n", " "))
    lines = (one_line(line) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def page_facts(body: str) -> dict:
    """Title, meta tags and links of a page."""
    title, metas, links = "", [], []
    body = closed(body)[0]
    opened = TITLE.search(body)
    ended = TITLE_END.search(body, opened.end()) if opened else None
    if ended:
        title = one_line(body[opened.end():ended.start()])
    for tag in TAG.finditer(re.sub(r"<!--.*?(?:-->|\Z)", "", body, flags=re.S)):
        name = (tag[2] or "").lower()
        if tag[1] or not (name == "meta" or name in LINKS):
            continue
        values = attributes(tag[3])
        if name == "meta":
            metas.append(values)
        elif values.get(LINKS[name]):
            links.append({"path": f"{name}@/{LINKS[name]}", "url": values[LINKS[name]]})
    return {"title": title, "metas": metas, "links": links}


def digest(data: bytes) -> str:
    return f"{DIGEST}:{base64.b32encode(hashlib.new(DIGEST, data).digest()).decode()}"


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def headers_of(head: str | None) -> list[list[str]]:
    """Name and value of each line of an HTTP or WARC head but the first, in order."""
    lines = (line.partition(":") for line in (head or "").splitlines()[1:])
    return [[name.strip(), value.strip()] for name, colon, value in lines if colon]


def record(fields: list[tuple[str, str]], block: str) -> str:
    """A whole record but for the two line ends that follow it in a file."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"{VERSION}\r\n{head}\r\n{block}"


def derive(
    source: str, target: str | None, date: str | None, head: str | None, body: str | None, warc: str | None = None
) -> list[dict]:
    """The metadata and the conversion record of one response."""
    body = body or ""
    given = headers_of(f"{VERSION}\n{warc}") if warc else []
    payload = dict(given).get("WARC-Payload-Digest") or digest(body.encode())
    origin = [("WARC-Type", "response"), ("WARC-Record-ID", source)]
    origin += [("WARC-Target-URI", target)] if target is not None else []
    origin += [("WARC-Date", date)] if date is not None else []
    origin += [("WARC-Payload-Digest", payload)]
    origin += [(name, value) for name, value in given if name not in dict(origin)]
    facts = page_facts(body)
    status = (head or "").splitlines()[:1]
    text = page_text(body)
    envelope = {
        "warc": dict(origin), "http": {"status": status[0] if status else "", "headers": headers_of(head)},
        "html": facts, "payload_length": len(body.encode())}
    out = []
    for kind, media, block in (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain; charset=utf-8", text),
    ):
        own, data = derived_id(source, kind), block.encode()
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        fields += [(n, v) for n, v in origin if n in ("WARC-Target-URI", "WARC-Date")]
        fields += [("WARC-Block-Digest", digest(data)), ("Content-Type", media), ("Content-Length", str(len(data)))]
        out.append({
            "record_type": kind, "record_id": own, "refers_to": source, "target_uri": target,
            "block_digest": digest(data), "source_payload_digest": payload, "content_length": len(data),
            "title": facts["title"], "n_links": len(facts["links"]), "record": record(fields, block)})
    return out


COLUMNS = ("record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest",
           "content_length", "title", "n_links", "record")
KINDS = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.int64(), pa.string())


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id") -> DataFrame:
    """Pages without archive data as responses (key, source_id, target, date, head, body); ids are digests."""
    body = F.coalesce("html", F.lit(""))
    h = F.md5(F.concat_ws("\x00", F.col(id_column).cast("string"), F.coalesce("url", F.lit("")), body).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(id_column).alias("key"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("source_id"),
        F.col("url").alias("target"), F.lit(date).alias("date"), head.alias("head"), F.col("html").alias("body"))


def derivatives(rows: DataFrame) -> DataFrame:
    """(key and COLUMNS), two rows for each response of ``rows`` (key, source_id, target, date, head, body, and maybe warc)."""
    warc = F.col("warc") if "warc" in rows.columns else F.lit(None)
    rows = rows.where(F.col("source_id").isNotNull()).select(
        "key", "source_id", "target", "date", "head", "body", warc.cast("string").alias("warc"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [derive(*row) for row in zip(*[c.to_pylist() for c in part.columns[1:]])]
                flat = [r for pair in made for r in pair]
                keys = part.column(0).take(pa.array([i for i in range(len(made)) for _ in range(2)], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, *[pa.array([r[c] for r in flat], t) for c, t in zip(COLUMNS, KINDS)]],
                    names=["key", *COLUMNS])

    return rows.mapInArrow(
        run, f"key {kind}, record_type string, record_id string, refers_to string, target_uri string, "
             "block_digest string, source_payload_digest string, content_length long, title string, n_links long, "
             "record string")


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archive files of whole records; each record is followed by two line ends, as the format asks."""
    (records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path))


def split_archive(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive file: their headers and blocks."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {n: v for n, v in headers_of(data[at:end].decode())}
        size = int(head["Content-Length"])
        out.append((head, data[end + 4:end + 4 + size]))
        at = end + 4 + size + 4
    return out
