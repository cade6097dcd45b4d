import base64
import glob
import gzip
import hashlib
import json

from plumbline.llm import warc_derivatives as W
from plumbline.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="x" content='y "z"'>
<script>var t = "<p>no</p>";</script><style>p{}</style></head><body><!-- <a href="/hidden">x</a> -->
<h1>Head&nbsp;line</h1><p>One <b>two</b>
three.<p>Four &lt;five&gt;<br>six <a class=k href=/seven>seven</a><img src="i.png" alt="a > b"></body></html>"""


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_facts():
    assert W.page_text(PAGE) == "A & B\nHead line\nOne two three.\nFour <five>\nsix seven"
    facts = W.page_facts(PAGE)
    assert facts["title"] == "A & B" and facts["metas"] == [{"name": "x", "content": 'y "z"'}]
    assert [x["url"] for x in facts["links"]] == ["/seven", "i.png"]
    assert W.page_text("") == "" and W.page_text("a < b > c") == "a < b > c" and W.page_text("<p") == "<p"


def test_query_round_trip(spark, sf_dir, tmp_path):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    records = QUERIES["op7_warc_derivatives"](spark, sf_dir)
    path = str(tmp_path / "archive")
    W.write_archive(records, path)
    rows = records.collect()
    assert len(rows) == 2 * len(pages)
    ids = {}
    for r in rows:
        ids.setdefault(r.page_id, {})[r.record_type] = r
    read = [x for f in glob.glob(f"{path}/*.gz") for x in W.split_archive(gzip.open(f).read())]
    assert len(read) == len(rows)
    by_id = {head["WARC-Record-ID"]: (head, block) for head, block in read}
    assert len(by_id) == len(rows)
    for key, page in pages.items():
        meta, text = ids[key]["metadata"], ids[key]["conversion"]
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
        payload = sha((page.html or "").encode())
        for r in (meta, text):
            head, block = by_id[r.record_id]
            assert head["WARC-Type"] == r.record_type and head["WARC-Refers-To"] == r.refers_to
            assert head.get("WARC-Target-URI") == page.url and head["WARC-Block-Digest"] == sha(block) == r.block_digest
            assert r.source_payload_digest == payload and int(head["Content-Length"]) == len(block) == r.content_length
        envelope = json.loads(by_id[meta.record_id][1])
        assert envelope["warc"]["WARC-Record-ID"] == meta.refers_to and envelope["warc"]["WARC-Payload-Digest"] == payload
        assert envelope["http"]["status"] == "HTTP/1.1 200 OK" and dict(envelope["http"]["headers"])["Content-Type"]
        assert by_id[text.record_id][1].decode() == W.page_text(page.html or "")


def test_odd_rows(spark):
    head = "HTTP/1.1 404 Not Found\r\nX-A: b: c\r\nX-A: d\r\nnonsense\r\n"
    rows = [
        (1, "<urn:uuid:1>", "http://a/", "2024-05-05T00:00:00Z", head, PAGE), (2, "<urn:uuid:2>", None, None, None, None),
        (2, "<urn:uuid:2>", None, None, None, None), (3, "<urn:uuid:3>", "u", "d", "", ""), (4, None, "u", "d", "", "x"),
        (None, "<urn:uuid:5>", "u", "d", "", "<p>" * 30_000 + "é"), (6, "<urn:uuid:6>", "u", "d", "", "<script>never closed")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], (
        "key long, source_id string, target string, date string, head string, body string, record int"))
    found = W.derivatives(frame).collect()
    assert len(found) == 12 and {r.key for r in found} == {1, 2, 3, 6, None}
    first = {r.record_type: r for r in found if r.key == 1}
    ((headers, block),) = W.split_archive(first["metadata"].record.encode() + b"\r\n\r\n")
    assert json.loads(block)["http"]["headers"] == [["X-A", "b: c"], ["X-A", "d"]]
    assert headers["WARC-Date"] == "2024-05-05T00:00:00Z"
    ((headers, block),) = W.split_archive([r for r in found if r.key == 2 and r.record_type == "conversion"][0].record.encode())
    assert "WARC-Target-URI" not in headers and block == b""
    assert [r.content_length for r in found if r.key is None and r.record_type == "conversion"] == [2]
    assert W.derivatives(frame.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "x")], "page_id long, url string, html string")
    assert len({r.source_id for r in W.responses(pages).collect()}) == 2


OLD_HIDDEN = W.HIDDEN


def old_text(body):
    """Tags and hidden elements taken out one after another over the whole page."""
    out, at = [], 0
    body = OLD_HIDDEN.sub(" ", body)
    for tag in W.TAG.finditer(body):
        out += [body[at:tag.start()].replace("\n", " "), "\n" if (tag[2] or "").lower() in W.BREAKS else ""]
        at = tag.end()
    lines = (W.one_line(line) for line in "".join([*out, body[at:].replace("\n", " ")]).split("\n"))
    return "\n".join(line for line in lines if line)


def test_texts_of_broken_pages():
    import random

    rng = random.Random(5)
    parts = ["<p>", "a", " b\n", "<!--", "-->", "<script>", "</script>", "<title>", "</title>", "<a href='x>y'>", ">", "<", "<br", "&amp;", "<style x", "'", '"']
    for _ in range(20_000):
        body = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert W.page_text(body) == old_text(body), body
    assert W.page_facts("<title a><title>x</title>")["title"] == "<title>x"


def test_hostile_pages_take_linear_time():
    import time

    for unit in ("<title>", "<script ", "<title", "<!-- <script>", "<style>", "</title ", "<p "):
        started = time.process_time()
        W.derive("<urn:uuid:1>", None, None, None, unit * (5_000_000 // len(unit)))
        assert time.process_time() - started < 20, unit


def test_given_headers_and_digest_are_kept(spark):
    warc = "WARC-Payload-Digest: sha256:abc\r\nWARC-IP-Address: 10.0.0.1\r\nWARC-Type: response\r\n"
    rows = spark.createDataFrame([(1, "<urn:uuid:1>", "u", "d", None, "x", warc), (2, "<urn:uuid:2>", "u", "d", None, "x", None)], (
        "key long, source_id string, target string, date string, head string, body string, warc string"))
    found = {(r.key, r.record_type): r for r in W.derivatives(rows).collect()}
    assert found[1, "conversion"].source_payload_digest == "sha256:abc" and found[2, "conversion"].source_payload_digest == W.digest(b"x")
    ((_, block),) = W.split_archive(found[1, "metadata"].record.encode() + b"\r\n\r\n")
    kept = json.loads(block)["warc"]
    assert kept["WARC-IP-Address"] == "10.0.0.1" and kept["WARC-Payload-Digest"] == "sha256:abc" and kept["WARC-Record-ID"] == "<urn:uuid:1>"
