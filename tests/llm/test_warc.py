import gzip
import hashlib
from collections import Counter

from arcweave.llm.components import components
from arcweave.llm.warc import assemble, page_results, read_records, write_captures

PAGES = "page_id long, url string, html string, record_id string, row int"


def pages(spark):
    long = "<p>é " + "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, "http://a/9", long), (1, "u", "short"), (2, "u", "short"),
            (4, None, None), (6, "http://a/ b\nc", ""), (7, "http://a/7", "y" * 99), (8, "http://a/8", "y" * 99),
            (10, "z", "y" * 100), (11, "z", "y" * 100), (None, "n", "y" * 100), (3, "http://a/3", long),
            (12, "big", "ü" * 300000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(4)


def brute(rows):
    first = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            first[b] = min(first.get(b, r.page_id), r.page_id)
    out, used = Counter(), set()
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        b = (r.html or "").encode()
        own = len(b) < 100 or (first.get(b) == r.page_id and b not in used)
        used.add(b)
        out[r.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if own else "revisit", None if own else first[b]] += 1
    return out


def test_pages_come_back(spark, tmp_path):
    df = pages(spark)
    path = str(tmp_path / "w")
    write_captures(df, path)
    out = page_results(spark, path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    assert got == brute(df.collect())
    raw = read_records(spark, path)
    assert Counter(r["type"] for r in raw.select("type").collect()) == {"request": 14, "response": 9, "revisit": 5, "metadata": 14}
    assert raw.filter("truncated").count() == 0
    nested = assemble(raw).collect()
    assert len(nested) == 14 and all(len(r.responses) == len(r.requests) == len(r.metadata) == 1 for r in nested)
    payload = {bytes(r.payload or b"") for r in raw.filter("type = 'response'").collect()}
    assert payload == {(r.html or "").encode() for r in df.collect()}


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    write_captures(pages(spark).limit(0), path)
    assert page_results(spark, path).count() == 0


def record(kind, rid, links=(), body=b"x", extra=b""):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\n" % (kind, rid)
    head += b"".join(b"WARC-Concurrent-To: %s\r\n" % x for x in links)
    return head + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members of their own, chains of links, several links, garbage between records and a cut-off end."""
    data = [record(b"warcinfo", b"w0"), record(b"response", b"r1", [b"q1"]), record(b"request", b"q1"),
            record(b"metadata", b"m1", [b"r1", b"q1"]), b"garbage\r\n", record(b"metadata", b"m2", [b"m1"]),
            record(b"response", b"r2"), record(b"request", b"q2", [b"r2"]), record(b"conversion", b"c2", [b"r2"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "b.warc").write_bytes(record(b"response", b"r3") + record(b"response", b"r4", body=b"0123456789")[:-8])
    raw = read_records(spark, str(tmp_path))
    assert {r.record_id for r in raw.filter("truncated").collect()} == {"r4"}
    got = set()
    for r in assemble(raw).collect():
        got.add(tuple(tuple(x.record_id for x in part) for part in (r.responses, r.requests, r.metadata, r.others)))
    assert got == {((), (), (), ("w0",)), (("r1",), ("q1",), ("m1", "m2"), ()), (("r2",), ("q2",), (), ("c2",)),
                   (("r3",), (), (), ()), (("r4",), (), (), ())}


def test_large_captures_are_split(spark, tmp_path):
    data = [record(b"response", b"r")] + [record(b"metadata", b"m%d" % i, [b"r"]) for i in range(50)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    out = assemble(read_records(spark, str(tmp_path)), max_records=10).collect()
    assert len(out) > 3 and {r.capture for r in out} == {"r"}
    assert sum(len(r.metadata) + len(r.responses) for r in out) == 51


def test_components_of_a_path_and_a_hub(spark):
    import random

    ids = list(range(200))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, ids[1:])) + [(1000, 1001 + i) for i in range(100)] + [(5000, 5000), (6000, 6001)]
    out = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in ids} | {1000 + i: 1000 for i in range(101)} | {6000: 6000, 6001: 6000}
    assert out == want
