import hashlib
import random

import xxhash
from fixtures import documents, empty, sentence, texts

from arcweave.llm import syncmers as S


def key_of(x):
    return x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) - (
        (1 << 64) if xxhash.xxh64_intdigest(x[1].encode(), 42) >> 63 else 0)


def chain(a, b):
    """Longest common subsequence of two sequences, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_anchors(text):
    """Closed syncmers straight from their definition, with the module's hash of an inner substring."""
    import numpy as np
    if not text:
        return []
    pad = [0x110000] * (S.K - S.LEAST)
    codes = pad + [ord(c) for c in text] + pad
    base = 0x9E3779B97F4A7C15

    def mix(x):
        return int(S._mix(np.array([x % (1 << 64)], np.uint64))[0])

    def poly(part):
        h = 0
        for c in part:
            h = (h * base + mix(c + base)) % (1 << 64)
        return h

    out = []
    for i in range(len(codes) - S.K + 1):
        mer = codes[i:i + S.K]
        order = [mix(poly(mer[j:j + S.S])) for j in range(S.K - S.S + 1)]
        if min(order) in (order[0], order[-1]):
            out.append((mix(poly(mer)) >> 32, i - (S.K - S.LEAST)))
    return out


def brute(rows):
    docs = sorted({(i, t or "") for i, t in rows}, key=key_of)
    following = {d: docs[(n + 1) % len(docs)] for n, d in enumerate(docs)}
    out = []
    for i, t in rows:
        t = t or ""
        nxt = following[(i, t)][1]
        half = len(t) // 2
        ed = t[:len(t) - half] + nxt[:half]
        a, e, x = (S.anchors(s) for s in (t, ed, nxt))
        out.append((i, len(t), hashlib.sha256(ed.encode()).hexdigest(), S.pack(a), S.pack(e),
                    round(S.likeness(a, e), 9), round(S.likeness(a, x), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                    round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


def test_every_row_meets_its_successor(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = S.successor_edits(df)
    assert got(out) == brute(rows)
    assert out.columns[0] == "doc_id"
    assert S.successor_edits(empty(spark)).count() == 0
    one = documents(spark, ["only " * 30], [4]).filter("doc_id = 4")
    assert {r.near_next for r in S.successor_edits(one).collect()} == {1.0}


def test_hot_ids_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(None, sentence(rng, 20)) for _ in range(80)] + [(7, "same row " * 9)] * 150 + [
        (rng.randrange(60), sentence(rng, 15)) for _ in range(120)] + [(None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.successor_edits(df)) == brute(rows)
    blocks = S._in_blocks(df.selectExpr("doc_id id", "xxhash64(coalesce(text, '')) h", "coalesce(text, '') text"), 8)
    sizes = [r["count"] for r in blocks.filter("mark = 0").groupBy("block").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 120  # the repeated row is dealt over blocks


def test_anchors_follow_the_definition():
    for t in ["", "a", "ab" * 9, "x" * 200, "été 日本語 🙂 " * 30, sentence(random.Random(2), 120)]:
        a = S.anchors(t)
        slow = slow_anchors(t)
        if slow or not t:
            assert list(zip(a[0].tolist(), a[1].tolist())) == slow
        else:
            assert len(a[0]) == 1
        h, p = S.unpack(S.pack(a))
        assert h.tolist() == a[0].tolist() and p.tolist() == a[1].tolist()


def test_chunks_do_not_show(monkeypatch):
    t = sentence(random.Random(3), 900)
    whole = S.pack(S.anchors(t))
    monkeypatch.setattr(S, "CHUNK", 77)
    assert S.pack(S.anchors(t)) == whole


def test_anchors_are_free_of_context_and_dense():
    rng = random.Random(4)
    passage = sentence(rng, 40)
    found = []
    for _ in range(5):
        left, right = sentence(rng, rng.randrange(5, 60)) + " ", " " + sentence(rng, 30)
        h, p = S.anchors(left + passage + right)
        inside = (p >= len(left)) & (p + S.K <= len(left) + len(passage))
        found.append([(int(x), int(y) - len(left)) for x, y in zip(h[inside], p[inside])])
        assert (p[1:] - p[:-1]).max() <= S.K - S.S
    assert all(f == found[0] for f in found) and found[0]


def test_likeness():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 40)
        a = [rng.randrange(30) for _ in range(n)]
        b = [x for x in a if rng.random() < 0.7] + [rng.randrange(30) for _ in range(5)]
        import numpy as np
        labelled = [S._labelled(np.array(x, np.uint32)).tolist() for x in (a, b)]
        mine = S.likeness((np.array(a, np.uint32), None), (np.array(b, np.uint32), None))
        assert mine == 1.0 if a == b else mine == 2 * chain(*labelled) / (len(a) + len(b))
    x, y = sentence(rng, 300), sentence(rng, 300)
    near = S.likeness(S.anchors(x), S.anchors(S.edited(x, y)))
    assert 0.4 < near < 0.6 and S.likeness(S.anchors(x), S.anchors(y)) < 0.05
    assert S.likeness(S.anchors(""), S.anchors("")) == 1.0 and S.likeness(S.anchors(""), S.anchors("a")) == 0.0


def test_fingerprints_and_anchor_table(spark):
    df = documents(spark)
    fp = sorted(((r.doc_id, r.n_chars, r.fingerprint) for r in S.fingerprints(df).collect()), key=repr)
    src = [(r.doc_id, r.text or "") for r in df.collect()]
    assert fp == sorted(((i, len(t), S.pack(S.anchors(t))) for i, t in src), key=repr)
    small = documents(spark, texts()[:6], range(6))
    want = sorted(((i, int(h), int(p)) for i, t in ((r.doc_id, r.text or "") for r in small.collect())
                   for h, p in zip(*S.anchors(t))), key=repr)
    assert sorted(((r.doc_id, r.hash, r.place) for r in S.anchor_table(small).collect()), key=repr) == want
