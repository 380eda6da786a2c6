import hashlib
import random
import re

from fixtures import documents, empty, texts

from arcweave.llm import frames as Z

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = sha(f"42:{'null' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return key, n, form, len(p), len(m), sha(out), sha(text)


def got(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)
                   for r in df.collect()), key=repr)


def awkward():
    rng = random.Random(8)
    odd = ["a <P> b c d", "<S>", "x <M", "<P", "< P> <<S> >M<", "\n\n a\tb \x0b", "\x1f a\x85b  c d", "é" * 9 + " ",
           "<" * 40 + " " + "P>" * 30, "🙂 <\n" * 50]
    return texts() + odd * 3 + ["".join(rng.choice("<PSM> \né") for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def test_every_text_matches_brute_force(spark):
    df = documents(spark, awkward())
    want = sorted((brute(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    for size in (1, 7, 300, Z.FRAME_BYTES):
        if size > 1:
            assert got(Z.fill_in_middle(Z.store(df, frame_bytes=size), frame_bytes=size)) == want
        else:
            few = documents(spark, awkward()[30:60])
            assert got(Z.fill_in_middle(Z.store(few, frame_bytes=1), frame_bytes=1)) == sorted(
                (brute(r.doc_id, r.text) for r in few.collect()), key=repr)
    assert Z.fill_in_middle(Z.store(empty(spark))).count() == 0


def test_frames_hold_the_text_and_its_counts():
    rng = random.Random(3)
    for t in awkward() + ["".join(rng.choice("ab \n日") for _ in range(3000))]:
        data = (t or "").encode()
        f = Z.FrameWriter(100).text(data)
        units = UNIT.findall(t or "")
        assert b"".join(Z.read_bytes(f, 0, len(data))) == data
        assert (f.units[-1], f.chars[-1], f.bytes[-1]) == (len(units), len(t or ""), len(data))
        ends = Z.unit_ends(data).tolist()
        assert [data[i:j].decode() for i, j in zip([0, *ends], ends)] == units
        for u in {0, len(units) // 3, len(units)}:
            before = "".join(units[:u])
            assert Z.seek_unit(f, u) == (len(before.encode()), len(before))


def test_only_the_cut_frames_are_opened(monkeypatch):
    data = b" word" * 10000
    f = Z.FrameWriter(500).text(data)
    opened = []
    real = Z._unzip
    monkeypatch.setattr(Z, "_unzip", lambda x: opened.append(1) or real(x))
    Z.seek_unit(f, 7777)
    assert len(opened) == 1 and len(f.frames) == 100
    assert b"".join(Z.read_bytes(f, 1000, 1600)) == data[1000:1600] and len(opened) == 3


def test_output_frames_give_output_and_text(spark):
    df = documents(spark, awkward()[:20], range(20)).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = Z.fill_in_middle(Z.store(df), with_output=True).collect()
    source = {r.doc_id: r.text or "" for r in df.collect()}
    for r in rows:
        out = b"".join(map(Z._unzip, r.output_frames))
        assert hashlib.sha256(out).hexdigest() == r.output_sha256 and r.output_bytes[-1] == len(out)
        f = Z.Frames([], [], r.output_bytes, r.output_frames)
        assert b"".join(Z.restored_pieces(f, r.form)).decode() == source[r.doc_id]


def test_select_units(spark):
    df = documents(spark)
    t = Z.store(df, frame_bytes=50).selectExpr("*", "3L as lo", "40L as hi")
    want = sorted(((r.doc_id, "".join(UNIT.findall(r.text or "")[3:40])) for r in df.collect()), key=repr)
    assert sorted(((r.doc_id, r.part) for r in Z.select_units(t, "lo", "hi").collect()), key=repr) == want
    none = Z.select_units(t.selectExpr("* except (lo, hi)", "9L lo", "2L hi"), "lo", "hi")
    assert {r.part for r in none.collect()} == {""}
