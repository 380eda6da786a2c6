import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from fixtures import documents, empty, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arcweave.llm import idcoder as c


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.sampled_from([5, 6, 7])), max_size=700))
def test_round_trip(ids):
    a = np.array(ids, dtype=np.int64)
    assert c.decode_blocks(c.encode_blocks(a)).tolist() == ids


def test_round_trip_of_extremes_and_gain():
    rng = random.Random(1)
    for ids in ([65535] * 4000, [0] * 4000, list(range(0, 65536, 16)), [rng.choice([3, 900, 40000]) for _ in range(5000)]):
        a = np.array(ids)
        b = c.encode_blocks(a)
        assert c.decode_blocks(b).tolist() == ids
    cycle = np.array([rng.randrange(49000) for _ in range(50)] * 400)
    assert sum(len(b) for _, _, b in c.encode_blocks(cycle)) < len(cycle) * 2 / 3


def test_blocks_can_be_read_alone_and_damage_is_found():
    ids = np.array([random.Random(2).randrange(300) for _ in range(3000)])
    blocks = c.encode_blocks(ids)
    assert len(blocks) > 3 and sum(n for n, _, _ in blocks) == 3000
    at = sum(n for n, _, _ in blocks[:2])
    assert c.decode_blocks(blocks[2:3]).tolist() == ids[at:at + blocks[2][0]].tolist()
    n, crc, data = blocks[1]
    with pytest.raises(ValueError):
        c.decode_blocks([(n, crc, bytes([data[0] ^ 1]) + data[1:])])
    with pytest.raises(ValueError):
        list(c.read_frames(b"nothing of the kind" * 9))


def test_frames_follow_each_other():
    a = c.write_frame(3, 0, [1, None], [2, 1], np.array([7, 10, 49000]))
    b = c.write_frame(3, 1, [5], [0], np.array([], dtype=np.int64))
    x, y = c.read_frames(a + b"\n" + b + b"\n")
    assert x[:3] == (3, 0, [1, None]) and x[3].tolist() == [2, 1] and x[4].tolist() == [7, 10, 49000]
    assert y[:3] == (3, 1, [5]) and len(y[4]) == 0


def test_files_match_the_library(spark, tmp_path):
    df = documents(spark, texts()[:-1] + ["<|endoftext|> İΣΑΣ ǅ é  x y", "ẞ"])
    path = str(tmp_path / "ids")
    c.write_ids(df, path, P.path("word_bpe_49k.json"), part_bytes=3000)
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
    at, want = 0, []
    for known, i, t in rows:
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        want.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, len(r.data) // 4, zlib.crc32(r.data)) for r in c.read_ids(spark, path).collect()]
    assert sorted(got, key=lambda x: x[1]) == want


def test_words_and_whole_texts_give_the_ids_of_the_library():
    path = P.path("word_bpe_49k.json")
    tk, known = Tokenizer.from_file(path), c._Tokens(path)
    rows = [t or "" for t in texts()[:-1]] + [
        "< |endoftext|> İΣΑΣ ǅ é  x y", "<|end", "ẞ", "J\u030c. J, j\u030c! A\u0301; e.\u0301 É, ×. ÷! ß: ÿ? É. Ñ)) (a).",
        "It's, IT'S. don't! 'tis 'S o'RE. a'sb x'' 'll. we'LL, 1.5, v2.0; http://a.b/c?d=e&f_g #a@b [x] {y} a~ b` c^d",
        "K\u212a, \u0130. \u1e9e. \u00aa. \u00ba, a\u00b2. \u00df. \u0149. \u01f0. <|END, <|a b|> <|ENDOFTEXT"]
    rng = random.Random(5)
    signs = "aAzZ09.,'-_<|>()!?éÉñß×÷\u0301\u030c\u0338 \n\u3000\u00a0İıΣς"
    rows += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in rows:
        words = c.cut_words(t)
        known.fill(set(words))
        own = np.frombuffer(b"".join(known[w] for w in words), dtype="<u2").tolist()
        assert known.whole(t) is None and own == tk.encode(t, add_special_tokens=False).ids
    held = np.frombuffer(known.whole("a <|endoftext|>"), dtype="<u2").tolist()
    assert held == tk.encode("a <|endoftext|>", add_special_tokens=False).ids and held[1:] == [49407]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    c.write_ids(empty(spark), path, P.path("word_bpe_49k.json"))
    assert c.read_ids(spark, path).count() == 0
