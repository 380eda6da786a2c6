import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from fixtures import documents, empty, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm.bpe_tree import TreeBpe, _Known, _Pieces, digests, encode_decode, load_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    import regex

    ranks = load_ranks(PATH)
    own = TreeBpe(ranks)
    return (tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), own,
            _Pieces(_Known(own, regex.compile(P.PATTERN).findall)))


def ids(pieces, text):
    import numpy as np

    return np.frombuffer(pieces.ids(text), dtype=np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abe \n\t's1", max_size=200),
                 st.lists(st.sampled_from(["the", "ing", "é", " ", "heit", "'ll", "12", "\n", "a" * 9]), max_size=60).map("".join)))
def test_equals_the_library(coders, text):
    enc, own, pieces = coders
    got = ids(pieces, text)
    assert got == enc.encode_ordinary(text)
    assert own.decode(got) == text.encode()


def test_join_is_associative_and_has_a_unit(coders):
    _, own, _ = coders
    parts = [own.encode_tree(x.encode()) for x in ("there", "after", "wards", "s", "étéheit")]
    left = ()
    for p in parts:
        left = own.join(left, p)
    right = ()
    for p in reversed(parts):
        right = own.join(p, right)
    assert left == right == tuple(own.merge("thereafterwardsétéheit".replace("wards", "wardss").encode()))


def test_long_matches(coders):
    enc, own, pieces = coders
    for text in ("a" * 30001, "ab" * 9000, "=" * 5000, "é" * 4000, " " * 3000 + "x"):
        assert ids(pieces, text) == enc.encode_ordinary(text)


def test_direct_merging_agrees_with_the_heap(coders):
    _, own, _ = coders
    for t in texts()[:5]:
        word = t.replace(" ", "").encode()[:200]
        assert own._merge_long(word) == list(own.encode_tree(word))


def test_table(spark, coders):
    enc = coders[0]
    df = documents(spark)
    coded = encode_decode(df, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "ids", "decoded"]
    want = Counter()
    for r in df.collect():
        x = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in digests(coded).collect()) == want
    assert digests(encode_decode(empty(spark), PATH, P.PATTERN)).count() == 0
