import numpy as np
import pyarrow as pa
from fixtures import texts, words

from arcweave.llm.wordhash import chunks, split_words, text_buffer


def test_words_and_windows_match_python():
    rows = texts()
    data, offsets = text_buffer(pa.array(rows, pa.string()))
    for limit in (1, 500, 1 << 22):
        for i, j in chunks(offsets, limit):
            w = split_words(data, offsets[i:j + 1])
            h = w.hashes()
            for d in range(i, j):
                own = [w.data[a:b].tobytes().decode() for a, b in
                       zip(w.start[w.first[d - i]:w.first[d - i + 1]], w.end[w.first[d - i]:w.first[d - i + 1]])]
                assert own == words(rows[d])
            flat = [x for d in range(i, j) for x in words(rows[d])]
            seen = {}
            for x, y in zip(flat, h.tolist()):
                assert seen.setdefault(x, y) == y
            assert len(set(seen.values())) == len(seen)
            for k in (5, 50):
                g, seen = w.windows(h, k), {}
                for p in range(len(g)):
                    assert seen.setdefault(tuple(flat[p:p + k]), g[p]) == g[p]
                assert len(set(map(int, seen.values()))) == len(seen)


def test_hashes_do_not_depend_on_the_chunk():
    data, offsets = text_buffer(pa.array(["a b c d e f", "b c d e f g"]))
    w = split_words(data, offsets)
    h = w.hashes()
    g = w.windows(h, 5)
    assert g[1] == g[6] and np.array_equal(h[1:6], h[6:11])
