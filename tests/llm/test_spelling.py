import random
import re
import zlib
from collections import Counter

from fixtures import documents, empty, texts

from arcweave.llm import spelling as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TO_LOWER = str.maketrans(V.UPPER, V.LOWER)


def brute_counts(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall((text or "").translate(TO_LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    nears = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in nears.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(nears[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def dictionary(seed, size=250):
    rng = random.Random(seed)
    n = {}
    while len(n) < size:
        if n and rng.random() < 0.7:
            w = list(rng.choice(list(n)))
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randrange(2)] = rng.choice(["", "a", "l", "é", "aa"])
            w = "".join(w)
        else:
            w = "".join(rng.choice("abléÿ") for _ in range(rng.randrange(1, 9)))
        if w:
            n[w] = 2 ** rng.randrange(12) + rng.randrange(2)
    return n


def test_neighbours_and_forms_match_brute_force(spark):
    for seed, parts in ((1, 1), (2, 5), (3, 40)):
        n = dictionary(seed)
        df = spark.createDataFrame([(w, c, 1) for w, c in n.items()], "word string, n long, path int").repartition(3)
        pairs = sorted((r.word, r.near) for r in V.neighbours(df, parts).collect())
        assert pairs == sorted((a, b) for a in n for b in n if near(a, b))
        assert got(V.variants(df, parts=parts)) == brute_variants(n)


def test_nodes_are_one_number_a_prefix(spark):
    n = [*dictionary(4, 300), "a" * 3000, "a" * 2999 + "b"]
    for parts in (1, 7, 60):
        seen = {}
        for r in V.trie_paths(spark.createDataFrame([(w,) for w in n], "word string"), parts=parts).collect():
            assert len(r.path) == len(r.word) + 1 and r.path[0] == 0
            for i, node in enumerate(r.path):
                assert seen.setdefault(r.word[:i], node) == node
        assert len(set(seen.values())) == len(seen) and set(w for w in n) <= set(seen)


def test_long_chain_of_forms(spark):
    words = ["start" + "x" * i for i in range(50)]
    n = {w: 2 ** i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(V.variants(df)) == brute_variants(n)
    assert {r.root for r in V.variants(df).collect()} == {words[-1]}


def test_whole_documents(spark):
    rng = random.Random(9)
    base = ["tionment", "Entreprise", "ÉtéÀstraße", "hello", "letters"]
    rows = texts() + [" ".join(rng.choice(base) + rng.choice(["", "s", "-x", "1"]) for _ in range(400)) for _ in range(30)]
    df = documents(spark, rows)
    want = brute_counts([(r.doc_id, r.text) for r in df.collect()])
    counts = V.word_counts(df)
    assert {r.word: r.n for r in counts.collect()} == want
    assert got(V.variants(counts)) == brute_variants(want)
    assert any(f for *_, f, _, _ in brute_variants(want))


def test_nulls_and_empty(spark):
    assert V.variants(V.word_counts(empty(spark))).count() == 0
    df = spark.createDataFrame([(None, 3), ("abcde", None), ("abcde", 4), ("abcde", 1)], "word string, n long")
    assert got(V.variants(df)) == [("abcde", 5, 0, None, None, "abcde")]
