import hashlib
import random
from collections import Counter

from fixtures import documents, empty, sentence, texts, words

from arcweave.llm import phrases
from arcweave.llm.phrases import remove_repeats


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            x = tuple(w[p:p + window])
            k = (i is not None, i or 0)
            if x not in first or k < first[x]:
                first[x] = k
    out = Counter()
    for i, t in rows:
        w, cover = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (i is not None, i or 0):
                cover.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in cover)
        out[i, len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def check(spark, rows, ids=None, **kw):
    df = documents(spark, rows, ids)
    got = Counter(tuple(r) for r in remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], kw.get("window", 50))


def test_matches_brute_force(spark):
    rows = texts()
    check(spark, rows)
    check(spark, rows[::-1])
    check(spark, rows, window=12, phrase=3)


def test_shared_passages_of_all_lengths(spark):
    rng = random.Random(8)
    rows = []
    for n in (49, 50, 51, 60, 130):
        p = sentence(rng, n)
        rows += [sentence(rng, rng.randrange(20)) + " \n" + p + "\t" + sentence(rng, rng.randrange(20)) for _ in range(5)]
    rows += [" ".join(rows[3].split()[:55] + rows[9].split()[3:70])]
    check(spark, rows)
    check(spark, rows, part_bytes=1000)


def test_same_id_and_periodic_texts(spark):
    a = "one two three " * 60
    check(spark, [a, a, "x " + a, a + "y"], ids=[4, 4, 2, 9])


def test_empty(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_texts_under_a_null_id_are_spread(spark):
    rng = random.Random(6)
    rows = [sentence(rng, 60) for _ in range(900)]
    df = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    seen = []
    real = phrases._located

    def spy(part_rows, *rest):
        seen.append({r["part"]: r["count"] for r in part_rows.filter("kind = 2").groupBy("part").count().collect()})
        return real(part_rows, *rest)

    phrases._located = spy
    try:
        assert phrases.remove_repeats(df).count() == len(rows)
    finally:
        phrases._located = real
    assert len(seen[0]) >= 8 and max(seen[0].values()) < 2 * len(rows) / len(seen[0])
