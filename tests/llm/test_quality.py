import math
import random
import re
from collections import Counter

import numpy as np
from fixtures import documents, empty, sentence, words

from arcweave.llm import quality as q


def brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i:i + 8])] > 1:
            cover.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, lang string")


def test_counts_match_brute_force(spark):
    df = documents(spark)
    out = q.judge(df, labels(spark, []))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                  for r in out.collect())
    want = Counter()
    for r in df.collect():
        b = brute(r.text)
        bad = b[0] < 20 or 100 * b[4] > 30 * b[0]
        want[(r.doc_id, *b, bad, not bad)] += 1
    assert got == want


def test_binomial_is_exact():
    for n, p in ((1, 0.3), (7, 0.01), (60, 0.2), (400, 0.011)):
        for k in range(0, n + 1, max(1, n // 9)):
            want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(q.binomial_cdf(k, n, p) - want) < 1e-10
    assert abs(q.upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9


def test_cutoff_needs_enough_good_labels_and_a_gain():
    bad = np.zeros(102, dtype=int)
    bad[60] = 50
    good = np.zeros(102, dtype=int)
    good[2] = 50
    assert q.choose_cutoff(good, bad, 0.01, 0.01) is None       # too few to certify anything
    good[2] = 2000
    c = q.choose_cutoff(good, bad, 0.01, 0.01)
    assert 2 <= c < 60
    assert q.choose_cutoff(good, np.zeros(102, dtype=int), 0.01, 0.01) is None
    good[90] = 40                                               # 2 % good texts over 60: not certified
    assert q.choose_cutoff(good, bad, 0.01, 0.01) is None


def test_false_rejections_stay_below_alpha():
    rng, alpha, delta, over = np.random.default_rng(3), 0.02, 0.1, 0
    for _ in range(200):
        good = np.bincount(np.minimum(rng.geometric(0.08, 3000), 101), minlength=102)
        bad = np.bincount(np.minimum(rng.geometric(0.02, 300), 101), minlength=102)
        c = q.choose_cutoff(good, bad, alpha, delta)
        over += c is not None and 0.92 ** c > alpha
    assert over <= 200 * delta


def test_certified_rate_rejects_bad_texts_only_in_its_stratum(spark):
    rng = random.Random(1)
    rows, lab = [], []
    for i in range(1500):
        bad = i % 10 == 0
        t = sentence(rng, 30, 10 ** 6)
        rows.append((i, t.replace(" ", "%%% ") if bad else t, "en"))
        lab.append((i, 0 if bad else 1, 0, "x"))
    rows += [(9000, sentence(rng, 30).replace(" ", "%%% "), "en"), (9001, sentence(rng, 30).replace(" ", "%%% "), "fr"),
             (9002, sentence(rng, 30), None)]
    lab += [(9001, None, None, None), (None, 1, 0, None), (0, 0, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in q.judge(df, labels(spark, lab)).collect()}
    assert all(out[i].kept == (i % 10 != 0) for i in range(1500))
    assert not out[9000].kept and out[9000].failed == ["symbols"] and out[9001].kept and out[9002].kept
    kept = q.keep_documents(df, labels(spark, lab))
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out.values())


def test_empty(spark):
    assert q.judge(empty(spark), labels(spark, [(1, 1, 0, "x")])).count() == 0
    assert q.keep_documents(empty(spark), labels(spark, [])).count() == 0
