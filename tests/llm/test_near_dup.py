import random

import pyarrow as pa
from fixtures import documents, empty, sentence, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcweave.llm.common import keyed
from arcweave.llm.line_dedup import without_repeats
from arcweave.llm.near_dup import (SMALL, _can_be_rarest, _paired_here, _parities, band_distance, edit_distance_within,
                                   near_duplicates, one_per_class)
from arcweave.llm.wordhash import split_words, text_buffer


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=24), st.text("abc", max_size=24), st.integers(0, 14))
def test_banded_alignment_is_exact(a, b, band):
    d = levenshtein(a, b)
    want = d if d <= band else None
    assert band_distance(a, b, band) == want and edit_distance_within(a, b, band) == want


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / max(1, len(x | y))


def edit(rng, text, n):
    w = text.split()
    for _ in range(n):
        r, p = rng.random(), rng.randrange(len(w))
        if r < 0.5:
            w[p] = f"new{rng.randrange(999)}"
        elif r < 0.75:
            del w[p]
        else:
            w.insert(p, f"new{rng.randrange(999)}")
    return " ".join(w)


def corpus():
    """Groups of near copies, chains of them, and documents that share a passage and nothing else."""
    rng = random.Random(9)
    rows = texts()[:-1]
    for n in (40, 120, 400):
        base = sentence(rng, n, 10 ** 6)
        rows += [edit(rng, base, 1 + k % max(2, n // 40)) for k in range(12)]
    step = sentence(rng, 200, 10 ** 6)
    for _ in range(8):  # a chain: neighbours are near, its ends are not
        rows.append(step)
        step = edit(rng, step, 12)
    passage = sentence(rng, 60, 10 ** 6)
    rows += [passage + " " + sentence(rng, 120, 10 ** 6) for _ in range(60)]
    # half of one text and half of another: in buckets with both groups, near neither
    rows += [" ".join(rows[-1].split()[:90] + rows[-2].split()[90:])]
    return rows


def test_all_near_pairs_share_a_class_and_no_others(spark):
    rows = corpus()
    df = documents(spark, rows)
    cls = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    w = {i: words(t) for i, t in enumerate(rows)} | {None: []}
    parent = {i: i for i in w}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(w)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = w[i], w[j]
            limit = max(len(a), len(b)) // 5
            if a == b or (jaccard(a, b) >= 0.5 and edit_distance_within(a, b, limit) is not None):
                parent[find(i)] = find(j)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    got = {}
    for i, c in cls.items():
        got.setdefault(c, set()).add(i)
    assert sorted(map(sorted_ids, got.values())) == sorted(map(sorted_ids, groups.values()))


def sorted_ids(x):
    return sorted(-1 if i is None else i for i in x)


def test_rows_links_and_kept(spark):
    df = documents(spark, ["a b c d e f g h i j", "a b c d e f g h i j", "", None, "z"], ids=[5, 3, 8, 7, 3])
    out = near_duplicates(df).collect()
    assert len(out) == 7
    by = {(r.doc_id, r.class_id, r.kept) for r in out}
    assert by == {(5, 3, False), (3, 3, True), (8, None, False), (7, None, False), (None, None, True)}


def test_one_row_per_class(spark):
    df = documents(spark, corpus())
    out = one_per_class(df)
    classes = {r.class_id for r in near_duplicates(df).collect()}
    assert out.columns == df.columns and sorted_ids([r.doc_id for r in out.collect()]) == sorted_ids(classes)


def test_large_group_of_copies(spark):
    rng = random.Random(4)
    base = sentence(rng, 150, 10 ** 6)
    rows = [base] * 300 + [edit(rng, base, 2) for _ in range(300)]
    out = near_duplicates(documents(spark, rows)).filter("doc_id is not null").collect()
    assert {r.class_id for r in out} == {0}


def test_star_of_variants_is_one_class(spark):
    """All are near the base, those of different groups are not near each other."""
    rng = random.Random(12)
    base = sentence(rng, 350, 10 ** 6).split()
    rows = [" ".join(base)]
    for k in range(7):
        cut = " ".join(base[:50 * k] + base[50 * k + 50:])
        rows += [edit(rng, cut, 1 + n % 3) for n in range(16)]
    w = [words(t) for t in rows]
    near = lambda x, y: edit_distance_within(x, y, max(len(x), len(y)) // 5) is not None
    assert len(rows) > 100 and all(near(w[0], x) for x in w) and not near(w[1], w[40])
    for order in (rows, rows[::-1]):
        out = near_duplicates(documents(spark, order)).filter("doc_id is not null").collect()
        assert {r.class_id for r in out} == {0}


def test_many_texts_with_one_passage_and_two_near_ones(spark):
    """A large bucket of texts that are not near holds pairs that are."""
    rng = random.Random(13)
    passage = sentence(rng, 60, 10 ** 6)
    rows = [passage + " " + sentence(rng, 60, 10 ** 6) for _ in range(150)]
    for i in range(20):
        x = rows[i].split()
        for p in rng.sample(range(60, 120), 18):
            x[p] = f"new{rng.randrange(10 ** 6)}"
        rows.append(" ".join(x))
    cls = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert all(cls[i] == (i - 150 if i >= 150 else i) for i in range(len(rows)))


def test_large_buckets_over_few_words_lose_no_pair(spark):
    """Texts in large buckets of two passages, whose rarest words are common to many, against all pairs."""
    rng = random.Random(15)
    parts = [sentence(rng, 45, 6) for _ in range(2)]
    rows = [parts[i % 2] + " " + sentence(rng, 50, 6) + (" " + parts[1 - i % 2] if i % 5 == 0 else "") for i in range(120)]
    for i in range(40):
        rows.append(edit(rng, rows[i], 3 + i % 15))
    w = [words(t) for t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and edit_distance_within(w[i], w[j], max(len(w[i]), len(w[j])) // 5) is not None:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    cls = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).filter("doc_id is not null").collect()}
    assert [cls[i] for i in range(len(rows))] == label and len(set(label)) < 125


def test_pairs_at_the_edit_limit_are_found(spark):
    rng = random.Random(14)
    rows = []
    for i in range(120):
        x = sentence(rng, 300, 10 ** 6).split()
        rows.append(" ".join(x))
        for p in rng.sample(range(300), 45 if i % 2 else 60):  # 15 or 20 % of the words
            x[p] = f"new{rng.randrange(10 ** 6)}"
        rows.append(" ".join(x))
    cls = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    met = [cls[2 * i] == cls[2 * i + 1] for i in range(120)]
    assert all(met[1::2]) and sum(met[::2]) >= 57


def test_texts_of_null_and_repeated_ids_stay(spark):
    rng = random.Random(15)
    a, b, c, d = (sentence(rng, 60, 10 ** 6) for _ in range(4))
    near = edit(rng, c, 2)
    df = documents(spark, [a, b, a, c, d, near, d], ids=[-1, -1, 7, -1, 7, 9, 8])
    df = df.withColumn("doc_id", F.expr("nullif(doc_id, -1)"))
    got = {(r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(None, None, True), (7, None, False), (7, 7, True), (8, 7, False), (9, None, False)}
    kept = sorted((r.doc_id or 0, r.text or "") for r in one_per_class(df).collect())
    assert kept == sorted([(0, ""), (0, a), (0, b), (0, c), (7, d)])


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0 and one_per_class(empty(spark)).count() == 0


def test_short_texts_miss_no_pair(spark):
    rng = random.Random(16)
    rows = []
    for n in (5, 6, 7, 10, 15, 20, 30):
        for _ in range(40):
            x = sentence(rng, n, 10 ** 6)
            y = x.split()
            for p in rng.sample(range(n), n // 5):
                y[p] = f"new{rng.randrange(10 ** 6)}"
            rows += [x, " ".join(y)]
    cls = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert all(cls[2 * i] == cls[2 * i + 1] == 2 * i for i in range(len(rows) // 2))


def test_parities_never_exclude_near_texts():
    rng = random.Random(17)
    for _ in range(200):
        a = sentence(rng, rng.randrange(1, 300), 40)
        n = rng.randrange(1, 1 + len(a.split()))
        b = edit(rng, a + " tail", n)
        data, offsets = text_buffer(pa.array([a + " tail", b]))
        w = split_words(data, offsets)
        x, y = _parities(w, w.hashes(1), 2)
        assert sum(int(v).bit_count() for v in x ^ y) <= 2 * n


def test_further_columns_keep_their_values(spark):
    df = documents(spark, corpus()[:30]).selectExpr(
        "*", "'d' as __d", "'k' as kept_key", "'h' as KEPT_HASH", "1 as kept_rows", "doc_id as changed_text", "2 as __text",
        "3 as changed_key", "4 as changed_hash")
    for out in (one_per_class(df), without_repeats(df, n_chars="n_chars")):
        assert out.columns == df.columns
        for r in out.collect():
            assert (r["__d"], r["kept_key"], r["KEPT_HASH"], r["kept_rows"], r["changed_text"], r["__text"]) == (
                "d", "k", "h", 1, r.doc_id, 2)


def test_two_texts_are_paired_in_one_of_the_large_buckets_they_share(spark):
    def pairs(n, head, hx, large, gx):
        rows = spark.createDataFrame([(b, n, head, hx, large, gx) for b in (11, 12, 13, 14)],
                                     "bucket long, n long, head array<long>, hx array<long>, large array<long>, gx array<long>")
        return [r.bucket for r in rows.filter(_paired_here()).collect()]

    many = SMALL + 1
    assert pairs(many, [1, 2], [3, 4], [10, 12, 11, 13, 14], [9, 12, 11, 13, 14]) == [12]
    assert pairs(many, [1, 13], [3, 13], [12, 11, 13, 14], [12, 11, 13, 14]) == [13]
    assert pairs(SMALL, [1, 2], [3, 4], None, None) == [11, 12, 13, 14]
    assert pairs(many, None, None, None, None) == [11, 12, 13, 14]


def test_texts_that_share_a_passage_come_apart_and_near_ones_among_them_are_found(spark):
    rng = random.Random(18)
    passage = [f"p{i}" for i in range(160)]
    rows = []
    for i in range(90):  # own words beyond a fifth, fewer rare ones: texts meet by many words of the passage
        own = [f"o{i}x{j}" for j in range(14)] + rng.choices(["of", "the", "and"], k=31)
        rows += [" ".join(passage + own)]
    rows += [r.replace("o3x1 ", "new ") for r in rows[3:4]] + ["of the and " * 15 for _ in range(300)]
    out = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    near = [(i, j) for i in range(91) for j in range(i) if levenshtein(rows[i].split(), rows[j].split())
            <= max(len(rows[i].split()), len(rows[j].split())) // 5]
    assert out[90] == out[3] and all(out[i] == out[j] for i, j in near)


def test_rows_stored_by_a_key_are_joined_without_a_shuffle(spark):
    rows = keyed(spark.range(1000).selectExpr("id as rep", "'x' as text").groupBy("rep").agg(F.first("text").alias("text")),
                 "by-key", "rep")
    pairs = spark.range(50).selectExpr("id as a", "id + 1 as b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = pairs.join(rows.withColumnRenamed("rep", "a"), "a")
        assert df._jdf.queryExecution().sparkPlan().toString() and df.count() == 50
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows.count() == 1000


def test_a_place_excludes_a_word_only_if_too_few_words_are_left(spark):
    df = spark.createDataFrame([(20, 100), (21, 100), (0, 79), (None, 1)], "place int, n_words long")
    got = df.select(_can_be_rarest("place", "n_words", F.lit(80)).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, True]
