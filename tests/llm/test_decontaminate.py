from fixtures import documents, empty, texts, words
from pyspark.sql import functions as F

from arcweave.llm.decontaminate import clean_documents, contained_items, item_sketches

ITEMS = "item_id long, text string, n int, item string"


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], ITEMS)


def some_items():
    rows = texts()
    w = [words(t) for t in rows]
    out = [(1, " ".join(w[0][5:40])), (2, " ".join(w[4][20:44])), (3, " ".join(w[-1][25000:25050]))]
    cut = w[5][10:50]
    cut[39] = "other"
    out.append((4, " ".join(cut)))                                  # 35 of 36 shingles
    out.append((5, " ".join(w[6][0:20] + ["q"] + w[6][20:30])))     # 22 of 27 shingles
    out.append((6, " ".join(w[7][0:12] + ["q"] + w[7][12:24])))     # 16 of 21: too few
    out += [(7, None), (8, ""), (9, "a b c d"), (10, "a b c d e"), (11, out[0][1]), (None, "no such words in any text")]
    out += [(20 + i, "the same first five words " + " ".join(w[i][:6])) for i in range(8)]
    return out


def test_matches_brute_force(spark):
    df, rows = documents(spark), some_items()
    want, first = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(tuple(words(t)), i)
    for r in df.collect():
        for i, t in rows:
            s = shingles(t)
            if s and i is not None and first[tuple(words(t))] == i and r.text is not None:
                n = len(s & shingles(r.text))
                if n * 100 >= 80 * len(s):
                    want[r.doc_id, i] = (sum(words(x) == words(t) for _, x in rows), n, len(s))
    got = {(r.doc_id, r.item_id): (r.n_items, r.n_shared, r.n_shingles) for r in contained_items(df, items(spark, rows)).collect()}
    assert got == want and {4, 5, 10} <= {i for _, i in got} and 6 not in {i for _, i in got}


def test_sketch_is_large_enough_for_its_partition(spark):
    base, sketch = item_sketches(items(spark, some_items()))
    n = {r.item_no: len(r.shingles) for r in base.collect()}
    per = {r.item_no: r["count"] for r in sketch.groupBy("item_no").count().collect()}
    for i, size in n.items():
        assert per[i] >= min(size, size * 20 // 100 + 1)


def test_clean_documents_keeps_the_rest(spark):
    df, rows = documents(spark), some_items()
    bad = {r.doc_id for r in contained_items(df, items(spark, rows)).collect()}
    out = clean_documents(df, items(spark, rows))
    assert out.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(
        repr(r.doc_id) for r in df.collect() if r.doc_id not in bad)


def test_empty_tables(spark):
    none = items(spark, [])
    assert contained_items(empty(spark), items(spark, some_items())).count() == 0
    assert contained_items(documents(spark), none).count() == 0
    assert clean_documents(documents(spark), none).count() == documents(spark).count()


def test_clean_rows_of_a_contaminated_id_stay(spark):
    bad = "this text holds all of the item in it and more"
    rows = ["a clean text of an id that is there twice", bad, "clean text with a null id", "other " + bad, "clean"]
    df = documents(spark, rows, ids=[1, 1, -1, -1, 2]).withColumn("doc_id", F.expr("nullif(doc_id, -1)"))
    out = clean_documents(df, items(spark, [(1, "holds all of the item in it")]))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [
        (0, ""), (0, rows[2]), (1, rows[0]), (2, "clean"), (2, "clean")]
