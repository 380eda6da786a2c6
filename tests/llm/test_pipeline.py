import public_tokenizers as P
import tiktoken
from fixtures import documents, texts, words
from test_decontaminate import shingles
from test_line_dedup import brute as brute_lines
from test_near_dup import jaccard
from test_quality import brute as brute_counts

import corpus_pipeline as cp
from arcweave.llm.bpe_tree import load_ranks
from arcweave.llm.near_dup import edit_distance_within
from arcweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registry():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def keep_quality(rows):
    """The few labels of this table certify no cutoff, so the base rules decide."""
    counts = {i: brute_counts(t) for i, t in rows.items()}
    return {i: t for i, t in rows.items() if counts[i][0] >= 20 and 100 * counts[i][4] <= 30 * counts[i][0]}


def keep_lines(rows):
    left = {i: x for (i, _), x in brute_lines(set(rows.items())).items()}
    return {i: x[2] for i, x in left.items() if x[1] == 0 or words(x[2])}


def keep_near(rows):
    ids, parent = sorted(rows), {i: i for i in rows}
    w = {i: words(t) for i, t in rows.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            limit = max(len(w[i]), len(w[j])) // 5
            if w[i] == w[j] or (abs(len(w[i]) - len(w[j])) <= limit and jaccard(w[i], w[j]) >= 0.4
                                and edit_distance_within(w[i], w[j], limit) is not None):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: t for i, t in rows.items() if find(i) == i}


def keep_clean(rows, items):
    sets = [s for s in map(shingles, items) if s]
    return {i: t for i, t in rows.items()
            if not any(len(s & shingles(t)) * 100 >= 80 * len(s) for s in sets)}


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    brute = [keep_quality, keep_lines, keep_near, lambda x: keep_clean(x, items)]
    sizes = [len(rows)]
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        now = docs.collect()
        if i < 4:
            rows = brute[i](rows)
            assert {r.doc_id: r.text for r in now} == rows, name
            assert name != "line dedup" or all(r.n_chars == len(r.text) for r in now)
        sizes.append(len(now))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0 and sizes[3] < sizes[0]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path(cp.RANKS)), special_tokens={})
    assert all(r.exact and r.ids == enc.encode_ordinary(rows[r.doc_id]) for r in now)
    assert {(r.doc_id, tuple(r.ids)) for r in cp.run(spark, SF).collect()} == {(r.doc_id, tuple(r.ids)) for r in now}


def test_awkward_rows_pass_through(spark):
    docs = documents(spark, texts()[:-1])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
