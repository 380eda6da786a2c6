from collections import Counter

from fixtures import documents, empty, words

from arcweave.llm.line_dedup import dedup_lines, without_repeats


def brute(rows, window=3):
    """rows: unique (id, text). Text that is left by row."""
    seen = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    wins = {}
    for r in order:
        lines = None if r[1] is None else r[1].split("\n")
        for p in range(len(lines or []) - window + 1):
            w = tuple(lines[p:p + window])
            if words(" ".join(w)):
                wins.setdefault(w, []).append((r, p))
    cover = {r: set() for r in rows}
    for w, at in wins.items():
        for r, p in at[1:]:
            cover[r].update(range(p, p + window))
    for r in rows:
        if r[1] is not None:
            lines = r[1].split("\n")
            seen[r] = (len(lines), len(cover[r]), "\n".join(x for i, x in enumerate(lines) if i not in cover[r]))
        else:
            seen[r] = (0, 0, None)
    return seen


LINES = ["a\nb\nc\nd", "x\nb\nc\nd\ny", "a\nb\nc", "\n\n\n\n\n", "\n\n\n", "q\nq\nq\nq\nq", "a\nb", None, "",
         "k\n\nl\nm", "z\nk\n\nl\nm", "a\nb\nc\nd"]


def test_matches_brute_force(spark):
    df = documents(spark, LINES)
    rows = {(r.doc_id, r.text) for r in df.collect()}
    want = brute(rows)
    n = Counter((r.doc_id, r.text) for r in df.collect())
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(df).collect())
    assert got == Counter({(k[0], *want[k]): c for k, c in n.items()})


def test_whole_tables_keep_columns_and_drop_emptied_texts(spark):
    df = documents(spark, LINES)
    out = without_repeats(df, n_chars="n_chars")
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert 2 not in got and 11 not in got      # all words repeated
    assert got[7].text is None and got[8].text == "" and got[3].text == LINES[3]
    assert got[1].text == "x\ny" and got[1].n_chars == 3 and got[1].words == ["w"]


def test_empty(spark):
    assert dedup_lines(empty(spark)).count() == 0
    assert without_repeats(empty(spark)).count() == 0


def test_long_text_of_one_line_and_many_lines(spark):
    df = documents(spark, ["x" * 300000, "\n".join(f"l{i}" for i in range(30000)), "\n".join(f"l{i}" for i in range(30000))])
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(df).collect()}
    assert got == {0: (1, 0), 1: (30000, 0), 2: (30000, 30000), None: (0, 0)}
