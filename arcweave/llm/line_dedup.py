r"""Removal of repeated passages of lines: overlapping windows of three consecutive lines.

Every window of ``window`` consecutive lines (split at ``\n``, compared unchanged) is hashed to
128 bits. Windows that occur more than once anywhere are found by one aggregation, which keeps
the first occurrence: the smallest (document key, text hash, line number). All later
occurrences cover their lines; the covered positions of a document are merged into one set and
those lines removed.

The aggregation combines equal windows before the shuffle, so a window that a third of all
documents hold is a few partial rows per task. The joins carry no further grouping, so the
skew-join rule can split a hot window or document.

Defined results: a null text has no lines and stays null; a text with fewer lines than a window
is kept whole; a window without any word (only blank lines) does not count; a null key sorts
first; rows with the same key are told apart by their texts, and rows equal in both are one
occurrence that all of them keep; an empty table gives an empty result; further columns of the
input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import fresh, stored

WINDOW = 3


def _windows(lines: Column, window: int) -> Column:
    """Array with one struct (a, b) per window start; null where the window has no word."""
    n = F.greatest(F.size(lines) - F.lit(window - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(lines, F.lit(j), n).alias(f"l{j}") for j in range(1, window + 1)])

    def one(x: Column) -> Column:
        part = [x[f"l{j}"] for j in range(1, window + 1)]
        return F.when(F.concat_ws("", *part).rlike(r"[^\x20\x09-\x0D]"),
                      F.struct(F.xxhash64(F.lit(1), *part).alias("a"),
                               F.xxhash64(F.lit(2), *reversed(part)).alias("b")))

    return F.transform(parts, one)


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    # the outer form adds no filter that would compute the array a second time
    return (docs.select("key", "h", F.posexplode_outer(_windows(F.col("lines"), window)).alias("pos", "w"))
            .filter("w is not null").select("key", "h", "pos", "w.a", "w.b"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text",
                window: int = WINDOW) -> DataFrame:
    """One row per input row: key, n_lines, n_removed and the text that is left.

    The kept lines are joined by ``\\n``; a text that loses all its lines becomes empty.
    """
    docs = df.select(F.col(key).alias("key"),
                     F.xxhash64(F.col(text)).alias("h"),
                     F.split(F.col(text), "\n", -1).alias("lines"))
    occ = _occurrences(docs, window)
    repeated = (occ.groupBy("a", "b")
                .agg(F.min(F.struct("key", "h", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("a", "b", "first"))
    later = occ.join(stored(repeated, "repeated-windows"), ["a", "b"]).filter(
        ~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("h") == F.col("first.h"))
          & (F.col("pos") == F.col("first.pos"))))
    # at most one entry per line of the document
    covered = (later.groupBy(F.col("key").alias("ckey"), F.col("h").alias("ch"))
               .agg(F.collect_set("pos").alias("starts")))
    joined = docs.join(
        covered, F.col("key").eqNullSafe(F.col("ckey")) & (F.col("h") == F.col("ch")), "left")
    n = F.coalesce(F.size("lines"), F.lit(0))
    cover = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.lit(window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), cover)
    return (joined.withColumn("n_lines", F.when(F.col("lines").isNull(), 0).otherwise(n))
            .withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
            .select(F.col("key").alias(key), "n_lines",
                    F.when(F.col("starts").isNull(), 0)
                    .otherwise(F.col("n_lines") - F.size("kept")).alias("n_removed"),
                    F.array_join(F.when(F.col("starts").isNull(), F.col("lines")).otherwise(
                        F.transform("kept", lambda i: F.get(F.col("lines"), i))), "\n").alias("text"), "h"))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    n_chars: str | None = None) -> DataFrame:
    """``df`` with the cleaned texts and all other columns as they are; texts that lose all their words go.

    With ``n_chars`` that column is set to the new length. Only the changed texts are joined back.
    """
    out = dedup_lines(df, key, text, window).filter("n_removed > 0")
    k, h, t = fresh(df, "changed_key", "changed_hash", "changed_text")
    new = stored(out.select(F.col(key).alias(k), F.col("h").alias(h), F.col("text").alias(t)).distinct(), "changed-texts")
    both = df.join(new, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    both = both.filter(F.col(t).isNull() | F.col(t).rlike(r"[^\x20\x09-\x0D]"))
    cols = {text: F.coalesce(F.col(t), F.col(text))}
    if n_chars:
        cols[n_chars] = F.when(F.col(t).isNull(), F.col(n_chars)).otherwise(
            F.char_length(t).cast(df.schema[n_chars].dataType))
    return both.select(*[cols.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win FROM p),
v AS (SELECT * FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
f AS (SELECT win, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM v GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT v.doc_id, unnest([v.i, v.i + 1, v.i + 2]) AS i FROM v JOIN f USING (win)
      WHERE struct_pack(doc_id := v.doc_id, i := v.i) <> f.first),
x AS (SELECT doc_id, text, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text, count(*) AS n
      FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(d.l), 0) - coalesce(k.n, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
