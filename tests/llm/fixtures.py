"""Small tables with every awkward case, and plain-Python versions of the word split."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, key int, words array<string>"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, size=400):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(size)) for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(60, 200)) for _ in range(8)]
    passage = sentence(rng, 70)
    out = list(base)
    out += [base[0], base[0], base[1]]                                  # exact copies
    near = base[2].split()
    near[10] = "changed"
    out.append(" ".join(near))                                          # a near copy
    out += [sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 30) for _ in range(4)]
    out += [base[3] + "\t\t" + passage, passage]
    out += [None, "", " \n\t ", "one", "a b c d", "a b c d e", "été   zwei drei ß 日本語 🙂 \x1c x"]
    out.append("loop " * 300)                                           # one word again and again
    out.append("\n".join(["alpha beta", "gamma", "delta epsilon"] * 4))
    out.append("x" * 20000)                                             # one very long word
    out.append(sentence(rng, 30000))                                    # a very long text
    return out


def documents(spark, rows=None, ids=None):
    """Texts under ids 0, 1, ... with further columns whose names operators use inside; the last row is repeated
    and one row has a null id and nulls in every other column."""
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    data = [(i, t, "en" if i % 3 else None, "s", None, 7, "h", 1, ["w"]) for i, t in zip(ids, rows)]
    if data:
        data += [data[-1], (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
