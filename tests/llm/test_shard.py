import struct
import zlib
from collections import Counter

import xxhash
from fixtures import documents, empty

from arcweave.llm.shard import assign_shards, moved, write_shards


def brute(key, weights):
    import math

    best = None
    for s, w in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", s), seed)
        score = -w / math.log(((h >> 11) + 0.5) / (1 << 53))
        if best is None or score > best[0]:
            best = (score, s)
    return best[1]


def test_shards_match_brute_force_and_slots_have_no_gaps(spark):
    df = documents(spark)
    weights, grown = [1.0, 2.0, 0.5, 1.0], [1.0, 2.0, 0.5, 1.0, 1.0]
    out = assign_shards(df, weights, grown=grown).collect()
    src = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in out))) == sorted(map(repr, (
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in src)))
    slots = {}
    for r in out:
        assert r.shard == brute(r.doc_id, weights) and r.grown_shard == brute(r.doc_id, grown)
        assert r.grown_shard in (r.shard, 4)
        slots.setdefault(r.shard, []).append(r.slot)
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))


def test_weights_give_shares_and_few_rows_move(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    out = assign_shards(df, [1.0, 3.0], grown=[1.0, 3.0, 1.0])
    n = Counter(r.shard for r in out.collect())
    assert abs(n[1] / 20000 - 0.75) < 0.02
    m = moved(out).collect()
    assert {r.grown_shard for r in m} == {2} and abs(sum(r.n_rows for r in m) / 20000 - 0.2) < 0.02


def test_hot_key_is_numbered_over_all_partitions(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'x' as text")
    rows = [r for r in assign_shards(df, [1.0] * 4).collect() if r.shard == brute(7, [1.0] * 4)]
    assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_empty_and_written_folders(spark, tmp_path):
    assert assign_shards(empty(spark), [1.0] * 3).count() == 0
    df = documents(spark)
    write_shards(df, str(tmp_path / "s"), [1.0] * 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == df.count()
    assert all(r.shard == brute(r.doc_id, [1.0] * 3) for r in back.select("doc_id", "shard").collect())
