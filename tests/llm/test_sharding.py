import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkwell.llm import sharding as S


def test_query_with_messy_rows(spark, tmp_path, messy):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op7_rendezvous_shards(spark, str(tmp_path)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in messy.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, shard = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shard[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in shard.values())


def test_weights_and_few_moves(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    w = [1.0, 2.0, 0.0, 1.0]
    got = ids.select(S.shard_of(F.col("doc_id"), w).alias("a"), S.shard_of(F.col("doc_id"), [*w, 4.0]).alias("b")).collect()
    n = Counter(r.a for r in got)
    assert set(n) == {0, 1, 3} and abs(n[1] / 20_000 - 0.5) < 0.02
    moved = [r for r in got if r.a != r.b]
    assert {r.b for r in moved} == {4} and abs(len(moved) / 20_000 - 0.5) < 0.02


def test_empty_table(spark, nothing):
    assert S.assign(nothing, [1.0] * 8, [1.0] * 9).count() == 0
