import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import sharding
from tests.conftest import DATA


def plain_jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop(spark):
    keys = [0, 1, 2, 7, 10**9, 2**63 - 1, -1, -(2**63), *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 200):
        rows = df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
        assert {r.k: r.s for r in rows} == {k: plain_jump(k, n) for k in keys}


def test_one_shard_more_takes_rows_only_into_itself(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign_shards(docs).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 24 for r in moved)
    assert 100 < len(moved) < 320
    assert {r.shard for r in rows} == set(range(24))


def _check_slots(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_checksums_and_slots(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
    _check_slots(rows)
    by_shard = {}
    for r in sorted(rows, key=lambda r: r.slot):
        by_shard.setdefault(r.shard, []).append(r.doc_id)
    assert all(ids == sorted(ids) for ids in by_shard.values())


def test_a_hot_id_is_cut_over_ranges(spark, conf):
    conf(shuffle__partitions="8", adaptive__coalescePartitions__enabled="false")
    hot = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")
    )
    rows = sharding.assign_shards(hot).collect()
    _check_slots(rows)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1


def test_odd_rows(odd, empty):
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == odd.count()
    _check_slots(rows)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    assert {r.shard for r in rows if r.doc_id is None} == {plain_jump(0, 24)}
    assert sharding.assign_shards(empty).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.assign_shards(spark.read.parquet(f"{DATA}/documents.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(f"d{i % 40}", "text") for i in range(200)] + [(None, "x")], "doc_id string, text string")
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == 201 and len({r.shard for r in rows if r.doc_id == "d7"}) == 1
    assert len({r.shard for r in rows}) > 10
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
