from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import BLOCK_WORDS, Mix, permuted, targets
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA, first_plan


def _reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the words of the definition: stop at the bound, share the excess again, until none
    is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 1000, "c": 10, None: 5},
        {"a": 10**9, "b": 1, "c": 1, "d": 0},
        {"b": 7, "a": 7, "é": 7, "Z": 7},
        {"a": 0, "b": 0},
        {"only": 12},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    expected = _reshared(sizes)
    assert set(got) == set(sizes)
    for source, target in expected.items():
        assert got[source] == pytest.approx(target)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutations_hit_every_index(spark, n):
    mirrors = F.array(*[F.struct(F.lit(r).cast("long").alias("round"), F.lit((r * 77 + 5) % n).cast("long").alias("at"))
                        for r in range(32)])
    moved = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"), mirrors).alias("x"))
    got = [r.x for r in moved.collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert sum(a == b for a, b in enumerate(got)) < n / 20


def test_blocks_are_the_words_and_slots_without_gaps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mix = Mix(docs, keep_text=True, shard_slots=100)
    rows = mix.blocks().collect()
    assert len(rows) == mix.n_slots
    assert sorted((r.shard, r.slot) for r in rows) == [divmod(i, 100) for i in range(mix.n_slots)]
    words = defaultdict(list)
    for r in docs.orderBy("source", "doc_id").collect():
        found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        words[r.source] += found
    times = Counter()
    for r in rows:
        whole = words[r.source]
        assert r.words == whole[r.block * BLOCK_WORDS : (r.block + 1) * BLOCK_WORDS]
        times[r.source, r.block] += 1
    assert max(times.values()) <= 2
    # A source's blocks are all taken once before any is taken twice.
    for source, whole in words.items():
        counts = [times[source, b] for b in range(-(-len(whole) // BLOCK_WORDS))]
        assert max(counts) - min(counts) <= 1
    # Shards hold the sources in proportion, but not in equal parts.
    shares = Counter((r.shard, r.source) for r in rows)
    assert len({shares[s, "src0"] for s in range(mix.n_slots // 100)}) > 1


def test_taken_words_come_near_the_targets_and_reruns_agree(spark, conf):
    rows = QUERIES["op11_mixing"](spark, DATA).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for name, wanted in target.items():
        assert abs(taken[name] - wanted) <= BLOCK_WORDS
    conf(shuffle__partitions="7")
    assert sorted(QUERIES["op11_mixing"](spark, DATA).collect()) == sorted(rows)


def test_many_rows_of_one_id_and_source(spark):
    rows = [(1, "one two three", "s")] * 900 + [(i, "four five", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Mix(docs, block_words=16).taken().collect()
    assert len(got) == 1200
    assert all(r.taken <= 2 * r.size for r in got)
    by_size = Counter()
    for r in got:
        by_size[r.size, r.target] += r.taken
    for (_, target), taken in by_size.items():
        assert abs(taken - target) <= 16


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumn("source", F.when(F.col("row") % 3 > 0, F.concat(F.lit("s"), F.col("row") % 3)))
    docs = docs.withColumns({c: F.lit("x") for c in ("size", "block", "rank", "slot", "_range", "start")})
    rows = Mix(docs).taken().collect()
    assert len(rows) == odd.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    nothing = Mix(empty.withColumn("source", F.lit("s")))
    assert nothing.taken().collect() == [] and nothing.n_slots == 0
    blank = Mix(docs.filter("doc_id in (3, 4, 5)"))
    assert [r.taken for r in blank.taken().collect()] == [0, 0, 0]


def test_mix_is_written_in_slot_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mix = Mix(docs, keep_text=True, shard_slots=300)
    mix.write(str(tmp_path / "mix"))
    shard = spark.read.json(str(tmp_path / "mix" / "shard=1")).coalesce(1).collect()
    assert [r.slot for r in shard] == list(range(300))


def test_no_python_in_the_plan(spark):
    mix = Mix(spark.read.parquet(f"{DATA}/documents.parquet"))
    for frame in (mix.taken(), mix.slots, mix.spans()):
        assert "Python" not in first_plan(frame) and "Arrow" not in first_plan(frame)
