"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, are cut into blocks of fixed length. The mix is a row
of output shards of fixed length, whose slots each take one block:

1. every slot draws its source, so a shard's counts by source are a multinomial draw with the targets
   as weights; what a source draws beyond its number of blocks goes to sources that drew too few;
2. the k-th slot of a source stands for a block index by a pseudorandom permutation of the source's
   block numbers, with another permutation for the second time round;
3. slots and blocks are joined by source and block index.

All draws are integer arithmetic on positions, so a rerun, a lost executor or another partitioning
gives the same mix, and SQL can restate it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words
MOST_TIMES = 2  # that a source, and so a document, may be taken
WORD = r"[^\x20\x09-\x0D]+"

ROUNDS = 32
PRIME = (1 << 31) - 1
# Multipliers of the generator, all below the prime: products stay below 2^62.
FACTORS = (1597334677, 812015047, 1103515245, 69621)
SLOTS_PER_TASK = 1 << 20
FAN = 4096  # counts that one running sum goes over


def _long(x):
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def _div(a, b) -> Column:
    return F.call_function("div", a, _long(b))


def mixed(a, b, c) -> Column:
    """A pseudorandom number from 0 to `PRIME - 1` for three whole numbers from 0 to 2^62."""
    a, b, c, prime = _long(a), _long(b), _long(c), _long(PRIME)
    t = ((a % prime) * _long(FACTORS[0]) + _div(a, prime)) % prime
    t = (t * _long(FACTORS[1]) + b % prime + 1) % prime
    t = (t * _long(FACTORS[2]) + c % prime + 1) % prime
    t = (t * t + _long(FACTORS[3])) % prime
    return (t * _long(FACTORS[0]) + _long(FACTORS[1])) % prime


def drawn(below: Column, a, b, c: int) -> Column:
    """A pseudorandom number from 0 to `below - 1`."""
    return (mixed(a, b, 2 * c) * _long(PRIME) + mixed(a, b, 2 * c + 1)) % below


def permuted(index: Column, n: Column, seed: Column, mirrors: Column) -> Column:
    """A permutation of 0 to `n - 1` by swapping or not: in each round an index and its mirror image
    change places or stay, by one bit drawn for the larger of both. `mirrors` has a number below `n`
    for each round."""

    def swap_or_not(x, mirror):
        image = (mirror["at"] + n - x) % n
        draw = mixed(F.greatest(x, image), seed, mirror["round"])
        return F.when(draw > _long(PRIME // 2), image).otherwise(x)

    return F.aggregate(mirrors, index, swap_or_not)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """Add `rank` (from 0, in code point order, null last) and `target` to the sources.

    `sizes` has one row for each `source` with its `source_size`. A target is the part of `share`
    times all sizes that goes with the source's weight, but `most` times its own size at most; what
    goes beyond is shared again by weight. Taken by size for weight, the first sources stand at their
    bounds, until one's weight gets less than its bound of what is left; from there on nobody's does
    more. With `share` above `most`, all stand at their bounds.
    """
    size, weight = F.col("source_size"), F.col("weight")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(size / weight, "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_sources = Window.partitionBy()
    cycle = F.array(*[_long(w) for w in weights])

    def left(c, times=1.0):
        return F.lit(times) * F.sum(c).over(all_sources), F.coalesce(F.sum(c).over(before), F.lit(0))

    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    (words, words_before), (parts, parts_before) = left(size, share), left(weight)
    ranked = ranked.withColumns(
        {"words_left": words - most * words_before, "weight_left": (parts - parts_before).cast("double")}
    )
    reached = most * size * F.col("weight_left") <= weight * F.col("words_left")
    ranked = ranked.withColumn("reached", reached)
    ranked = ranked.withColumn("at_bound", F.every("reached").over(so_far))
    # What the first source below its bound finds, which has the most weight left.
    rest = F.when(~F.col("at_bound"), F.struct("weight_left", "words_left"))
    ranked = ranked.withColumn("rest", F.max(rest).over(all_sources))
    shared = weight * F.col("rest.words_left") / F.col("rest.weight_left")
    target = F.when(F.col("at_bound"), (most * size).cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def _before(counts: DataFrame, group: list[str], index: str, count: str) -> DataFrame:
    """Add `before`, the sum of the counts of smaller indices in the group; one row for each group and
    index. Runs of `FAN` indices are summed first, so that no window goes over all of a large group."""
    run = _div(F.col(index), FAN)
    counts = counts.withColumn("_run", run)
    within = Window.partitionBy(*group, "_run").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(*group, "_run").agg(F.sum(count).alias("_sum"))
    runs = runs.withColumn("_earlier", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    inside = counts.withColumn("_inside", F.coalesce(F.sum(count).over(within), F.lit(0)))
    # The groups may be null.
    same = [inside[c].eqNullSafe(runs[c]) for c in [*group, "_run"]]
    joined = inside.join(runs, same)
    return joined.select(
        *[inside[c] for c in counts.columns if c != "_run"],
        (F.col("_inside") + F.col("_earlier")).alias("before"),
    )


class Mix:
    """The mix of one table: `sources`, `rows`, `slots`, and what follows from them.

    `rows` has one row for each row of `docs`: `row` (its number), `doc_id`, `source`, `size` (its
    words) and `start` (the words of the source before it). Documents of a source follow each other by
    id (null first) and size. A null text has no words, a null source is a source of its own, repeated
    rows count each, sources without words take no slots, an empty table gives an empty mix. Other
    columns of `docs` play no part. Tables are written below the shared folder.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS,
        weights=WEIGHTS,
        share: float = SHARE,
        most: int = MOST_TIMES,
        keep_text: bool = False,
    ):
        if share <= 0 or most < 1 or min(weights) < 1:
            raise ValueError("share, most and weights must be positive")
        self.spark = docs.sparkSession
        self.block_words, self.shard_slots, self.most = block_words, shard_slots, most
        self.scratch = Scratch(self.spark, "mix")
        text = F.col(text_col)
        sized = docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *([text.alias("text")] if keep_text else []),
        )
        self._number(self.scratch.store(sized, "sized"))
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self._plan(targets(sizes, weights, share, most))

    def _number(self, sized):
        """Sort the rows by ranges; a document's words follow those of the ranges and rows before."""
        order = ["source", "doc_id", "size", "_salt"]  # the salt cuts an id of many rows
        ranged = (
            sized.withColumn("_salt", F.monotonically_increasing_id())
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumn("row", F.monotonically_increasing_id())
            .drop("_salt")
        )
        ranged = self.scratch.store(ranged, "ranged")
        # The number of a row is that of its range and its place in it.
        ranged = ranged.withColumn("_range", F.shiftright("row", 33))
        words = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
        words = _before(words, ["source"], "_range", "_words").drop("_words")
        earlier = (
            Window.partitionBy("source", "_range")
            .orderBy("row")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        inside = ranged.select(
            "row", "source", "_range", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_in")
        )
        same = inside["source"].eqNullSafe(words["source"]) & (inside["_range"] == words["_range"])
        starts = inside.join(words, same).select(
            "row", inside["source"], "size", (F.col("_in") + F.col("before")).alias("start")
        )
        self.ranged = ranged
        self.rows = self.scratch.store(starts, "rows")

    def _plan(self, sources):
        """The number of blocks of each source, how many the mix takes, and where they stand in it."""
        size = F.col("source_size")
        blocks = _div(size + self.block_words - 1, self.block_words)
        wanted = F.floor(F.try_divide(F.col("target") * blocks, size) + 0.5)
        quota = F.coalesce(F.least(wanted, self.most * blocks), F.lit(0)).cast("long")
        until = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sources = sources.withColumns({"blocks": blocks, "quota": quota})
        sources = sources.withColumn("last", F.sum("quota").over(until))
        sources = sources.withColumn("first", F.col("last") - F.col("quota"))
        self.sources = self.scratch.store(sources.coalesce(1), "sources")
        figures = self.sources.agg(F.sum("quota").alias("slots"), F.count(F.lit(1)).alias("n")).first()
        self.n_slots = figures["slots"] or 0
        self.n_sources = figures["n"]
        self.slots = self.scratch.store(self._placed(self._sourced()), "slots")

    def _sourced(self):
        """Each slot with the source it drew, and the slot's number among the source's.

        A draw falls into a source's stretch of 0 to the number of slots. Stretches are looked up by
        the bin of the draw, of which there are four times as many as sources.
        """
        n = max(self.n_slots, 1)
        width = -(-n // (4 * max(self.n_sources, 1)))
        bins = F.sequence(_div(F.col("first"), width), _div(F.col("last") - 1, width))
        stretches = self.sources.filter("quota > 0").select("rank", "first", "last", F.explode(bins).alias("bin"))
        draw = drawn(_long(n), F.col("slot"), 1, 0)
        tasks = max(self.spark.sparkContext.defaultParallelism, self.n_slots // SLOTS_PER_TASK)
        slots = self.spark.range(0, self.n_slots, numPartitions=tasks).select(
            _div(F.col("id"), self.shard_slots).alias("shard"), F.col("id").alias("slot"), draw.alias("draw")
        )
        slots = slots.withColumn("bin", _div(F.col("draw"), width)).join(stretches, "bin")
        slots = slots.filter((F.col("first") <= F.col("draw")) & (F.col("draw") < F.col("last")))
        slots = self.scratch.store(slots.select("shard", "slot", "rank"), "drawn")
        counts = slots.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))
        # The multinomial counts of the output shards.
        self.counts = self.scratch.store(_before(counts, ["rank"], "shard", "n"), "counts")
        in_shard = Window.partitionBy("rank", "shard").orderBy("slot")
        slots = slots.withColumn("_in", F.row_number().over(in_shard).cast("long") - 1)
        return slots.join(self.counts, ["rank", "shard"]).select(
            "shard", "slot", "rank", (F.col("before") + F.col("_in")).alias("turn")
        )

    def _placed(self, slots):
        """Give the slots that their source drew beyond its quota to sources that drew too few, in the
        order of sources, and turn numbers among a source's slots into block indices."""
        got = self.counts.groupBy("rank").agg(F.sum("n").alias("n"))
        known = self.sources.join(got, "rank", "left")
        over = F.greatest(F.coalesce("n", F.lit(0)) - F.col("quota"), F.lit(0))
        under = F.greatest(F.col("quota") - F.coalesce("n", F.lit(0)), F.lit(0))
        earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        known = known.withColumns({"over": over, "under": under})
        known = known.withColumns(
            {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("over", "under")}
        )
        known = self.scratch.store(known.coalesce(1), "known")
        # As many as draws miss their means by, which grows with the square root of the slots.
        places = known.filter("under > 0").select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("place"),
            F.col("rank").alias("new_rank"), "under_before", (F.col("quota") - F.col("under")).alias("from"),
        )
        places = places.select(
            (F.col("under_before") + F.col("place")).alias("spare"),
            "new_rank",
            (F.col("from") + F.col("place")).alias("new_turn"),
        )
        beyond = F.col("turn") - F.col("quota")
        spare = F.when(beyond >= 0, F.col("over_before") + beyond)
        slots = slots.join(known.select("rank", "quota", "over_before"), "rank")
        slots = slots.withColumn("spare", spare).join(places, "spare", "left").select(
            "shard", "slot",
            F.coalesce("new_rank", "rank").alias("rank"), F.coalesce("new_turn", "turn").alias("turn"),
        )
        slots = slots.join(self._permutations(), "rank")
        index, n = F.col("turn") % F.col("blocks"), F.col("blocks")
        time = F.get("times", _div(F.col("turn"), n).cast("int"))
        return slots.select(
            "shard",
            (F.col("slot") % self.shard_slots).alias("slot"),
            "source",
            permuted(index, n, time["seed"], time["mirrors"]).alias("block"),
        )

    def _permutations(self):
        """For each source the numbers that its permutations use, one permutation for each time that
        its blocks may be taken: `most` times `ROUNDS` numbers."""

        def time(t):
            seed = F.col("rank") * self.most + t

            def mirror(r):
                return F.struct(r.alias("round"), drawn(F.col("blocks"), r, seed, 1).alias("at"))

            rounds = F.sequence(_long(0), _long(ROUNDS - 1))
            return F.struct(seed.alias("seed"), F.transform(rounds, mirror).alias("mirrors"))

        times = F.array(*[time(t) for t in range(self.most)])
        return self.sources.filter("quota > 0").select("rank", "source", "blocks", times.alias("times"))

    def spans(self):
        """The parts of documents that make up the blocks: row, source, block, from (its first word in
        the document), n_words. A block has at most `block_words` of them."""
        first, last = F.col("start"), F.col("start") + F.col("size")
        blocks = F.sequence(_div(first, self.block_words), _div(last - 1, self.block_words))
        rows = self.rows.filter("size > 0").select(
            "row", "source", first.alias("start"), last.alias("end"), F.explode(blocks).alias("block")
        )
        begin = F.greatest("start", F.col("block") * self.block_words)
        end = F.least("end", (F.col("block") + 1) * self.block_words)
        return rows.select(
            "row", "source", "block", (begin - F.col("start")).alias("from"), (end - begin).alias("n_words")
        )

    def taken(self) -> DataFrame:
        """One row for each row of the table: doc_id, size, source_size, target, taken (the words that
        the mix takes of it, as often as it takes them)."""
        times = self.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
        spans = self.spans()
        same = spans["source"].eqNullSafe(times["source"]) & (spans["block"] == times["block"])
        words = (
            spans.join(times, same)
            .groupBy("row")
            .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        )
        rows = self.ranged.select("row", "doc_id", "source", "size").join(words, "row", "left")
        sources = self.sources.select("source", "source_size", "target")
        rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"]), "left")
        return rows.select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )

    def blocks(self) -> DataFrame:
        """The mix itself: shard, slot, source, block, words (an array). Needs `keep_text`.

        Each text is cut once; the parts of a block, at most `block_words` words in all, meet in a
        shuffle, and the block is joined to the slots that take it.
        """
        texts = self.ranged.select("row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all"))
        texts = texts.join(self.rows.select("row", "source", "start", "size").filter("size > 0"), "row")
        length = self.block_words
        numbers = F.sequence(_div(F.col("start"), length), _div(F.col("start") + F.col("size") - 1, length))

        def part(block):
            begin = F.greatest(F.col("start"), block * length)
            end = F.least(F.col("start") + F.col("size"), (block + 1) * length)
            at, n = (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")
            return F.struct(block.alias("block"), begin.alias("begin"), F.slice("all", at, n).alias("words"))

        parts = texts.select("source", F.explode(F.transform(numbers, part)).alias("part"))
        parts = parts.select("source", "part.block", F.struct("part.begin", "part.words").alias("part"))
        whole = parts.groupBy("source", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        whole = whole.select("source", "block", F.flatten("parts.words").alias("words"))
        same = whole["source"].eqNullSafe(self.slots["source"]) & (whole["block"] == self.slots["block"])
        return self.slots.join(whole, same).select(
            "shard", "slot", self.slots["source"], self.slots["block"], "words"
        )

    def write(self, path: str):
        """Write the mix as one file of JSON lines for each shard, in the order of slots."""
        lines = self.blocks().repartition("shard").sortWithinPartitions("shard", "slot")
        lines.write.partitionBy("shard").json(path)
