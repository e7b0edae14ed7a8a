"""Mixing sources to target weights.

The words of each source form one row of fixed-length blocks. Every output shard draws from a
multinomial how many blocks of each source it takes; its slots are numbered on through all shards,
mapped through a pseudorandom permutation of the source's blocks (another one for each time
through), and joined with the blocks by index. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.ordered import join_on_groups, row_positions, running_totals
from millrace.plans.staging import stage

BLOCK_WORDS = 32
SHARD_SLOTS = 16384
MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20
# Rounds of the swap-or-not permutation.
ROUNDS = 8
# Documents of a source that are put in order together, on average.
BUCKET_ROWS = 4096

SPACE = r"\x20\x09-\x0D"
_TRIMMED = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words with the white space after them; what stands before the first word is left out."""
    body = F.ltrim(text, F.lit(_TRIMMED))
    return F.when(F.length(body) > 0, F.split(body, f"(?<=[{SPACE}])(?=[^{SPACE}])")).otherwise(F.array().cast("array<string>"))


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    body = F.btrim(text, F.lit(_TRIMMED))
    return F.when(F.length(body) > 0, F.size(F.split(body, f"[{SPACE}]+"))).otherwise(0).cast("long")


def _uniform(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, sid, source_size, target`` from rows with ``source, size``.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes.
    A target stops at ``max_repeats`` times its source's size and the excess goes to the others by
    weight. With sources ordered by the level at which each one stops, the common level is the
    first one that its source does not stop below.
    """
    totals = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sources")
    ranked = row_positions(totals, [F.col("source").asc_nulls_last()], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    known = stage(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_repeats)), "mixing-weights")
    levels = running_totals(known.withColumn("level", F.col("most") / F.col("weight")), [F.col("level"), F.col("sid")], ["most", "weight"])
    rest = F.col("most_all") / max_repeats - (F.col("most_upto") - F.col("most"))
    common = rest / (F.col("weight_all") - (F.col("weight_upto") - F.col("weight")))
    level = levels.filter(common <= F.col("level") * (1 + 1e-12)).agg(F.min_by(common, F.struct("level", "sid"))).first()[0]
    return known.select("source", "sid", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(float(level or 0.0))).alias("target"))


def _placed(docs: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Documents with ``sid`` and ``start``, the number of their source's words before them.

    A source is put in order bucket by bucket; a bucket's share of a hot source is bounded on average.
    """
    numbered = join_on_groups(docs, sources.select("source", "sid"), ["source"])
    rows = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    keys = ["sid", "bucket"]
    order = Window.partitionBy(*keys).orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.sum("size").over(order) - F.col("size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(*keys).agg(F.sum("size").alias("total")).select(*keys, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    return within.join(shifts, keys).withColumn("start", F.col("within") + F.col("shift")).drop("within", "shift", "bucket")


def shard_counts(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, sid, blocks, first, slots``: how many slots each shard gives a source, drawn from a
    multinomial, and how many the source has in earlier shards.

    The whole part of each expected count is given outright and only the rest is drawn, which leaves
    the expectation as it is and the variance below that of a plain draw.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = stage(
        sources.filter("source_size > 0").select("sid", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("quota")),
        "mixing-quotas",
    )
    all_slots = wanted.agg(F.sum("quota")).first()[0] or 0.0
    total = round(all_slots)
    shards = max(1, -(-total // shard_slots))
    t = F.col("shard")
    # Shards times slots passes an int's range at some 190 million words; the draws hash the shard as it is.
    at = t.cast("long")
    size = F.floor((at + 1) * total / shards) - F.floor(at * total / shards)
    each = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("mean", size * F.col("quota") / F.lit(all_slots or 1.0))
    upto = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = each.withColumn("whole", F.floor("mean")).withColumn("part", F.col("mean") - F.col("whole")).withColumn("high", F.sum("part").over(upto))
    drawn = (
        shares.groupBy("shard").agg(F.round(F.sum("part")).cast("int").alias("draws")).filter("draws > 0")
        .select("shard", "draws", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("draw"))
        .withColumn("at", _uniform(F.lit(seed), F.lit("draw"), t, F.col("draw")) * F.col("draws"))
        .withColumn("cell", F.floor("at"))
    )
    # Each share is below 1, so it lies in two unit cells at most.
    low = F.col("high") - F.col("part")
    cells = shares.filter("part > 0").select("shard", "sid", low.alias("low"), "high", F.explode(F.sequence(F.floor(low), F.floor("high"))).alias("cell"))
    hits = drawn.join(cells, ["shard", "cell"]).filter("low <= at and at < high").groupBy("shard", "sid").agg(F.count("*").alias("more"))
    counts = shares.join(hits, ["shard", "sid"], "left").withColumn("slots", F.col("whole") + F.coalesce("more", F.lit(0)))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "sid", "blocks", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("first"))


def permuted(df: DataFrame, index: str, size: str, salts: Sequence[str], out: str, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Add ``out``, the place of ``index`` in a pseudorandom permutation of ``0 .. size - 1``, one for
    each combination of ``salts``. Swap-or-not: a round pairs each index with another one and a bit
    that both share decides whether they change places, so any size is permuted exactly."""
    n, salted = F.col(size), [F.col(c) for c in salts]
    # Higher-order functions: a chain of columns, each used twice by the next, is slow to plan.
    keys = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(r.alias("r"), F.pmod(F.xxhash64(F.lit(seed), r, *salted), n).alias("k")))

    def swapped(x: Column, key: Column) -> Column:
        partner = F.pmod(key["k"] - x, n)
        bit = F.xxhash64(F.lit(seed + 1), key["r"], *salted, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    return df.withColumn(out, F.aggregate(keys, F.col(index).cast("long"), swapped))


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: Sequence[str] = ()) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("tie"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )


class Mix:
    """A mixture of all documents of a table.

    ``documents`` has every document with ``sid``, its place ``start`` among its source's words,
    ``source_size`` and ``target``; ``pieces`` has one row for each part of a document in a slot:
    ``shard, slot, sid, start, copy, piece_start, words``.

    No block is taken more than ``max_repeats`` times. Null texts have size 0 and are never taken;
    a null source is a source of its own; equal rows are documents of their own; an empty table
    gives empty results; other columns are ignored. Draws depend on the seed and on the shard alone,
    so the same documents give the same mixture whatever the partitioning.
    """

    def __init__(
        self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float] = WEIGHTS,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
    ) -> None:
        self.docs, self.columns, self.block_words = docs, (id_col, text_col, source_col), block_words
        sized = stage(_prepared(docs, *self.columns), "mixing-sizes")
        self.buckets = max(1, -(-sized.count() // BUCKET_ROWS))
        self.sources = stage(source_targets(sized, weights, max_repeats), "mixing-targets")
        self.placed = stage(_placed(sized, self.sources, self.buckets).select("doc_id", "sid", "size", "start"), "mixing-placed")
        self.documents = self.placed.join(self.sources, "sid")
        self.pieces = self._joined(max_repeats, shard_slots, seed)

    def _joined(self, max_repeats: int, shard_slots: int, seed: int) -> DataFrame:
        counts = shard_counts(self.sources, self.block_words, shard_slots, seed).filter("slots > 0")
        # A fixed number of partitions: the rows are few before they are exploded.
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slots = (
            counts.repartition(parts, "shard", "sid")
            .select("shard", "sid", "blocks", "first", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
            .withColumn("index", F.col("first") + F.col("slot"))
            .filter(F.col("index") < F.col("blocks") * max_repeats)
            .withColumn("copy", F.floor(F.col("index") / F.col("blocks")))
            .withColumn("index", F.col("index") % F.col("blocks"))
        )
        slots = permuted(slots, "index", "blocks", ["sid", "copy"], "block", seed).select("shard", "slot", "sid", "copy", "block")
        length, start, end = F.lit(self.block_words), F.col("start"), F.col("start") + F.col("size")
        block = F.col("block")
        cut = (
            self.placed.filter("size > 0")
            .select("sid", "start", "size", F.explode(F.sequence(F.floor(start / length), F.floor((end - 1) / length))).alias("block"))
            .select(
                "sid", "block", "start",
                (F.greatest(start, block * length) - start).alias("piece_start"),
                (F.least(end, (block + 1) * length) - F.greatest(start, block * length)).alias("words"),
            )
        )
        # Both sides are exploded, so the sizes they are planned with are far too small for a broadcast.
        return slots.hint("merge").join(cut.hint("merge"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` for every document."""
        used = self.pieces.groupBy("sid", "start").agg(F.sum("words").alias("used"))
        # Documents without words share their start with the next one and are never taken.
        rows = self.documents.join(used, ["sid", "start"], "left")
        taken = F.when(F.col("size") > 0, F.coalesce("used", F.lit(0))).otherwise(0).cast("long")
        return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))

    def texts(self) -> DataFrame:
        """The mixture as documents: each row of the input once for each time through its source that
        takes any of it, with the parts taken in their order; all columns of the input are kept."""
        id_col, text_col, _ = self.columns
        names = self.docs.columns
        whole = _placed(_prepared(self.docs, *self.columns, keep=names), self.sources, self.buckets).filter("size > 0")
        parts = self.pieces.groupBy("sid", "start", "copy").agg(F.array_sort(F.collect_list(F.struct("piece_start", "words"))).alias("parts"))
        rows = whole.select("sid", "start", "size", *[f"kept_{c}" for c in names]).join(parts, ["sid", "start"])
        # Inside a list of one the words are split once, and not again for every part.
        joined = lambda words: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["piece_start"] + 1).cast("int"), p["words"].cast("int")))), "")
        text = F.col(f"kept_{text_col}")
        all_words = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
        taken = F.when(all_words, text).otherwise(F.get(F.transform(F.array(words_of(text)), joined), F.lit(0)))
        return rows.select(*[taken.alias(c) if c == text_col else F.col(f"kept_{c}").alias(c) for c in names])
