"""Mixing sources to target weights with hash thresholds.

Every source gets a target, in words, by its weight. A source takes each of its texts as often as
its target holds its size, and for what is left those texts whose hash lies below a threshold.
The threshold comes from nested histograms: words are summed by source and hash bucket, the bucket
in which the budget runs out is cut into finer buckets, and only its rows are read again, until
single hash values are left. Nothing is sorted, and the choice is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.hashing import HEX_DIGITS, draw_bits
from gleanspark.llm.common import WORD, shelters
from gleanspark.storage import materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 42
TAG = "mix"
HASH_BITS = 4 * HEX_DIGITS
BUCKET_BITS = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def weighted(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add ``weight``: the weights in turn along the sources by code point, NULL last.

    Sources are numbered inside ranges; only the number of sources per range is summed up.
    """
    order = F.col("source").isNull(), F.col("source")
    ranged = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-sources")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("in_part") - 1
    turn = F.array(*[F.lit(w) for w in weights])
    return (
        ranged.withColumn("in_part", inside).join(starts, "part")
        .withColumn("weight", F.get(turn, F.pmod(place, F.lit(len(weights))).cast("int")))
        .select("source", "source_size", "weight")
    )


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target``: the share of all words by weight, at most ``most`` times the source's size.

    What a limit cuts off is shared again by weight among the others, until none is above. Two
    sums a round come to the driver.
    """
    limit = F.col("source_size") * most
    sources = materialize(sources.withColumn("full", F.lit(False)), "mix-weights")
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        used, left, full = sources.agg(
            F.coalesce(F.sum(F.when(F.col("full"), limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)),
            F.count_if(F.col("full")),
        ).first()
        share = F.lit(everything - used).cast("bigint") * F.col("weight") / F.lit(max(left, 1))
        above = F.col("full") | (share > limit)
        grown = materialize(sources.withColumn("full", above), "mix-weights")
        if grown.agg(F.count_if("full")).first()[0] == full:
            target = F.when(F.col("full"), limit.cast("double")).otherwise(share)
            return sources.select("source", "source_size", target.alias("target"))
        sources = grown


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below) for ``rows(source, size, bits)`` and ``budgets(source, budget)``.

    The texts with ``bits < below`` hold at most the budget; with those of the next hash value
    they would hold more. NULL: the budget is never used up.
    """
    state = budgets.withColumn("low", F.lit(0).cast("bigint")).withColumn("open", F.lit(True))
    shift = HASH_BITS
    while shift:
        wide, shift = shift, max(0, shift - BUCKET_BITS)
        state = materialize(state, "mix-state")
        if wide < HASH_BITS:
            bounds = state.filter("open").select("source", "low")
            inside = F.shiftright(rows["bits"], wide) == F.shiftright(bounds["low"], wide)
            rows = rows.join(bounds, same_source(rows, bounds) & inside, "left_semi")
            rows = materialize(rows, "mix-boundary")
        sums = (
            rows.groupBy("source", F.shiftright("bits", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        along = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(along))
        over = sums.join(state, same_source(sums, state)).filter("open AND upto > budget")
        first = over.groupBy(sums["source"]).agg(
            F.min_by(F.struct("bucket", F.col("upto") - F.col("words")), "bucket").alias("cut")
        )
        state = state.join(first, same_source(state, first), "left").select(
            state["source"],
            F.when(F.col("cut").isNull(), F.col("budget"))
            .otherwise(F.col("budget") - F.col("cut.col2")).alias("budget"),
            F.when(F.col("cut").isNull(), F.col("low"))
            .otherwise(F.shiftleft("cut.bucket", shift)).alias("low"),
            F.col("cut").isNotNull().alias("open"),
        )
    return state.select("source", F.when(F.col("open"), F.col("low")).alias("below"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), draw_bits(seed, TAG, F.col(id_col)).alias("bits"),
    )


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, repeats, below) of ``rows(doc, source, size, bits)``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(weighted(sources, weights), most)
    repeats = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    goals = goals.withColumn("repeats", F.least(repeats, F.lit(most)))
    goals = materialize(goals, "mix-targets")
    left = F.col("target") - F.col("repeats") * F.col("source_size")
    cut = thresholds(rows, goals.select("source", left.alias("budget")))
    found = goals.join(cut, same_source(goals, cut), "left")
    return materialize(found.select(*[goals[c] for c in goals.columns], "below"), "mix-plan")


def times(goals: DataFrame, bits: Column) -> Column:
    """How often a text is taken."""
    extra = goals["below"].isNull() | (bits < goals["below"])
    return (goals["repeats"] + extra.cast("int")).cast("bigint")


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of ``docs``.

    A NULL text has size 0; NULL is a source of its own, the last. The hash depends on the id
    alone, so rows that share an id (or have none) are taken or left together; a source of one
    such row may miss its target by that row. Other columns are not read.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    goals = plan(rows, weights, most)
    joined = rows.join(goals, same_source(rows, goals))
    return joined.select(
        rows["doc"].alias(id_col), "size", "source_size", "target",
        (rows["size"] * times(goals, rows["bits"])).alias("taken"),
    )


@shelters
def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` the mix takes, with ``mix_times``; only source, size and hash are kept
    for planning, and the texts are read again through a filter."""
    rows = materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    goals = plan(rows, weights, most).select(
        F.col("source").alias("__source"), "repeats", "below"
    )
    goals = goals.select("__source", F.struct("repeats", "below").alias("__goal"))
    same = docs[source_col].eqNullSafe(goals["__source"])
    bits = draw_bits(seed, TAG, docs[id_col])
    extra = F.col("__goal.below").isNull() | (bits < F.col("__goal.below"))
    taken = (F.col("__goal.repeats") + extra.cast("int")).cast("bigint")
    own = [docs[c] for c in docs.columns if c != "mix_times"]
    return docs.join(goals, same).select(*own, taken.alias("mix_times")).filter("mix_times > 0")
