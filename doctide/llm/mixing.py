"""Mixing sources to target weights, in DataFrame operations only.

Capped water-filling: every source's target is its weight times a common level, clamped at ``max_epochs`` times the
source's size; the level rises until the clamped excess is shared out. Documents are then taken in whole and
fractional repetitions: every document ``floor(target / size)`` times, and documents first by a seeded hash of their
id once more until the source's words come nearest to its target. The place where a source's extra repetition ends
is found from sums over ``BUCKETS`` hash ranges, so no source's documents meet in one task; only those of one range
are put in order. ``fill`` runs a job a round, of which there are at most as many as sources, and ``ranked_weights``
brings one row a source into one task; both are meant for up to some ten thousand sources, while documents may be any
number.

Null text counts 0 words, null source is a source of its own, repeated rows are mixed like any, each on its own. Ties of
the hash go to the smaller id, then to the smaller document; a target halfway between two documents takes one more. Very
long documents are taken whole or not at all. If all sources are clamped, each is taken ``max_epochs`` times. An empty
table gives no rows. Only doc_id, source and size (or text) are read; other columns are free to have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def ranked_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``source`` and ``weight``: the cycle's weights dealt to the sources by code point, null last. One row a source meets in one task."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    return sources.select("source", weight.cast("double").alias("weight"))


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``target`` for rows of (source, source_size, weight): clamp, share the excess by weight, until none is above."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, seen = 0.0, -1.0
    while level != seen:  # two sums a round come to the driver; each round clamps at least one more source
        clamped = (F.col("weight") * F.lit(level) >= cap) if seen >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)).alias("full"), F.sum(F.when(~clamped, F.col("weight")).otherwise(0.0)).alias("free")).first()
        if not row["free"]:
            break
        seen, level = level, max(level, (budget - row["full"]) / row["free"])
    return sources.withColumn("target", F.round(F.least(cap, F.col("weight") * F.lit(level)), 6))


def mix(sized: DataFrame, weights: DataFrame, share: float, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken, for rows of (doc_id, source, size)."""
    position = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    docs = materialize(sized.select("doc_id", "source", F.col("size").cast("long").alias("size"), position.alias("position")), "sized")
    docs = docs.withColumn("bucket", F.shiftright("position", 48 - (BUCKETS - 1).bit_length()))
    ranges = materialize(docs.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "ranges")
    totals = ranges.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    known = totals.join(weights.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    known = materialize(known, "sources")
    budget = (known.agg(F.sum("source_size")).first()[0] or 0) * share
    targets = fill(known, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    # The hash range in which a source's extra repetition ends, and the words taken before it.
    before = F.sum("bucket_size").over(Window.partitionBy("of").orderBy("last")) - F.col("bucket_size")
    ends = (
        ranges.select(F.col("source").alias("of"), F.col("bucket").alias("last"), "bucket_size").withColumn("before", before)
        .join(targets.select(F.col("source").alias("s"), "extra"), F.col("of").eqNullSafe(F.col("s")))
        .filter((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("bucket_size")))
        .select("of", "last", (F.col("extra") - F.col("before")).alias("rest"))
    )
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("planned"), "source_size", "target", "whole", "extra", "last", "rest")
    plan = materialize(plan, "plan")
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("planned")), "left").drop("planned")
    edge = joined.filter(F.col("bucket") == F.col("last"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("position", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # A document at the edge is taken if that brings the sum nearer to the target.
    edge = edge.withColumn("once_more", (running + F.col("size") / 2 <= F.col("rest")).cast("int"))
    clear = joined.filter(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("once_more", F.coalesce((F.col("bucket") < F.col("last")).cast("int"), F.lit(0)))
    repeats = (F.col("whole") + F.col("once_more")).cast("long")
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))
