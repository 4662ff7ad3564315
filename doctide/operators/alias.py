"""Picks by weight at a cost that doesn't depend on how many there are to pick from: alias tables, made by bucket.

Every row of the table has a cell of the mean weight. A row below the mean leaves room in its cell, which one row above
the mean takes; a row above the mean keeps what then is left of its weight in its own cell, whose rest the next such row
takes. With the lacks of the light rows and the excesses of the heavy ones laid out along one line, in order, a light
row's partner is the first heavy row whose end lies beyond the light row's start; and the heavy row keeps the mean less
the stretch from its end to the next end of a light row.

Rows come in buckets; running sums are made inside each, over one row a bucket. Stretches of light and of heavy buckets
that overlap are paired, and partners are looked for inside each pair, which holds the rows of two buckets at most; all
pairs together hold each row about once. Weights are whole numbers, and all arithmetic on them is exact, in 38 digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks

_WIDE = "decimal(38,0)"


@dataclass
class AliasTable:
    """``cells`` (cell from 0, cut, own, other) of ``n`` rows of the ``total`` weight: a cell's first ``cut`` of ``total`` parts are its own row's."""

    cells: DataFrame
    n: int
    total: int

    def pick(self, draws: DataFrame, cell: Column, rest: Column, name: str = "picked") -> DataFrame:
        """``draws`` with the row that each picks: a cell below n, and a part below the total. One join by cell."""
        told = draws.withColumn("__cell", cell.cast("long")).withColumn("__rest", rest.cast("decimal(38,0)"))
        sides = self.cells.select(F.col("cell").alias("__at"), "cut", "own", "other")
        out = told.join(sides, F.col("__cell") == F.col("__at"))
        return out.withColumn(name, F.when(F.col("__rest") < F.col("cut"), F.col("own")).otherwise(F.col("other"))).drop("__cell", "__rest", "__at", "cut", "own", "other")


def _laid_out(rows: DataFrame, length: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``lo`` and ``hi`` on the line, in order of (bucket, place); and each bucket's stretch and first row."""
    rows = rows.withColumn("__len", length)
    by = rows.groupBy("bucket").agg(F.sum("__len").alias("len"), F.min("place").alias("first"))
    line = Window.orderBy("bucket")  # one row a bucket
    stretches = by.select("bucket", (F.sum("len").over(line) - F.col("len")).cast(_WIDE).alias("start"), F.sum("len").over(line).cast(_WIDE).alias("end"), F.lead(F.struct("bucket", F.col("first").alias("place"))).over(line).alias("next"))
    inside = F.sum("__len").over(Window.partitionBy("bucket").orderBy("place")).cast(_WIDE)
    placed = rows.withColumn("__in", inside).join(stretches.select("bucket", "start"), "bucket")
    return placed.withColumn("hi", (F.col("start") + F.col("__in")).cast(_WIDE)).withColumn("lo", (F.col("hi") - F.col("__len")).cast(_WIDE)).drop("__in", "__len", "start"), stretches


def alias_table(table: DataFrame, weight: str, order: Sequence[str], bucket: Column) -> AliasTable:
    """The alias table of rows of truncated ``weight``; those below one go. ``bucket`` deals the rows out, ``order`` tells those of a bucket apart."""
    whole = table.withColumn("__w", F.col(weight).cast("double").cast("long")).filter("__w >= 1").withColumn("bucket", bucket.cast("long"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*[F.col(f"`{c}`") for c in order]))
    rows = sinks.written(whole.select("bucket", place.cast("long").alias("place"), F.col("__w").cast(_WIDE).alias("w"), F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row")), "weights")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    total = int(total)
    before = rows.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))  # one row a bucket
    scaled = (F.col("w") * F.lit(n).cast("decimal(18,0)")).cast(_WIDE)
    mean = F.lit(str(total)).cast(_WIDE)
    rows = rows.join(before, "bucket").select("bucket", "place", "row", (F.col("before") + F.col("place") - 1).alias("cell"), scaled.alias("s"))
    lights, light_buckets = _laid_out(rows.filter(F.col("s") < mean), (mean - F.col("s")).cast(_WIDE))
    heavies, heavy_buckets = _laid_out(rows.filter(F.col("s") > mean), (F.col("s") - mean).cast(_WIDE))
    lights, heavies = sinks.written(lights, "lights"), sinks.written(heavies, "heavies")
    # The row that takes the rest of a heavy row's cell: the next one, if need be of the next bucket.
    inside = F.lead(F.struct("bucket", "place")).over(Window.partitionBy("bucket").orderBy("place"))
    heavies = heavies.withColumn("after", inside).join(heavy_buckets.select("bucket", "next"), "bucket").withColumn("after", F.coalesce("after", "next")).drop("next")
    # Overlapping stretches, in order on the line: a sweep over one row a bucket.
    ends = light_buckets.select("start", "end", F.col("bucket").alias("b"), F.lit(None).cast("long").alias("c")).unionByName(heavy_buckets.select("start", "end", F.lit(None).cast("long").alias("b"), F.col("bucket").alias("c")))
    sides = lambda df, own: df.select(F.col("bucket").alias(own), F.col("start").alias(f"{own}_start"), F.col("end").alias(f"{own}_end"))
    back = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    open_ = ends.select("start", F.last("b", True).over(back).alias("b"), F.last("c", True).over(back).alias("c")).filter("b IS NOT NULL AND c IS NOT NULL").select("b", "c").distinct()
    pairs = sinks.written(open_.join(sides(light_buckets, "b"), "b").join(sides(heavy_buckets, "c"), "c").filter("b_start < c_end AND c_start < b_end"), "pairs")
    group = Window.partitionBy("b", "c").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    none = F.lit(None).cast("struct<bucket:bigint,place:bigint>")
    me = F.struct("bucket", "place")
    # A light row's partner: the first heavy row whose end lies beyond its start.
    asked = lights.join(pairs, F.col("bucket") == F.col("b")).filter("lo >= c_start AND lo < c_end").select("b", "c", F.col("lo").alias("at"), F.lit(1).alias("kind"), me.alias("who"), none.alias("partner"))
    given = heavies.join(pairs, F.col("bucket") == F.col("c")).select("b", "c", F.col("hi").alias("at"), F.lit(0).alias("kind"), none.alias("who"), me.alias("partner"))
    partner = asked.unionByName(given).withColumn("partner", F.first("partner", True).over(group)).filter("who IS NOT NULL").select("who.*", "partner")
    # A heavy row keeps the mean less what lies between its end and the next end of a light row.
    asked = heavies.join(pairs, F.col("bucket") == F.col("c")).filter("hi > b_start AND hi <= b_end").select("b", "c", F.col("hi").alias("at"), F.lit(0).alias("kind"), me.alias("who"), F.lit(None).cast(_WIDE).alias("end"))
    given = lights.join(pairs, F.col("bucket") == F.col("b")).select("b", "c", F.col("hi").alias("at"), F.lit(1).alias("kind"), none.alias("who"), F.col("hi").alias("end"))
    until = asked.unionByName(given).withColumn("end", F.first("end", True).over(group)).filter("who IS NOT NULL").select("who.*", "end")
    light_cells = lights.join(partner, ["bucket", "place"]).select("cell", F.col("s").alias("cut"), "row", "partner")
    heavy_cells = heavies.join(until, ["bucket", "place"]).select("cell", (mean - (F.col("end") - F.col("hi"))).cast(_WIDE).alias("cut"), "row", F.col("after").alias("partner"))
    even = rows.filter(F.col("s") == mean).select("cell", F.col("s").alias("cut"), "row", none.alias("partner"))
    cells = light_cells.unionByName(heavy_cells).unionByName(even)
    others = heavies.select(me.alias("partner"), F.col("row").alias("other"))
    # A partner that many cells name is split by the join's skew handling; it is one row on the other side.
    cells = cells.join(others, "partner", "left").select("cell", "cut", F.col("row").alias("own"), F.coalesce("other", "row").alias("other"))
    return AliasTable(sinks.written(cells, "cells"), n, total)
