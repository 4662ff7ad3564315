"""Alias tables: every draw's row counted out against the weights, in one bucket and in many."""

import random

import pytest
from pyspark.sql import functions as F

from doctide.operators import alias


def cases():
    rng = random.Random(3)
    yield [5]
    yield [3, 3, 3]
    yield [97, 1, 1, 1]
    for k in range(3):
        yield [rng.choice([1, 1, 2, 3, rng.randint(1, 60)]) for _ in range(rng.randint(2, 40))]


@pytest.mark.parametrize("width", [3, 1000])
def test_every_draw_counted_out(spark, width):
    for weights in cases():
        table = spark.createDataFrame([(i, w + 0.9) for i, w in enumerate(weights)] + [(1000, 0.5), (1001, None)], "id long, w double")
        made = alias.alias_table(table, "w", ["id"], F.floor(F.col("id") / width))
        assert (made.n, made.total) == (len(weights), sum(weights))
        draws = spark.range(made.n * made.total).withColumnRenamed("id", "r")
        picked = made.pick(draws, F.floor(F.col("r") / made.total), F.col("r") % made.total)
        got = {r["id"]: r["count"] for r in picked.groupBy("picked.id").count().collect()}
        assert got == {i: w * len(weights) for i, w in enumerate(weights)}, weights


def test_nothing_to_pick_from(spark):
    made = alias.alias_table(spark.createDataFrame([(1, 0.2)], "id long, w double"), "w", ["id"], F.lit(0))
    assert (made.n, made.total, made.cells.count()) == (0, 0, 0)


def test_a_few_rows_with_most_of_the_weight_over_many_buckets(spark):
    weights = [10**12, 7 * 10**11] + [1 + i % 5 for i in range(3000)]
    table = spark.createDataFrame(list(enumerate(weights)), "id long, w long")
    made = alias.alias_table(table, "w", ["id"], F.floor(F.col("id") / 100))
    total, n = made.total, made.n
    parts = made.cells.select(F.col("own.id").alias("id"), F.col("cut").alias("part")).unionByName(made.cells.select(F.col("other.id").alias("id"), (F.lit(total) - F.col("cut")).cast("decimal(38,0)").alias("part")))
    got = {r["id"]: int(r["part"]) for r in parts.groupBy("id").agg(F.sum("part").alias("part")).collect()}
    assert got == {i: w * n for i, w in enumerate(weights)} and made.cells.select("cell").distinct().count() == n
