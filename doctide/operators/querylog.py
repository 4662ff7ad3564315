"""Analytics over a log of executed queries: shape hashes and cost scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape_hash(filter_keys: Column, projection_keys: Column, sort_keys: Column) -> Column:
    """Equal for queries of the same fields: filter and projection keys sorted together, then sort keys in order; values don't count."""
    marked = lambda c, prefix: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    first = F.array_sort(F.concat(marked(filter_keys, ""), marked(projection_keys, "projection.")))
    return F.sha2(F.concat_ws("", F.concat(first, marked(sort_keys, "sort."))), 256)


def cost_score(full_scan: Column, has_sort: Column, returned: Column, keys: Column, docs: Column) -> Column:
    """Fixed scores of how a query was answered, and of its sort by the number of rows returned."""
    how = (
        F.when(full_scan, 500).when((returned == keys) & (docs == 0), 1).when((returned == keys) & (keys == docs), 3)
        .when((returned == docs) & (docs < keys), 5).when((keys == docs) & (docs > returned), 10).otherwise(0)
    )
    return how + F.when(has_sort, F.when(returned < 100, 10).when(returned < 1000, 25).otherwise(100)).otherwise(0)
