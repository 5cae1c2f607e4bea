"""Exact set similarity join by prefix filtering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_sets(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """(a, b, similarity) for every two rows with a Jaccard similarity of at least threshold, a < b by key.

    sets: key unique, items an array of distinct strings (null and empty match nothing). Exact: two such sets must share an item within their
    first n - ceil(threshold * n) + 1 items by global rarity, so only those are joined; hot items come last and hardly ever count.
    """
    if not 0 < threshold <= 1 or math.isnan(threshold):
        raise ValueError("threshold must be over 0 and at most 1")
    rows = sets.select(F.col(key).alias("k"), F.col(items).alias("s")).where(F.size("s") > 0)
    each = rows.select("k", F.size("s").alias("n"), F.explode("s").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df"))
    ranked = each.join(often, "item").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("r"))
    prefix = ranked.select("k", "n", F.explode(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("p")).select("k", "n", "p.item")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.k") < F.col("y.k")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9)).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    full = near.join(rows.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(rows.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
