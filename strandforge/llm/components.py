"""Connected components by alternating large and small stars.

Each round is two aggregates and two joins on slim edges, written to the shared
folder; rounds grow with the logarithm of a component's size. A node's degree
bounds nothing here: minima are pre-aggregated and joins on a hub are split by
Spark at run time. No links or labels reach the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (a, b), any order, repeats and loops allowed. Returns (node, root) for every node but the roots themselves; root is the least node of a component. No edges: empty."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    mark = _mark(e)
    while mark[0]:
        e = materialize(_small(_large(e)), name)
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
