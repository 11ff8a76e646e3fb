"""Greedy choices as rounds: one-to-one matchings and independent sets.

A sequential greedy method takes the first of all candidates, drops what that rules out,
and goes on. What is first among its own neighbours can be taken at once, for nothing that
comes earlier touches it, and so all of them are taken in one round. That gives the
sequential result, in rounds that are few in practice, by windows over the two ends
of the pairs alone: no group is larger than the neighbours of one row. Each round is
written to the shared folder, so lineage does not grow and a lost executor costs one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def match(pairs: DataFrame, group: list[str], left: str, right: str, weight: str) -> DataFrame:
    """The pairs that greedy matching takes in the order of (``weight``, ``left``, ``right``), each side once a group.

    A round takes the pairs that are first on both sides. Rows of the same pair count once.
    """
    by_left, by_right = Window.partitionBy(*group, left), Window.partitionBy(*group, right)
    live, out = pairs.withColumn("_m", F.lit(False)), []
    while True:
        # Pairs matched in the round before are still there, so that this side drops what they rule out.
        d = live.withColumn("_t", F.max("_m").over(by_left)).where("not _t")
        d = d.withColumn("_a", F.row_number().over(by_left.orderBy(weight, right)) == 1)
        d = d.withColumn("_b", F.row_number().over(by_right.orderBy(weight, left, F.desc("_a"))) == 1)
        d = d.withColumn("_m", F.col("_a") & F.col("_b"))
        live = materialize(d.withColumn("_t", F.max("_m").over(by_right)).where("_m or not _t").drop("_t", "_a", "_b"), "match")
        out.append(live.where("_m").drop("_m"))
        if live.where("not _m").isEmpty():
            return _together(out)


def dropped(pairs: DataFrame, keys: list[str], first: list[str] | None = None) -> DataFrame:
    """(keys, id) of the rows that greedy choice leaves out: the first row stays, its neighbours go, and so on with the rest.

    pairs: keys, a, b: neighbours, each pair both ways, no row with itself; ``first`` names
    columns of a row's rank, as ``a_<name>`` and ``b_<name>``, least first, then the id.
    Without ``first`` the row with the fewest neighbours left stays, counted anew in every
    round, a pair that is there twice as two. Rows without neighbours are in no pair and stay.
    """
    by_a, by_b = Window.partitionBy(*keys, "a"), Window.partitionBy(*keys, "b")
    live = pairs.select(*keys, "a", "b", *[f"{x}_{c}" for x in "ab" for c in first or []])
    if first is not None:
        live = live.distinct()
    out = []
    while True:
        if first is None:
            live = live.withColumn("a_n", F.count(F.lit(1)).over(by_a)).withColumn("b_n", F.count(F.lit(1)).over(by_b))
        a, b = (F.struct(*[F.col(f"{x}_{c}").alias(c) for c in (first or ["n"])], F.col(x).alias("id")) for x in "ab")
        d = live.withColumn("_b", b < F.min(a).over(by_b))
        d = d.withColumn("_a", a < F.min(b).over(by_a)).withColumn("_gone", F.max("_b").over(by_a))
        d = d.withColumn("_off", F.max("_a").over(by_b))
        done = materialize(d, "independent")
        out.append(done.where("_gone").select(*keys, F.col("a").alias("id")).distinct())
        live = done.where("not (_a or _b or _gone or _off)").drop("_a", "_b", "_gone", "_off")
        if live.isEmpty():
            return _together(out)


#: Rows that a greedy choice looks at first; each batch after that ends at four times the place.
BATCH = 20_000


def prefixes(rows: DataFrame, order: list[str], batch: int | None = None) -> list[Column]:
    """Conditions that the first rows in ``order`` meet, each four times as many as the one before, about; none if one batch holds all.

    A greedy choice by that order may end one batch, drop what its choice rules out, and go on
    with the rest: few of a later batch are left by then, so what is compared grows with the rows, however
    many lie together. Where a batch ends changes nothing in the result; a sample by hash tells it.
    """
    batch = batch or BATCH
    n = rows.count()
    if n <= batch:
        return []
    every = -(-n // 20_000)
    some = [tuple(r) for r in rows.select(*order).dropna().where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).sort(*order).collect()]  # 20,000 rows, about
    out, share = [], batch / n
    while share < 1 and some:
        last = some[min(int(share * len(some)), len(some) - 1)]
        out.append(F.struct(*order) <= F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last)]))
        share *= 4
    return out


def both_ways(pairs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairs (keys, a, b, a_<column>, b_<column>) and the same turned round."""
    swap: list[Column] = [F.col("b").alias("a"), F.col("a").alias("b")]
    for c in columns:
        swap += [F.col(f"b_{c}").alias(f"a_{c}"), F.col(f"a_{c}").alias(f"b_{c}")]
    return pairs.select(*keys, "a", "b", *[f"{x}_{c}" for c in columns for x in "ab"]).unionByName(pairs.select(*keys, *swap))
