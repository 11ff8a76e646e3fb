"""An ordered cascade of exclusions on calls, every dropped row with its reason.

Steps run in order. A row leaves at the first thing that speaks against it: its contig region is
blacklisted, it is shorter or longer than its step allows, a kept call of an earlier blocking
step overlaps it, or (greedy steps) a call of its own step that was taken before does.
What a blocking step keeps blocks all later steps, so the order of steps matters and that of
rows does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import greedy_disjoint, touching


@dataclass(frozen=True)
class Step:
    """Calls of one kind: a size window, whether its own calls rule out each other (shortest first, then leftmost), and whether what it keeps blocks later steps."""

    name: str
    least: int | None = None
    most: int | None = None
    greedy: bool = False
    blocks: bool = False
    blocked: bool = True


#: Inversions, then large deletions and insertions, then small calls.
STEPS = (Step("inversion", 300, 2000, greedy=True, blocks=True), Step("large deletion", blocks=True), Step("large insertion"), Step("small"))


def _meets(rows: DataFrame, others: DataFrame, on: list[str], row_range: tuple[str, str], other_range: tuple[str, str], same: bool = False) -> DataFrame:
    if same:
        return touching(rows, others.withColumnRenamed("b_contig", "contig"), [*on, "contig"], row_range, other_range).select("call_id").distinct()
    return touching(rows, others, on, row_range, other_range).select("call_id").distinct()


def cascade(calls: DataFrame, steps: tuple[Step, ...] = STEPS, blacklist: DataFrame | None = None, same_contig: bool = False) -> DataFrame:
    """call_id (unique), step, reason (null if the call is kept).

    calls: call_id, step (the name of one), chrom, first, last, len, contig, c_first, c_last (its place on
    the contig); blacklist: b_chrom, b_first, b_last on contigs. ``same_contig``: a call blocks
    only calls of its own contig. Calls of an unknown step are an error when they are read.
    """
    known = F.col("step").isin(*[s.name for s in steps])
    bad = F.raise_error(F.concat(F.lit("no step "), F.coalesce("step", F.lit("null")))).cast("string")
    calls = calls.withColumn("step", F.when(F.coalesce(known, F.lit(False)), F.col("step")).otherwise(bad))
    calls = materialize(calls.select("call_id", "step", "chrom", "first", "last", "len", "contig", "c_first", "c_last"), "calls")
    black = None
    if blacklist is not None:
        listed = blacklist.select(F.col("b_chrom").alias("contig"), "b_first", "b_last")
        black = materialize(_meets(calls.select("call_id", "contig", "c_first", "c_last"), listed, ["contig"], ("c_first", "c_last"), ("b_first", "b_last")), "blacklisted")

    def marked(rows: DataFrame, found: DataFrame, reason: str) -> DataFrame:
        got = rows.join(found.withColumn("_hit", F.lit(True)), "call_id", "left")
        return got.withColumn("reason", F.coalesce("reason", F.when(F.col("_hit"), F.lit(reason)))).drop("_hit")

    out: list[DataFrame] = []
    walls: list[DataFrame] = []
    for s in steps:
        d = calls.where(F.col("step") == s.name).withColumn("reason", F.lit(None).cast("string"))
        if black is not None:
            d = marked(d, black, "contig region")
        size: Column = F.lit(None).cast("string")
        if s.most is not None:
            size = F.when(F.col("len") > s.most, F.lit(f"longer than {s.most}"))
        if s.least is not None:
            size = F.when(F.col("len") < s.least, F.lit(f"shorter than {s.least}")).otherwise(size)
        d = d.withColumn("reason", F.coalesce("reason", size))
        if s.blocked and walls:
            wall = reduce(DataFrame.unionByName, walls)
            d = marked(d, _meets(d.where("reason is null").select("call_id", "chrom", "contig", "first", "last"), wall, ["chrom"], ("first", "last"), ("b_first", "b_last"), same_contig), "inside a larger call")
        if s.greedy:
            d = materialize(d, "cascade")
            left = d.where("reason is null")
            kept = greedy_disjoint(left.select("chrom", "call_id", "first", "last", "len"), "call_id", ["len", "first"])
            d = marked(d, left.select("call_id").join(kept.select("call_id"), "call_id", "left_anti"), "overlaps a shorter call")
        d = materialize(d, "cascade")
        out.append(d.select("call_id", "step", "reason"))
        if s.blocks:
            walls.append(d.where("reason is null").select("chrom", F.col("contig").alias("b_contig"), F.col("first").alias("b_first"), F.col("last").alias("b_last")))
    return reduce(DataFrame.unionByName, out)
