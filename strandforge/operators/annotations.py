"""Order-dependent folds of repeat annotations.

The merged consensus decides whether the next annotation joins, so these are folds, not
windows. Where a fold is certain to break is known from neighbouring rows alone (found by
tiles). What lies between two breaks is folded in the tile where it begins, so a group is a
tile and what hangs over its edge, not a chromosome.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import TILE, neighbour, running

_COLUMNS = {"chrom": "string", "start": "long", "end": "long", "rep_start": "long", "rep_end": "long", "fwd": "boolean", "is_sat": "boolean", "repeat": "string", "family": "string"}
_OUT = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())
_ORDER = ["start", "end", "repeat", "family", "fwd", "rep_start", "rep_end", "is_sat"]


def compact(repeats: DataFrame, reach: int = 25) -> DataFrame:
    """Neighbours of one repeat, family and strand become one if the next starts within ``reach`` of where the last one ended, and (satellites apart) the consensus goes on within ``reach``.

    The result ends where its last member ends and keeps the satellite flag of its first;
    its consensus range is the hull of its members'.
    """
    d = repeats.groupBy(*_COLUMNS).agg(F.count(F.lit(1)).alias("_n")).withColumn("_tile", F.floor(F.col("start") / TILE)).withColumn("_row", F.struct(*_ORDER))
    d = neighbour(d, ["chrom"], "_tile", _ORDER, "_row", "_was")
    same = [F.col(f"_was.{c}") == F.col(c) for c in ("repeat", "family", "fwd")]
    joined = same[0] & same[1] & same[2] & (F.abs(F.col("start") - F.col("_was.end")) <= reach)
    d = materialize(d.withColumn("_new", F.when(joined, 0).otherwise(1)).drop("_row", "_was"), "annotations")
    d = materialize(running(d, ["chrom"], "_tile", _ORDER, {"_g": (F.col("_new"), "sum")}), "annotations")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in (r for r in g.sort_values(_ORDER).itertuples(index=False) for _ in range(r.copies)):
            last = out[-1] if out else None
            gap = (r.rep_start - last[4] if r.fwd else r.rep_end - last[3]) if last else 0
            if last and (r.fwd, r.repeat, r.family) == (last[5], last[7], last[8]) and abs(r.start - last[2]) <= reach and (r.is_sat or abs(gap) <= reach):
                last[2], last[3], last[4] = r.end, min(last[3], r.rep_start), max(last[4], r.rep_end)
            else:
                out.append([r.chrom, r.start, r.end, r.rep_start, r.rep_end, r.fwd, r.is_sat, r.repeat, r.family])
        return pd.DataFrame(out, columns=list(_COLUMNS))

    d = d.join(d.groupBy("chrom", "_g").agg(F.floor(F.min("start") / TILE).alias("_home")), ["chrom", "_g"])
    return d.select("_home", F.col("_n").alias("copies"), *_COLUMNS).groupBy("chrom", "_home").applyInPandas(run, _OUT)


def with_tandem(repeats: DataFrame, tandem: DataFrame, overlap: int = 10, name: str = "artificial") -> DataFrame:
    """Repeats and tandem repeats (chrom, start, end) in one list.

    Tandem repeats that overlap by more than ``overlap`` bases are merged first. Then, in
    order of start, an annotation folds into the last one if either is a tandem repeat and
    it starts ``overlap`` bases or more before the last one's end. The result is a
    satellite if either is. One that ends later gives it its end, no consensus (-1), and, if
    only that one is a tandem repeat, its label: forward, no family.
    """
    from .intervals import merge

    t = merge(tandem.select("chrom", "start", "end"), ["chrom"], "start", "end", -overlap)
    minus = F.lit(-1).cast("long")
    t = t.select("chrom", "start", "end", minus.alias("rep_start"), minus.alias("rep_end"), F.lit(True).alias("fwd"), F.lit(True).alias("is_sat"), F.lit(name).alias("repeat"), F.lit("").alias("family"))
    d = repeats.select(*_COLUMNS).unionByName(t).withColumn("_tile", F.floor(F.col("start") / TILE))
    # No fold reaches beyond the largest end of all rows before.
    d = running(d, ["chrom"], "_tile", _ORDER, {"_e": (F.col("end"), "max")}, inclusive=False)
    d = materialize(d.withColumn("_new", F.when(F.col("start") <= F.col("_e") - overlap, 0).otherwise(1)), "annotations")
    d = materialize(running(d, ["chrom"], "_tile", [*_ORDER, F.desc("_new")], {"_g": (F.col("_new"), "sum")}), "annotations")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in g.sort_values(_ORDER).itertuples(index=False):
            last = out[-1] if out else None
            if last and name in (last[7], r.repeat) and r.start <= last[2] - overlap:
                last[6] = last[6] or r.is_sat
                if r.end > last[2]:
                    last[2:5] = r.end, -1, -1
                    if last[7] != name and r.repeat == name:
                        last[5], last[7], last[8] = True, name, ""
            else:
                out.append([r.chrom, r.start, r.end, r.rep_start, r.rep_end, r.fwd, r.is_sat, r.repeat, r.family])
        return pd.DataFrame(out, columns=list(_COLUMNS))

    d = d.join(d.groupBy("chrom", "_g").agg(F.floor(F.min("start") / TILE).alias("_home")), ["chrom", "_g"])
    return d.select("_home", *_COLUMNS).groupBy("chrom", "_home").applyInPandas(run, _OUT)
