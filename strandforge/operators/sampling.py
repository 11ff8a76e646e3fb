"""Sampling and simulation with hashed uniforms: a draw depends on (seed, key, slot) alone, so reruns and retries agree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize, ship
from .intervals import running


def uniform(seed: int, slot: int, *keys: Column | str) -> Column:
    """In [0, 1)."""
    h = F.xxhash64(F.lit(seed), F.lit(slot), *keys)
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """0-based position in key order: a range sort whose bounds come from the rows, counts of its partitions, their prefix, and places in a partition. No task sorts the whole, whatever the keys; of equal keys the order is any. One row a partition is broadcast."""
    d = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    d = materialize(d.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)), "ordinals")
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(counts.select("_p", before.alias("_before"))), "_p").withColumn("ordinal", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def ranks(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """1-based position within ``keys`` by (bucket, order); neither keys nor bucket is null. Counts of buckets, their prefix, then order inside a bucket: a key with most rows is many tasks' work."""
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return d.withColumn("_i", inside).join(counts, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def shuffled(df: DataFrame, keys: list[str], by: str, seed: int) -> DataFrame:
    """Rank of each row in a hashed order within its key (a Fisher-Yates shuffle's counterpart), by ranges of the hash: as many as the rows need for some 65536 each if one key has them all, 1024 at least."""
    bits = max(10, (df.count() >> 16).bit_length())
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), by))
    return ranks(d, keys, F.shiftright("_h", 64 - bits), ["_h", by]).drop("_h")


def take_until(df: DataFrame, order: list[Column], amount: str, target: int, keys: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Rows while the amount before them is below the target; the one that crosses is taken. ``bucket`` does not fall along the order (the first of it, if not given); sums go by bucket."""
    d = df.withColumn("_b", order[0] if bucket is None else bucket)
    d = running(d, keys or [], "_b", order, {"cum": (F.col(amount), "sum")})
    return d.where(F.col("cum") - F.col(amount) < target).drop("_b")


def cap_bins(df: DataFrame, by: str, caps: DataFrame) -> DataFrame:
    """The first ``cap`` rows of each bin in hashed order; bins without a cap give none."""
    return shuffled(df, ["bin"], by, 0).join(caps, "bin").where("rank <= cap").drop("rank", "cap")


def normal_mass(bins: DataFrame, mean_col: str, sd_col: str, width: int) -> DataFrame:
    """P(bin * width <= X < (bin + 1) * width) of a normal X; few rows, erf by pandas."""
    import math

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = lambda x: np.array([math.erf(v) for v in (x - b[mean_col]) / (b[sd_col] * math.sqrt(2))])
            yield b.assign(p=0.5 * (z((b["bin"] + 1) * width) - z(b["bin"] * width)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bins.schema.fields)
    return bins.mapInPandas(run, schema + ", p double")


def prefix_levels(reads: DataFrame, order: list[Column], amount: str, quantum: float, levels: int, bucket: Column | None = None) -> DataFrame:
    """level, n, bp: rows until ``level * quantum`` of the amount, in an order, for levels from 1 on. A row belongs to the first level that is not reached before it."""
    d = reads.withColumn("_b", order[0] if bucket is None else bucket)
    d = running(d, [], "_b", order, {"_cum": (F.col(amount), "sum")})
    at = F.floor((F.col("_cum") - F.col(amount)) / quantum) + 1
    per = d.select(at.alias("level"), F.col(amount).alias("_a")).where(F.col("level") <= levels).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("bp"))
    every = reads.sparkSession.range(1, levels + 1).withColumnRenamed("id", "level").join(per, "level", "left")
    run = Window.partitionBy(F.lit(0)).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # a row a level
    return every.select("level", F.sum("n").over(run).alias("n"), F.sum("bp").over(run).alias("bp"))


def bimodal_reads(reads: DataFrame, cdf: DataFrame, draws: int, target: int, seed: int = 1, width: int = 500, bins: int = 70, attempts: int = 50) -> DataFrame:
    """Reads without replacement: the k-th draw of a bin takes its k-th read in hashed order, until ``target`` bases.

    cdf: bin, cum. ``draws`` is a first guess: while the reads fall short of the target there are four
    times as many, the first ones staying as they were. A draw on a bin that has no read left
    takes none. If the bins have too few reads for the target, or ``attempts`` draws a read
    do not reach it, that is an error with the figures.
    """
    binned = materialize(reads.withColumn("bin", F.least(F.floor(F.col("len") / width), F.lit(bins - 1))), "binned")
    before = F.coalesce(F.lag("cum").over(Window.partitionBy(F.lit(0)).orderBy("bin")), F.lit(0.0))  # a row a bin
    drawn = cdf.withColumn("_p", F.col("cum") - before).where("_p > 0").select("bin")
    left, most = binned.join(F.broadcast(drawn), "bin", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    if most < target:
        raise ValueError(f"the bins have {most} of {target} bases")
    while True:
        got = materialize(_drawn_reads(binned, cdf, draws, target, seed), "drawn")
        n, total = got.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if total >= target:
            return got
        if draws > attempts * max(left, 1):
            raise ValueError(f"{draws} draws took {n} of {left} reads, {total} of {target} bases")
        draws *= 4


def _drawn_reads(binned: DataFrame, cdf: DataFrame, draws: int, target: int, seed: int) -> DataFrame:
    table = cdf.agg(F.sort_array(F.collect_list(F.struct("cum", "bin"))).alias("t"))  # one row of bins
    d = binned.sparkSession.range(draws).withColumn("u", uniform(seed, 0, "id")).join(F.broadcast(table))
    d = d.select(F.col("id").alias("draw"), F.get(F.filter("t", lambda x: x["cum"] > F.col("u")), F.lit(0))["bin"].alias("bin")).where("bin is not null")
    d = ranks(d, ["bin"], F.floor(F.col("draw") / 65536), ["draw"])
    r = shuffled(binned, ["bin"], "read_id", seed)
    return take_until(d.join(r, ["bin", "rank"]), [F.col("draw")], "len", target, bucket=F.floor(F.col("draw") / 65536)).select("draw", "read_id", "bin", "len", "cum")


def feasible_target(available: Column, quantum: int) -> Column:
    """The largest multiple of a quantum that is available."""
    return F.floor(available / quantum) * quantum


def carriers(variants: DataFrame, haplotypes: int, seed: int = 1) -> DataFrame:
    """(haplotype_id, variant_id) by a draw against the variant's frequency."""
    v = variants.select("variant_id", "af", F.explode(F.sequence(F.lit(0), F.lit(haplotypes - 1))).alias("haplotype_id"))
    return v.where(uniform(seed, 1, "variant_id", "haplotype_id") < F.col("af")).select(F.col("haplotype_id").cast("long"), "variant_id")


def sample_variants(spark, types: DataFrame, lengths: DataFrame, afs: DataFrame, segments: DataFrame, n: int, n_frequent: int, frequent: float = 0.01, length: int = 2_000_000, seed: int = 1) -> DataFrame:
    """Up to ``n`` draws of type, length in its bin, frequency in its bin and position in a context, kept until ``n_frequent`` are frequent.

    types: svtype, ctx, cum; lengths: svtype, ctx, bin, cum; afs: svtype, bin, lo, q, cum;
    segments: chrom, ctx, from_pos, to_pos. All tables but the draws are model-sized. A variant
    that leaves the reference is rejected unless it is an insertion.
    """

    def table(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cum", *[c for c in df.columns if c not in (*keys, "cum")]))).alias(name)) if keys else df.agg(F.sort_array(F.collect_list(F.struct(*["cum", *[c for c in df.columns if c != "cum"]]))).alias(name))

    pick = lambda name, u: F.get(F.filter(name, lambda x: x["cum"] > u), F.lit(0))
    d = spark.range(n).withColumnRenamed("id", "variant_id").join(F.broadcast(table(types, [], "t")))
    d = d.withColumn("k", pick("t", uniform(seed, 2, "variant_id"))).select("variant_id", "k.svtype", "k.ctx").where("svtype is not null")
    d = d.join(F.broadcast(table(lengths, ["svtype", "ctx"], "l")), ["svtype", "ctx"]).withColumn("b", pick("l", uniform(seed, 3, "variant_id"))["bin"])
    d = d.withColumn("len", (50 + F.col("b") * 50 + F.floor(uniform(seed, 4, "variant_id") * 50)).cast("long")).drop("l", "b")
    d = d.join(F.broadcast(table(afs, ["svtype"], "a")), "svtype").withColumn("b", pick("a", uniform(seed, 5, "variant_id")))
    d = d.withColumn("af", F.col("b.lo") + (F.col("b.bin") + uniform(seed, 6, "variant_id")) * F.col("b.q")).drop("a", "b")
    s = segments.withColumn("_n", F.col("to_pos") - F.col("from_pos") + 1).withColumn("_tile", F.struct("chrom", F.floor(F.col("from_pos") / (1 << 20))))
    s = running(s, ["ctx"], "_tile", ["from_pos"], {"_end": (F.col("_n"), "sum")})
    d = d.join(F.broadcast(s.groupBy("ctx").agg(F.max("_end").alias("_all"))), "ctx").withColumn("_at", F.floor(uniform(seed, 7, "variant_id") * F.col("_all")))
    place = s.select("ctx", "chrom", (F.col("_end") - F.col("_n")).alias("_s"), (F.col("_end") - 1).alias("_e"), "from_pos")
    from .intervals import range_join

    d = range_join(d.drop("_all"), place, ["ctx"], ("_at", "_at"), ("_s", "_e")).withColumn("pos", F.col("from_pos") + F.col("_at") - F.col("_s")).drop("_at", "_s", "_e", "from_pos")
    d = d.where((F.col("svtype") == "INS") | (F.col("pos") + F.col("len") <= length))
    d = running(d.withColumn("_b", F.floor(F.col("variant_id") / 65536)), [], "_b", ["variant_id"], {"_f": ((F.col("af") >= frequent).cast("int"), "sum")}, inclusive=False)
    return d.where(F.col("_f") < n_frequent).drop("_f", "_b")


#: Bases of a tile of a haplotype, and how far beyond it a tile's rows are looked at to begin with.
TILE, HALO = 1 << 19, 1 << 16


def _least(left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The least rank of all ranges that meet each one. Ranges are sorted by start; left to right (exclusive) are the starts that lie in them.

    Of two ranges that meet, one holds the other's start: the least of what starts in a range, by minima of
    spans of 2, 4, 8 ... rows, and the least of what covers its start, by the same spans handed down.
    """
    level = np.frexp(right - left)[1] - 1
    up, down, inside = [rank], np.full(len(rank), len(rank), rank.dtype), rank.copy()
    for k in range(1, level.max() + 1):
        up.append(np.minimum(up[-1][: -(1 << k - 1)], up[-1][1 << k - 1 :]))
    for k in range(level.max(), -1, -1):
        at, step = np.flatnonzero(level == k), 1 << k
        inside[at] = np.minimum(up[k][left[at]], up[k][right[at] - step])
        np.minimum.at(down, left[at], rank[at])
        np.minimum.at(down, right[at] - step, rank[at])
        if k:
            half = down.copy()
            np.minimum(half[step >> 1 :], down[: -(step >> 1)], out=half[step >> 1 :])
            down = half
    return np.minimum(inside, down)


def _independent(lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, zone: tuple[int, int], core: tuple[int, int]) -> np.ndarray | None:
    """The ids that start in ``core`` and stay, by the rounds of ``without_collisions``; None if rows that are not here may bear on one of them.

    All ranges that meet ``zone`` are here. What is known of a row after a round depends on those that it meets, on what these
    meet, and so on: the zone in which all is known shrinks by the ranges over its edges, three times a round.
    """

    def shrunk(z: tuple[int, int]) -> tuple[int, int]:
        over, under = hi[(lo < z[0]) & (hi >= z[0])], lo[(hi > z[1]) & (lo <= z[1])]
        return (max(z[0], over.max() + 1) if len(over) else z[0], min(z[1], under.min() - 1) if len(under) else z[1])

    order, stay = np.argsort(lo, kind="stable"), []
    lo, hi, ids = lo[order], hi[order], ids[order]
    while True:
        own = (lo >= core[0]) & (lo < core[1])
        if not own.any():
            return np.concatenate([ids[:0], *stay])
        left, right = np.searchsorted(lo, lo, "left"), np.searchsorted(lo, hi, "right")
        n = right - np.searchsorted(np.sort(hi), lo, "left") - 1
        rank = np.empty(len(lo), np.int32)
        rank[np.lexsort((ids, n))] = np.arange(len(lo), dtype=np.int32)
        first = _least(left, right, rank) == rank
        out = np.searchsorted(lo[first], hi, "right") > np.searchsorted(np.sort(hi[first]), lo, "left")
        sure = shrunk(shrunk(zone))  # ranks, then what is first, then what goes
        known = (lo >= sure[0]) & (hi <= sure[1])
        zone = shrunk(sure)
        here = ~out & (hi >= zone[0]) & (lo <= zone[1])
        if (own & ~here & ~(known & out)).any():
            return None
        stay.append(ids[own & first])
        lo, hi, ids = lo[here], hi[here], ids[here]


def without_collisions(on_haplotype: DataFrame, reach: int = 5) -> DataFrame:
    """Variants of each haplotype that are left: in rounds, one that has the fewest colliding variants left of all that it collides with (then the least id) stays, and those go.

    haplotype_id, variant_id, first, last, and chrom unless all rows are of one; equal rows count once. No collision is listed: a tile of
    a haplotype with what lies around it counts them from sorted ends, in all rounds until its rows are settled. Where rows
    from farther away may bear on them, it looks four times as far. Only haplotypes with one id at several
    places, or ranges that end more than ``reach`` before they begin, go by lists of their collisions. A row with a null collides with none.
    """
    keys = [c for c in ("chrom", "haplotype_id") if c in on_haplotype.columns]
    every = on_haplotype.select(*keys, "variant_id", "first", "last")
    ship(on_haplotype.sparkSession)
    there = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs])
    named, placed = there(*keys, "variant_id"), there("first", "last")
    rows, lone = every.where(named & placed), every.where(~(named & placed)).distinct()
    got = materialize(_tiles(rows, keys, reach, HALO), "tiles")
    odd = got.where("_kind = 2").select(*keys).unionByName(_several(every.where(named), keys)).distinct()
    out = []
    if not odd.isEmpty():
        out.append(_without_listed(every.where(named).join(odd, keys, "left_semi").distinct(), keys, reach))
        got, lone = (d.join(odd, keys, "left_anti") for d in (got, lone))
    out.append(lone.select(*keys, "variant_id"))
    halo = HALO
    while True:
        out.append(got.where("_kind = 0").select(*keys, "variant_id"))
        again = got.where("_kind = 1").select(*keys, "_tile")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, out)
        halo *= 4
        got = materialize(_tiles(rows, keys, reach, halo, again), "tiles")


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the haplotypes that have an id at several places. Hashes alone are shuffled to find ids that are there twice."""
    at = F.xxhash64(*keys, "variant_id")
    twice = materialize(rows.select(at.alias("_h")).repartition("_h").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "twice")
    if twice.isEmpty():
        return rows.select(*keys).where("false")
    places = rows.withColumn("_h", at).join(twice, "_h", "left_semi").drop("_h").distinct()
    return materialize(places.groupBy(*keys, "variant_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).distinct(), "several")


def _tiles(rows: DataFrame, keys: list[str], reach: int, halo: int, only: DataFrame | None = None) -> DataFrame:
    """keys, _tile, variant_id, _kind: 0 for a variant that stays, and without a variant 1 for a tile that is not settled, 2 for one with a range that ends before it begins. ``only``: the tiles to do."""
    low, high = F.col("first"), F.col("last") + reach
    d = rows.withColumn("_tile", F.explode(F.sequence(F.floor((F.least(low, high) - halo) / TILE), F.floor((F.greatest(low, high) + halo) / TILE))))
    if only is not None:
        d = d.join(only, [*keys, "_tile"], "left_semi")
    # Places count from the tile; those beyond its zone are as good as next to it.
    small = "int" if TILE + 2 * halo < 1 << 30 else "long"
    at = lambda c: F.greatest(F.lit(-halo - 1), F.least(F.lit(TILE + halo), c - F.col("_tile") * TILE)).cast(small)
    # Lists of one aggregation are in the same order. They begin where rows are read, so a row is 16 bytes of a list when it is shuffled.
    lists = d.groupBy(*keys, "_tile").agg(F.max(low > high).alias("_odd"), F.collect_list("variant_id").alias("ids"), F.collect_list(at(low)).alias("lo"), F.collect_list(at(high)).alias("hi"))
    kept = T.StructType([*[rows.schema[c] for c in keys], T.StructField("_tile", T.LongType()), rows.schema["variant_id"], T.StructField("_kind", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, at, ids, kinds = [b.column(c) for c in ("ids", "lo", "hi")], [], [], []
            for i, odd in enumerate(b.column("_odd").to_pylist()):
                which, lo, hi = (c[i].values.to_numpy() for c in lists)
                stay = None
                if not odd:
                    one = np.unique(which, return_index=True)[1]
                    stay = _independent(lo[one].astype(np.int64), hi[one].astype(np.int64), which[one], (-halo, TILE + halo - 1), (0, TILE))
                ids.append(pa.nulls(1, lists[0].type.value_type) if stay is None else pa.array(stay, lists[0].type.value_type))
                at.append(np.full(len(ids[-1]), i))
                kinds.append(np.full(len(ids[-1]), 2 if odd else int(stay is None), np.int32))
            if at:
                k = b.select([*keys, "_tile"]).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*k.columns, pa.concat_arrays(ids), pa.array(np.concatenate(kinds))], [*keys, "_tile", "variant_id", "_kind"])

    return lists.mapInArrow(run, kept)


def _without_listed(rows: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``without_collisions`` by a list of all collisions; an id has all those of its places."""
    from . import rounds
    from .intervals import range_join

    low, high = F.col("first"), F.col("last") + reach
    side = lambda x: rows.select(*keys, F.col("variant_id").alias(x), low.alias(f"{x}_first"), high.alias(f"{x}_to"), F.least(low, high).alias(f"{x}_lo"), F.greatest(low, high).alias(f"{x}_hi"))
    met = range_join(side("a"), side("b"), keys, ("a_lo", "a_hi"), ("b_lo", "b_hi")).where("a <> b and b_first <= a_to and a_first <= b_to")
    gone = rounds.dropped(met.select(*keys, "a", "b"), keys)
    return rows.select(*keys, "variant_id").join(gone.withColumnRenamed("id", "variant_id"), [*keys, "variant_id"], "left_anti")


def apply_variants(reference: str | DataFrame, on_haplotype: DataFrame) -> DataFrame:
    """The sequence of each haplotype: haplotype_id, variant_id, svtype, pos, len, sequence (insertions).

    One reference contig is broadcast. Many are a DataFrame (contig, reference), where
    variants have a contig and positions in it: then every contig comes out on every
    haplotype, as it is where that has no variant, and a task holds one of them at a time.
    """
    back = str.maketrans("acgtACGT", "tgcaTGCA")

    def applied(ref: str, g: pd.DataFrame) -> str:
        out, at = [], 0
        for v in g.sort_values(["pos", "variant_id"]).itertuples():
            if v.pos < at:
                continue
            out.append(ref[at : v.pos])
            part = ref[v.pos : v.pos + v.len]
            at = v.pos + (0 if v.svtype == "INS" else v.len)
            if v.svtype == "DUP":
                out += [part, part]
            elif v.svtype == "INS":
                out.append(v.sequence)
            elif v.svtype == "INV":
                out.append(part[::-1].translate(back))
        out.append(ref[at:])
        return "".join(out)

    if isinstance(reference, str):
        shared = on_haplotype.sparkSession.sparkContext.broadcast(reference)

        def run(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"haplotype_id": [g["haplotype_id"].iloc[0]], "sequence": [applied(shared.value, g)]})

        return on_haplotype.groupBy("haplotype_id").applyInPandas(run, "haplotype_id long, sequence string")

    def run_on(r: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            raise ValueError(f"no reference for contig {g['_c'].iloc[0]}")
        return pd.DataFrame({"contig": r["contig"], "haplotype_id": r["haplotype_id"], "sequence": [applied(r["reference"].iloc[0], g)]})

    every = reference.crossJoin(F.broadcast(on_haplotype.select("haplotype_id").distinct()))
    v = on_haplotype.select(F.col("contig").alias("_c"), F.col("haplotype_id").alias("_h"), "variant_id", "svtype", "pos", "len", "sequence")
    return every.groupBy("contig", "haplotype_id").cogroup(v.groupBy("_c", "_h")).applyInPandas(run_on, "contig long, haplotype_id long, sequence string")


def insertion_choice(wanted: DataFrame, bank: DataFrame, quantum: int = 50, seed: int = 1) -> DataFrame:
    """A bank sequence for each wanted length, by draws: one of just that length, else a longer one of its length bin, else any of that bin; if the bin is empty, one of the next longer bin that is not, else of the longest. A longer one gives a piece at a drawn place; half are reverse complements.

    wanted: variant_id, len; bank: seq_id, seq. Returns variant_id, seq_id, len, sequence.
    """
    from ..functions.variants import reverse_complement

    b = bank.select("seq_id", "seq", F.length("seq").cast("long").alias("_len")).withColumn("bin", F.floor(F.col("_len") / quantum))
    b = ranks(b, ["bin"], F.struct("_len", F.pmod(F.xxhash64("seq_id"), F.lit(1024))), ["seq_id"], "k")
    # Of each bin, how many sequences are shorter than each length, and how many have it: ``quantum`` rows at most.
    sizes = b.groupBy("bin", "_len").agg(F.count(F.lit(1)).alias("n"), (F.min("k") - 1).alias("before"))
    lengths = sizes.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("_len", "before", "n"))).alias("t"), F.sum("n").alias("all"))
    bins = lengths.agg(F.sort_array(F.collect_list("bin")).alias("bins"))  # one row of bins
    own = F.floor(F.col("len") / quantum)
    w = wanted.join(F.broadcast(bins)).withColumn("bin", F.coalesce(F.get(F.filter("bins", lambda x: x >= own), F.lit(0)), F.element_at("bins", -1))).drop("bins").join(lengths, "bin")
    just, longer = (F.get(F.filter("t", f), F.lit(0)) for f in (lambda x: x["_len"] == F.col("len"), lambda x: x["_len"] > F.col("len")))
    here, every = F.col("bin") == own, F.struct(F.lit(0).cast("long").alias("from"), F.col("all").alias("n"))
    choice = F.when(here & just.isNotNull(), F.struct(just["before"].alias("from"), just["n"].alias("n"))).when(here & longer.isNotNull(), F.struct(longer["before"].alias("from"), (F.col("all") - longer["before"]).alias("n"))).otherwise(every)
    w = w.withColumn("c", choice).withColumn("k", F.col("c.from") + F.floor(uniform(seed, 8, "variant_id") * F.col("c.n")) + 1)
    j = w.select("variant_id", "len", "bin", "k").join(b, ["bin", "k"])
    n = F.least(F.col("len"), F.col("_len"))
    piece = F.col("seq").substr((F.floor(uniform(seed, 9, "variant_id") * (F.col("_len") - n + 1)) + 1).cast("int"), n.cast("int"))
    return j.withColumn("sequence", F.when(uniform(seed, 10, "variant_id") < 0.5, piece).otherwise(reverse_complement(piece))).select("variant_id", "seq_id", F.length("sequence").cast("long").alias("len"), "sequence")
