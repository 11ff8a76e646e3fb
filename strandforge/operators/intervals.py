"""Interval operators: range joins, merges, sweeps, set algebra. Coordinates are 0-based and closed.

Range joins hash on (chromosome, level, bin). An interval lies on the level whose bins
are at least as long as itself, so it falls into two bins at most; a probe looks at
the bins that its window touches on each level. A pair is kept in one bin only: the
later of the two first bins. So no pair is repeated and no distinct is needed, and a
hot chromosome is spread over its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, ship

#: Bin widths of the levels: 4 kb, 32 kb, 256 kb, 2 Mb, 16 Mb, 128 Mb, 1 Gb.
LEVELS = tuple(4096 * 8**k for k in range(7))


def _bins(lo: Column, hi: Column, width: Column | int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """All pairs with equal ``on`` whose closed ranges meet. Other column names must differ."""
    (a, b), (c, d) = left_range, right_range
    level = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        level = F.when(F.col(d) - F.col(c) < LEVELS[k], F.lit(k)).otherwise(level)
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in LEVELS]), F.col("_level") + 1)
    r = right.withColumn("_level", level).withColumn("_bin", F.explode(_bins(F.col(c), F.col(d), width)))

    def at_level(k: int) -> Column:
        return F.transform(_bins(F.col(a), F.col(b), LEVELS[k]), lambda x: F.struct(F.lit(k).alias("l"), x.alias("b")))

    # The levels in use, one row of at most seven: others are not probed.
    used = r.agg(F.collect_set("_level").alias("_used"))
    none = F.array().cast("array<struct<l:int,b:bigint>>")
    probes = F.flatten(F.array(*[F.when(F.array_contains("_used", k), at_level(k)).otherwise(none) for k in range(len(LEVELS))]))
    lft = left.join(F.broadcast(used)).withColumn("_p", F.explode(probes)).withColumn("_level", F.col("_p.l")).withColumn("_bin", F.col("_p.b")).drop("_p", "_used")
    met = lft.join(r, [*on, "_level", "_bin"]).where((F.col(c) <= F.col(b)) & (F.col(d) >= F.col(a)))
    return met.where(F.col("_bin") == F.floor(F.greatest(F.col(a), F.col(c)) / width)).drop("_level", "_bin")


def merge_types(t: str = "type") -> Column:
    """The union of context types: one kind alone, else both (2)."""
    return F.when(F.min(t) == F.max(t), F.min(t)).otherwise(F.lit(2))


def tolerance(evidence: Column) -> Column:
    return F.when(evidence.contains("SR"), 25).when(evidence.contains("PE"), 250).otherwise(1000)


def annotate(points: DataFrame, repeats: DataFrame, segdups: DataFrame | None = None, key: str = "variant_id", lo: Column | None = None, hi: Column | None = None, segdup_tolerance: int | None = 25) -> DataFrame:
    """Repeat context of each point: 0 repeat, 1 satellite, 2 both, 3 segmental duplication, 4 none.

    points: key, chrom, pos, and ``tol`` unless lo and hi are given. repeats: chrom,
    rstart, rend, is_sat. segdups: chrom, sstart, send; without ``segdup_tolerance``, in the
    same window. Rows come out once a key.
    """
    lo = F.col("pos") - F.col("tol") if lo is None else lo
    hi = F.col("pos") + F.col("tol") if hi is None else hi
    kinds = repeats.select("chrom", "rstart", "rend", F.lit(0).alias("_of"), F.col("is_sat").cast("int").alias("type"))
    windows = [F.struct(F.lit(0).alias("of"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))]
    if segdups is not None:
        kinds = kinds.unionByName(segdups.select("chrom", F.col("sstart").alias("rstart"), F.col("send").alias("rend"), F.lit(1).alias("_of"), F.lit(3).alias("type")))
        if segdup_tolerance is not None:
            lo, hi = F.col("pos") - segdup_tolerance, F.col("pos") + segdup_tolerance
        windows.append(F.struct(F.lit(1).alias("of"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))
    # What is asked is whether a kind is there, so disjoint pieces say as much as all intervals do, however deep these lie.
    parts = materialize(pieces(kinds, ["chrom", "_of", "type"], "rstart", "rend"), "pieces")
    at = lambda w: F.transform(F.sequence(F.floor(w["lo"] / PIECE), F.floor(w["hi"] / PIECE)), lambda b: F.struct(w["of"].alias("of"), w["lo"].alias("lo"), w["hi"].alias("hi"), b.alias("b")))
    p = points.select(key, "chrom", F.explode_outer(F.flatten(F.transform(F.array(*windows), lambda w: F.coalesce(at(w), F.array().cast("array<struct<of:int,lo:bigint,hi:bigint,b:bigint>>"))))).alias("_w"))
    p = p.select(key, F.col("chrom").alias("_c"), "_w.*").alias("p")
    near = (F.col("_c") == F.col("chrom")) & (F.col("of") == F.col("_of")) & (F.col("b") == F.col("_bin")) & (F.col("rstart") <= F.col("hi")) & (F.col("rend") >= F.col("lo"))
    found = p.join(parts, near, "left").select(key, F.when(F.col("_of") == 0, F.col("type")).alias("_r"), F.when(F.col("_of") == 1, F.col("type")).alias("_s"))
    found = found.groupBy(key).agg(F.when(F.min("_r").isNotNull(), merge_types("_r")).alias("_r"), F.max("_s").alias("_s"))
    return found.select(key, F.coalesce("_r", "_s", F.lit(4)).cast("int").alias("ctx"))


def clipped_overlaps(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of ``range_join`` with their intersection, from_pos and to_pos."""
    met = range_join(left, right, on, left_range, right_range)
    return met.withColumn("from_pos", F.greatest(left_range[0], right_range[0])).withColumn("to_pos", F.least(left_range[1], right_range[1]))


#: Bases of a tile of intersections, and pairs that come out of it at a time.
MEET, PAIRS = 1 << 16, 1 << 17


def _slices(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with start[i] <= j < stop[i], at most ``PAIRS`` at a time."""
    n = np.maximum(stop - start, 0)
    done = np.concatenate([[0], np.cumsum(n)])
    for p in range(0, int(done[-1]), PAIRS):
        q = min(p + PAIRS, int(done[-1]))
        f, l = np.searchsorted(done, p, "right") - 1, np.searchsorted(done, q, "left")
        many = np.diff(np.clip(done[f : l + 1], p, q))
        yield np.repeat(np.arange(f, l), many), np.arange(p, q) + np.repeat(start[f:l] - done[f:l], many)


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in the order of columns, and how often each is there."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def clipped_counts(left: DataFrame, right: DataFrame, on: str, key: str, kind: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Distinct intersections with their counts: ``key`` of left, ``kind`` and the first position of right, from_pos, to_pos, n. Key and kind are whole numbers.

    Both sides go once to the tiles that they meet, as lists; a pair comes out of the tile where its intersection begins, as an
    element of a slice of sorted starts, so pairs are neither shuffled nor kept and what is on disk grows with the rows. Equal rows of
    left are one there, and rows of right that begin together count as one where they reach over the row. Keys of left that
    several different ranges share, and null ones, if any, are joined and grouped after.
    """
    (a, b), (c, d) = left_range, right_range
    spark = left.sparkSession
    ship(spark)
    left, right = left.select(key, on, a, b), right.select(on, kind, c, d)
    # Most keys are there once, and to count them is few bytes; only of the others ranges are compared.
    several = materialize(left.dropna().groupBy(key).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(key), "several")
    if not several.isEmpty():
        place = F.struct(on, a, b)
        several = left.dropna().join(several, key, "left_semi").groupBy(key).agg((F.min(place) < F.max(place)).alias("_many"))
        several = materialize(several.where("_many").select(key), "several")
    rest = left.where(F.col(key).isNull())
    alone = left.dropna()
    if not several.isEmpty():
        rest, alone = rest.unionByName(left.join(several, key, "left_semi")), alone.join(several, key, "left_anti")

    def met(rows: DataFrame, others: DataFrame) -> DataFrame:
        pairs = range_join(rows, others, [on], (a, b), (c, d)).select(key, kind, c, F.greatest(a, c).alias("from_pos"), F.least(b, d).alias("to_pos"))
        return pairs.groupBy(key, kind, c, "from_pos", "to_pos").agg(F.count(F.lit(1)).alias("n"))

    side = lambda df, own, what, lo, hi: df.dropna().select(on, F.lit(own).alias("_own"), F.col(what).cast("long").alias("_x"), F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"))
    every = side(alone, True, key, a, b).unionByName(side(right, False, kind, c, d))
    every = every.withColumn("_tile", F.explode(_bins(F.col("_lo"), F.greatest("_lo", "_hi"), MEET)))
    # Lists of one aggregation are in the same order.
    lists = every.groupBy(on, "_tile").agg(*[F.collect_list(x).alias(x) for x in ("_own", "_x", "_lo", "_hi")]).drop(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                tile = t.column("_tile")[i].as_py() * MEET
                own, x, lo, hi = (t.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("_own", "_x", "_lo", "_hi"))
                (first, ids, last), m = _counted(lo[own], x[own], hi[own])
                (start, kinds, end), n = _counted(lo[~own], x[~own], hi[~own])
                if not len(first) or not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] != start[:-1]) | (kinds[1:] != kinds[:-1])
                # Rows from one to the last that begins with it, of its kind; and the end of the one before, if it is of these.
                until = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
                sums, below = np.concatenate([[0], np.cumsum(n)]), np.where(new, np.iinfo(np.int64).min, np.concatenate([[0], end[:-1]]))
                inner = ((v, k) for v, k in _slices(np.searchsorted(start, np.maximum(first, tile)), np.searchsorted(start, last, "right")))
                outer = ((v, k) for k, v in _slices(np.searchsorted(first, np.maximum(start + 1, tile)), np.searchsorted(first, end, "right")))
                for found in (inner, outer):
                    for v, k in found:
                        over = np.maximum(first, last)[v]
                        ends = end[k] < over
                        good = (start[k] <= last[v]) & (end[k] >= first[v]) & (ends | (below[k] < over))
                        v, k, ends = v[good], k[good], ends[good]
                        out = [ids[v], kinds[k], start[k], np.maximum(first[v], start[k]), np.minimum(last[v], end[k]), np.where(ends, n[k], sums[until[k]] - sums[k]) * m[v]]
                        yield pa.RecordBatch.from_arrays([pa.array(o.astype(np.int64)) for o in out], ["k", "kind", "c", "f", "t", "n"])

    tiles = lists.mapInArrow(run, "k long, kind long, c long, f long, t long, n long")
    same = lambda df, name: df.schema[name].dataType
    place = met(left, right).schema
    out = [tiles.select(F.col("k").cast(same(left, key)).alias(key), F.col("kind").cast(same(right, kind)).alias(kind), F.col("c").cast(same(right, c)).alias(c), F.col("f").cast(place["from_pos"].dataType).alias("from_pos"), F.col("t").cast(place["to_pos"].dataType).alias("to_pos"), "n")]
    if not rest.isEmpty():
        out.append(met(rest, right))
    odd = right.where(F.col(kind).isNull())
    if not odd.isEmpty():
        out.append(met(alone, odd))
    return reduce(DataFrame.unionByName, out)


_FOLDS = {"sum": F.sum, "max": F.max}


def running(df: DataFrame, keys: list[str], tile: str, order: list, folds: dict[str, tuple[Column, str]], inclusive: bool = True, base: DataFrame | None = None) -> DataFrame:
    """Running sums or maxima of each key in the order of (``tile``, ``order``), as new columns. ``base``: the same rows before columns were added, for the totals.

    Totals of tiles, their prefix over tiles, then a window inside each tile: a key that
    holds all rows is as many tasks' work as it has tiles. Neither keys nor tile is null.
    """
    above = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df if base is None else base).groupBy(*keys, tile).agg(*[_FOLDS[kind](c).alias(f"_t{n}") for n, (c, kind) in folds.items()])
    totals = totals.select(*keys, tile, *[_FOLDS[kind](f"_t{n}").over(above).alias(f"_t{n}") for n, (_, kind) in folds.items()])
    inside = Window.partitionBy(*keys, tile).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = df.withColumns({f"_i{n}": _FOLDS[kind](c).over(inside) for n, (c, kind) in folds.items()}).join(totals, [*keys, tile])
    zero = F.lit(0)
    out = {n: F.greatest(f"_i{n}", f"_t{n}") if kind == "max" else F.coalesce(f"_i{n}", zero) + F.coalesce(f"_t{n}", zero) for n, (_, kind) in folds.items()}
    return d.withColumns(out).drop(*[f"_{x}{n}" for n in folds for x in "it"])


def neighbour(df: DataFrame, keys: list[str], tile: str, order: list[str], column: str, name: str, ahead: bool = False) -> DataFrame:
    """``column`` of the row before (or after) in the order of (``tile``, ``order``); null at the end. Tiles as in ``running``; the order is unique."""
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    value = F.struct(F.col(column).alias("v"))
    edges = df.groupBy(*keys, tile).agg(edge(value, F.struct(*order)).alias("_edge"))
    edges = edges.select(*keys, tile, step("_edge").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(tile)).alias("_edge"))
    near = step(value).over(Window.partitionBy(*keys, tile).orderBy(*order))
    return df.withColumn("_near", near).join(edges, [*keys, tile]).withColumn(name, F.coalesce("_near", "_edge")["v"]).drop("_near", "_edge")


#: Bases of a tile.
TILE = 1 << 20


def merge(df: DataFrame, keys: list[str], start: str, end: str, slack: int, aggs: list[Column] | None = None, tile: int | None = TILE) -> DataFrame:
    """Gaps and islands: an interval joins while start <= (largest end so far) + slack.

    slack is minus the least overlap, or the largest gap. The largest end so far and the
    number of islands begun go by tiles of starts (``running``), so a chromosome with
    most rows is spread; without a tile, by one window a key. ``aggs`` take columns named
    ``min_*`` (minimum) and ``max_*`` (maximum).
    """
    names = [c for c in df.columns if c.startswith(("min_", "max_"))]
    folds = [(F.min(c) if c.startswith("min_") else F.max(c)).alias(c) for c in names]
    new = F.when(F.col("_e").isNull() | (F.col(start) > F.col("_e") + slack), 1).otherwise(0)
    if tile:
        d = running(df.withColumn("_tile", F.floor(F.col(start) / tile)), keys, "_tile", [start, end], {"_e": (F.col(end), "max")}, inclusive=False).withColumn("_new", new)
        d = materialize(d, "merge")
        # Of rows equal in both, the one that begins an island comes first.
        d = running(d, keys, "_tile", [start, end, F.desc("_new")], {"_g": (F.col("_new"), "sum")})
    else:
        order = Window.partitionBy(*keys).orderBy(start, end)
        d = df.withColumn("_e", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        d = d.withColumn("_g", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), *folds, *(aggs or [])).drop("_g")


#: Bases of a piece at most; pieces end at multiples of it.
PIECE = 4096


def cut(df: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals cut at multiples of ``PIECE``, with ``_bin``."""
    at = F.col("_bin") * PIECE
    d = df.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), PIECE)))
    return d.withColumn(start, F.greatest(F.col(start), at).cast("long")).withColumn(end, F.least(F.col(end), at + (PIECE - 1)).cast("long"))


def pieces(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end, _bin: the bases that intervals cover, as disjoint pieces of one bin each. Their number is bounded by the bases of the keys, not by the intervals.

    Each bin is merged for itself. Intervals of more than 64 bins are merged before they are cut,
    so that many long ones are not many times their length in pieces.
    """
    d = df.select(*keys, start, end).where(F.col(start) <= F.col(end))
    wide = F.col(end) - F.col(start) >= 64 * PIECE
    long = d.where(wide)
    if not long.isEmpty():
        d = d.where(~wide).unionByName(merge(long, keys, start, end, 0))
    return merge(cut(d, start, end), [*keys, "_bin"], start, end, 0, tile=None)


def inside(rows: DataFrame, others: DataFrame, on: str, row_range: tuple[str, str], other_range: tuple[str, str]) -> DataFrame:
    """Distinct ``rows`` with ``inside``: whether one of the others holds them whole.

    Of the others that touch a bin only those count that end later than all that begin before, which
    are few however deep they lie.
    """
    (a, b), (c, d) = row_range, other_range
    o = others.select(F.col(on).alias("_on"), F.col(c).alias("_c"), F.col(d).alias("_d")).where("_c <= _d").withColumn("_bin", F.explode(_bins(F.col("_c"), F.col("_d"), PIECE)))
    before = Window.partitionBy("_on", "_bin").orderBy("_c", F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    front = materialize(o.withColumn("_e", F.max("_d").over(before)).where("_e is null or _d > _e").drop("_e"), "front")
    holds = (F.col(on) == F.col("_on")) & (F.floor(F.col(a) / PIECE) == F.col("_bin")) & (F.col("_c") <= F.col(a)) & (F.col("_d") >= F.col(b))
    return rows.join(front, holds, "left").groupBy(*rows.columns).agg(F.max(F.col("_on").isNotNull()).alias("inside"))


def sweep(df: DataFrame, keys: list[str], start: str, end: str, kind: str, kinds: list, tile: int = TILE) -> DataFrame:
    """Disjoint segments by which kinds cover them: from_pos, to_pos and a count ``n_<kind>`` each. Gaps between intervals have counts 0."""
    at = F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("p"), F.lit(-1).alias("d")))
    events = df.select(*keys, kind, F.explode(at).alias("x")).groupBy(*keys, F.col("x.p").alias("p")).agg(*[F.sum(F.when(F.col(kind) == k, F.col("x.d")).otherwise(0)).alias(f"d_{k}") for k in kinds])
    events = events.withColumn("_tile", F.floor(F.col("p") / tile))
    out = neighbour(events, keys, "_tile", ["p"], "p", "_next", ahead=True)
    out = running(out, keys, "_tile", ["p"], {f"n_{k}": (F.col(f"d_{k}"), "sum") for k in kinds}, base=events)
    return out.where("_next is not null").select(*keys, F.col("p").alias("from_pos"), (F.col("_next") - 1).alias("to_pos"), *[f"n_{k}" for k in kinds])


def context_partition(repeats: DataFrame, segdups: DataFrame, lengths: DataFrame, pad: int = 25, unknown: DataFrame | None = None) -> DataFrame:
    """Every base of a chromosome in one class: 2 where repeats and satellites (both padded) meet, else 0 or 1, else 3, else 4.

    repeats: chrom, rstart, rend, is_sat; segdups: chrom, sstart, send; lengths: chrom,
    length; unknown: chrom, ustart, uend, runs of letters other than ACGT, whose bases are
    in no class. Returns chrom, from_pos, to_pos, ctx.
    """
    every = repeats.select("chrom", (F.col("rstart") - pad).alias("s"), (F.col("rend") + pad).alias("e"), F.col("is_sat").cast("int").alias("k"))
    every = every.unionByName(segdups.select("chrom", (F.col("sstart") - pad).alias("s"), (F.col("send") + pad).alias("e"), F.lit(3).alias("k")))
    if unknown is not None:
        every = every.unionByName(unknown.select("chrom", F.col("ustart").alias("s"), F.col("uend").alias("e"), F.lit(5).alias("k")))
    every = every.join(F.broadcast(lengths), "chrom")  # one row a chromosome
    every = every.withColumn("s", F.greatest("s", F.lit(0))).withColumn("e", F.least("e", F.col("length") - 1)).where("s <= e").drop("length")
    every = every.unionByName(lengths.select("chrom", F.lit(0).cast("long").alias("s"), (F.col("length") - 1).alias("e"), F.lit(4).alias("k")))
    seg = sweep(every, ["chrom"], "s", "e", "k", [0, 1, 3, 4, 5]).where("n_4 > 0")
    ctx = F.when((F.col("n_0") > 0) & (F.col("n_1") > 0), 2).when(F.col("n_1") > 0, 1).when(F.col("n_0") > 0, 0).when(F.col("n_3") > 0, 3).otherwise(4)
    seg = seg.withColumn("ctx", ctx)
    # Neighbouring segments of one class become one.
    seg = seg.withColumn("ctx", F.when(F.col("n_5") > 0, -1).otherwise(F.col("ctx"))).select("chrom", "from_pos", "to_pos", "ctx").withColumn("_tile", F.floor(F.col("from_pos") / TILE))
    # Written once: each step below reads it twice.
    seg = materialize(neighbour(materialize(seg, "segments"), ["chrom"], "_tile", ["from_pos"], "ctx", "_was"), "segments")
    seg = running(seg, ["chrom"], "_tile", ["from_pos"], {"_g": (F.when(F.col("_was") == F.col("ctx"), 0).otherwise(1), "sum")})
    return seg.groupBy("chrom", "_g", "ctx").agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos")).drop("_g").where("ctx >= 0")


def unknown_runs(chunks: DataFrame) -> DataFrame:
    """Runs of letters other than ACGT in chunks of a reference (chrom, offset, seq): chrom, ustart, uend. Runs that go on in the next chunk are not joined."""
    n = F.length("seq")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.col("seq").substr(i, F.lit(1)).rlike("[ACGTacgt]") & ((i == 1) | F.col("seq").substr(i - 1, F.lit(1)).rlike("[ACGTacgt]")))
    runs = chunks.where(F.col("seq").rlike("[^ACGTacgt]")).select("chrom", "offset", F.explode(starts).alias("i"), F.col("seq"))
    size = F.length(F.regexp_extract(F.expr("substring(seq, i)"), "^[^ACGTacgt]+", 0))
    return runs.select("chrom", (F.col("offset") + F.col("i") - 1).alias("ustart"), (F.col("offset") + F.col("i") - 2 + size).alias("uend"))


def covered(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Bases covered by at least one interval, per key."""
    return merge(df.select(*keys, start, end), keys, start, end, 0, tile=None).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias("covered"))


def complement(merged: DataFrame, lengths: DataFrame, key: str, start: str, end: str, tile: int = TILE) -> DataFrame:
    """Gaps of disjoint intervals in [0, length)."""
    edges = merged.select(key, F.col(start).alias("s"), F.col(end).alias("e")).unionByName(lengths.select(key, F.col("length").alias("s"), F.col("length").alias("e")))
    edges = neighbour(edges.withColumn("_tile", F.floor(F.col("s") / tile)), [key], "_tile", ["s"], "e", "_was")
    return edges.select(key, (F.coalesce("_was", F.lit(-1)) + 1).alias("from_pos"), (F.col("s") - 1).alias("to_pos")).where("from_pos <= to_pos")


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def touching(rows: DataFrame, others: DataFrame, on: list[str], row_range: tuple[str, str], other_range: tuple[str, str]) -> DataFrame:
    """Distinct ``rows`` that meet any of the others; these count as disjoint pieces, however deep they lie. Column names but ``on`` differ."""
    (a, b), (c, d) = row_range, other_range
    parts = materialize(pieces(others, on, c, d), "pieces")
    w = rows.withColumn("_bin", F.explode(_bins(F.col(a), F.col(b), PIECE)))
    return w.join(parts, [*on, "_bin"]).where((F.col(c) <= F.col(b)) & (F.col(d) >= F.col(a))).select(*rows.columns).distinct()


def greedy_disjoint(df: DataFrame, key: str, first: list[str], on: str = "chrom") -> DataFrame:
    """Rows in the order of (``first``, ``key``) that overlap none taken before; ranges are the columns first and last, keys are unique.

    Rows go in batches (``rounds.prefixes``): what a batch takes is disjoint, and rules out most of the next.
    """
    from . import rounds

    side = lambda d, x: d.select(on, F.col(key).alias(x), F.col("first").alias(f"{x}_from"), F.col("last").alias(f"{x}_to"), *[F.col(c).alias(f"{x}_{c}") for c in first])
    steps, left, out = rounds.prefixes(df, [*first, key]), df, []
    for step in [*steps, None]:
        batch = left if step is None else left.where(step)
        met = range_join(side(batch, "a"), side(batch, "b"), [on], ("a_from", "a_to"), ("b_from", "b_to")).where("a <> b")
        kept = batch.join(rounds.dropped(met, [on], first).withColumnRenamed("id", key), [on, key], "left_anti")
        if steps:
            kept = materialize(kept, "kept")
        out.append(kept)
        if step is not None:
            walls = kept.select(on, F.col("first").alias("from_pos"), F.col("last").alias("to_pos"))
            rest = left.where(~step)
            left = materialize(rest.join(touching(rest.select(on, key, "first", "last"), walls, [on], ("first", "last"), ("from_pos", "to_pos")), [on, key], "left_anti"), "left")
    return reduce(DataFrame.unionByName, out)
