"""Call sets against truth: fuzzy matching, collapse, exact merges, genotype tables, scores.

Matching hashes on (chromosome, type, position bin of four times the tolerance), with the
probe in the one or two bins that it reaches, so no chromosome is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize, ship
from . import rounds


def candidates(truth: DataFrame, calls: DataFrame, distance: int = 500, size: float = 0.7, truth_len: tuple[int, int] = (50, 50_000), call_len: int = 30, similarity: float | None = None, on: tuple[str, ...] = (), beyond: int = -1) -> DataFrame:
    """Pairs of truth (variant_id, chrom, pos, svtype, len) and calls (call_id, ..., others) within distance and size ratio; d is the distance, more than ``beyond``.

    With ``similarity``, truth has ``t_seq`` and calls ``c_seq``, and the edit distance of a pair's
    sequences is at most the part of the longer one that is left (``alike``). ``on``: columns of
    both sides that a pair has to share.
    """
    rest = [c for c in truth.columns if c.startswith("t_")]
    width = 4 * max(distance, 1)  # a row of truth lies in one or two bins
    t = truth.where(F.col("len").between(*truth_len)).select(*on, "variant_id", "chrom", "svtype", *rest, F.col("pos").alias("t_pos"), F.col("len").alias("t_len"), F.explode(F.sequence(F.floor((F.col("pos") - distance) / width), F.floor((F.col("pos") + distance) / width))).alias("_bin"))
    c = calls.where((F.col("len") >= call_len) & (F.col("len") <= truth_len[1])).withColumnRenamed("pos", "c_pos").withColumnRenamed("len", "c_len").withColumn("_bin", F.floor(F.col("c_pos") / width))
    tenths = round(size * 10)
    if similarity is not None:
        # Rows are few bytes and a pair's edit distance is much work: partitions of a set number are not put together by their bytes.
        n = max(int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * truth.sparkSession.sparkContext.defaultParallelism)
        t, c = (d.repartition(n, *on, "chrom", "svtype", "_bin") for d in (t, c))
    near = F.abs(F.col("t_pos") - F.col("c_pos")).between(beyond + 1, distance) & (F.least("t_len", "c_len") * 10 >= F.greatest("t_len", "c_len") * tenths)
    pairs = t.join(c, [*on, "chrom", "svtype", "_bin"]).where(near).withColumn("d", F.abs(F.col("t_pos") - F.col("c_pos"))).drop("_bin")
    return pairs if similarity is None else pairs.where(alike("t_seq", "c_seq", similarity))


def alike(a: str, b: str, similarity: float) -> Column:
    """Whether edits for at most 1 - ``similarity`` of the longer sequence turn one into the other. Only the band that such a distance can reach is computed; sequences whose lengths alone differ more are not compared. A null sequence is like none."""
    most = F.floor(F.greatest(F.length(a), F.length(b)) * (100 - round(similarity * 100)) / 100).cast("int")
    fits = F.abs(F.length(a) - F.length(b)) <= most
    return F.coalesce(F.when(fits, F.call_function("levenshtein", F.col(a), F.col(b), most) >= 0), F.lit(False))


def one_to_one(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy matching by (d, variant_id, call_id) in each group, until no pair is left whose sides are both free."""
    return rounds.match(pairs, group, "variant_id", "call_id", "d")


#: Pairs a row, by counts of bins, up to which all distances are matched at once.
CROWDED = 4.0


def bands(truth: DataFrame, calls: DataFrame, distance: int, on: tuple[str, ...] = ()) -> list[int]:
    """Growing distances up to ``distance``: the more rows lie together, the smaller the first one; each is four times the one before. Counts of bins tell."""
    keys = [*on, "chrom", "svtype"]
    count = lambda d, name: d.groupBy(*keys, F.floor(F.col("pos") / distance).alias("_bin")).agg(F.count(F.lit(1)).alias(name))
    n = count(truth, "_t").join(count(calls, "_c"), [*keys, "_bin"], "full").agg(F.sum(F.col("_t").cast("double") * F.col("_c")).alias("met"), F.sum("_t").alias("t"), F.sum("_c").alias("c")).first()
    crowd = 2 * (n["met"] or 0.0) / max((n["t"] or 0) + (n["c"] or 0), 1)
    out = [distance]
    while crowd > CROWDED and out[0] > 1:
        crowd /= 4
        out.insert(0, out[0] // 4)
    return out


def matched(truth: DataFrame, calls: DataFrame, group: list[str], on: tuple[str, ...] = (), keep: tuple[str, ...] = (), distance: int = 500, **rule) -> DataFrame:
    """``one_to_one`` of ``candidates``: group, variant_id, call_id, d and ``keep``. group: columns of calls, and ``on``, which both sides have.

    Greedy matching takes pairs by distance first, so what is near is matched to the end before what is
    farther is looked at, and only rows that are free then take part (``bands``). Where many rows lie
    together nearly all are matched at once, and pairs grow with the rows, not with their crowding.
    """
    more = [c for c in group if c not in on]
    columns = list(dict.fromkeys([*on, "variant_id", "chrom", "pos", "svtype", "len", *[c for c in truth.columns if c.startswith("t_")]]))
    extra = [c for c in keep if c in calls.columns and c not in columns]
    truth, calls = truth.select(*columns), calls.select(*dict.fromkeys([*group, "call_id", "chrom", "pos", "svtype", "len", *[c for c in calls.columns if c.startswith("c_")], *extra]))
    steps = bands(truth, calls, distance, on)
    if len(steps) > 1:
        truth, calls = materialize(truth, "free"), materialize(calls, "free")
    # The columns of calls in a group as one, in which a null is equal to a null: a set.
    of, out, reached = F.struct(F.lit(0).alias("_0"), *more), [], -1
    if len(steps) > 1:
        sets = materialize(calls.select(*on, of.alias("_of")).distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("_sets")), "sets")
        calls, truth = calls.withColumn("_of", of), truth.withColumn("t_taken", F.array().cast(T.ArrayType(calls.select(of).schema[0].dataType)))
    for i, reach in enumerate(steps):
        pairs = candidates(truth, calls, reach, on=on, beyond=reached, **rule)
        if i:
            pairs = pairs.where(~F.array_contains("t_taken", F.col("_of")))
        took = one_to_one(pairs.select(*dict.fromkeys([*group, "variant_id", "call_id", "d", *keep])), group)
        out.append(took)
        if i + 1 == len(steps):
            return reduce(DataFrame.unionByName, out)
        # A row of truth stays one row with the sets in which it is taken, and goes when it is in all: it is not there once a set.
        took = took.select(*on, of.alias("_of"), "variant_id", "call_id")
        taken = took.groupBy(*on, "variant_id").agg(F.collect_set("_of").alias("_new"))
        truth = truth.join(taken, [*on, "variant_id"], "left").withColumn("t_taken", F.array_union("t_taken", F.coalesce("_new", F.slice("t_taken", 1, 0)))).drop("_new")
        truth = truth.join(F.broadcast(sets), list(on)) if on else truth.crossJoin(F.broadcast(sets))
        truth = materialize(truth.where(F.size("t_taken") < F.col("_sets")).drop("_sets"), "free")
        calls = materialize(calls.join(took.select(*on, "_of", "call_id"), [*on, "_of", "call_id"], "left_anti"), "free")
        reached = reach


def scores(n_truth: Column, n_calls: Column, tp: Column) -> list[Column]:
    """tp, fp, fn, precision, recall, f1; null where a denominator is 0."""
    precision, recall = tp / F.nullif(n_calls, F.lit(0)), tp / F.nullif(n_truth, F.lit(0))
    f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    return [tp.alias("tp"), (n_calls - tp).alias("fp"), (n_truth - tp).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def bench(truth: DataFrame, calls: DataFrame, group: str, **rule) -> DataFrame:
    """Scores per group of calls (a caller) against one truth set."""
    tp = matched(truth, calls, [group], **rule).groupBy(group).agg(F.count(F.lit(1)).alias("_tp"))
    n = calls.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).join(tp, group, "left").crossJoin(truth.agg(F.count(F.lit(1)).alias("_t")))
    return n.select(group, *scores(F.col("_t"), F.col("_c"), F.coalesce("_tp", F.lit(0))))


def unmatched(side: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """False negatives (truth) or false positives (calls)."""
    return side.join(matched.select(key).distinct(), key, "left_anti")


def exact_merge(calls: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """One row per exact allele with its samples, ordered."""
    return calls.groupBy(*keys).agg(F.sort_array(F.collect_set(sample)).alias("samples")).withColumn("n_samples", F.size("samples"))


def collapse(calls: DataFrame, support: str, distance: int = 500, size: float = 0.95, least: int = 40) -> DataFrame:
    """Near-duplicates fold into kept calls: call_id, kept_id, of every call in the length window.

    In the order of support (largest first, then least id) a call that is not folded yet is
    kept and what is within its reach folds into it. So a kept call is its own and
    is never folded, and of several kept calls in reach the first takes a call.
    """
    c = calls.where(F.col("len").between(least, 50_000)).select("call_id", "chrom", "pos", "svtype", "len", (-F.col(support)).alias("n"))

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.withColumnsRenamed({"call_id": "variant_id", "n": "t_n"}), b.withColumnRenamed("n", "c_n")
        pairs = candidates(a, b, distance, size, (least, 50_000), least).where("variant_id <> call_id")
        return pairs.select(F.col("variant_id").alias("a"), F.col("call_id").alias("b"), F.col("t_n").alias("a_n"), F.col("c_n").alias("b_n"))

    # In batches: what is kept lies apart, so a row has few kept ones in reach, however many calls there are.
    steps, into = rounds.prefixes(c, ["n", "call_id"]), []
    left = materialize(c, "left") if steps else c
    for step in [*steps, None]:
        batch = left if step is None else left.where(step)
        # Both ways already: either side of a pair is a truth and a call.
        pairs = materialize(near(batch, batch), "near")
        folded = materialize(rounds.dropped(pairs, [], ["n"]), "folded")
        met = pairs.join(folded.withColumnRenamed("id", "b"), "b").join(folded.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b", "a_n")
        if step is not None:
            kept, rest = batch.join(folded.withColumnRenamed("id", "call_id"), "call_id", "left_anti"), left.where(~step)
            met = met.unionByName(near(kept, rest).select("a", "b", "a_n"))
        into.append(met.groupBy("b").agg(F.min(F.struct("a_n", "a")).alias("k")).select(F.col("b").alias("call_id"), F.col("k.a").alias("kept_id")))
        if step is not None:
            into[-1] = materialize(into[-1], "into")
            left = materialize(rest.join(into[-1], "call_id", "left_anti"), "left")
    return c.select("call_id").distinct().join(reduce(DataFrame.unionByName, into), "call_id", "left").withColumn("kept_id", F.coalesce("kept_id", "call_id"))


def genotypes(carriers: DataFrame) -> DataFrame:
    """(haplotype_id, variant_id) to the phased genotype of each individual: haplotypes 2k and 2k + 1."""
    g = carriers.groupBy(F.floor(F.col("haplotype_id") / 2).alias("individual"), "variant_id").agg(F.max(F.when(F.col("haplotype_id") % 2 == 0, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("haplotype_id") % 2 == 1, 1).otherwise(0)).alias("b"))
    return g.select("individual", "variant_id", F.concat(F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string")).alias("gt"))


def frequencies(carriers: DataFrame, haplotypes: int) -> DataFrame:
    return carriers.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / haplotypes).alias("af"))


#: Bases of a tile of a haplotype, and pairs that come out of it at a time.
TILE, PAIRS = 1 << 16, 1 << 17


def neighbours(on_haplotype: DataFrame, reach: int = 5) -> DataFrame:
    """Pairs of variants of one haplotype whose ranges come within ``reach``: chrom if given, haplotype_id, a < b by (first, id). Columns: chrom unless all rows are of one, haplotype_id, variant_id, first, last; equal rows count once.

    A row goes to each tile that it meets, in lists that begin where rows are read. In the order of starts what collides with a row is what
    comes next, so that nothing is compared but starts with ends; a pair comes out of the tile where b starts, as
    an element of a's list of at most ``PAIRS``.
    """
    keys = [c for c in ("chrom", "haplotype_id") if c in on_haplotype.columns]
    spark = on_haplotype.sparkSession
    ship(spark)
    # A row without an end may still begin in another.
    d = on_haplotype.select(*keys, "variant_id", "first", F.coalesce(F.col("last") + reach, F.lit(-(1 << 60))).alias("_to")).dropna()
    d = d.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("first") / TILE), F.floor(F.greatest("first", "_to") / TILE))))
    at = lambda c: F.collect_list(F.col(c) - F.col("_tile") * TILE)
    # Lists of one aggregation are in the same order. They are few bytes for the pairs that they give, so their partitions are of a set number.
    lists = d.groupBy(*keys, "_tile").agg(F.collect_list("variant_id").alias("ids"), at("first").alias("lo"), at("_to").alias("hi"))
    lists = lists.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys, "_tile")
    variant = on_haplotype.schema["variant_id"].dataType
    kept = T.StructType([*[on_haplotype.schema[c] for c in keys], T.StructField("a", variant), T.StructField("_b", T.ArrayType(variant))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                ids, lo, hi = (t.column(c)[i].values.to_numpy() for c in ("ids", "lo", "hi"))
                order = np.lexsort((hi, ids, lo))
                ids, lo, hi = ids[order], lo[order], hi[order]
                other = np.r_[True, (ids[1:] != ids[:-1]) | (lo[1:] != lo[:-1])]
                new = other | np.r_[True, hi[1:] != hi[:-1]]
                ids, lo, hi, other = ids[new], lo[new], hi[new], other[new]
                # Of one id at one start, with several ends, none is later.
                place = np.cumsum(other)
                start = np.maximum(np.searchsorted(place, place, "right"), np.searchsorted(lo, 0))
                n = np.maximum(np.searchsorted(lo, hi, "right") - start, 0)
                done = np.concatenate([[0], np.cumsum(n)])
                for p in range(0, int(done[-1]), PAIRS):
                    q = min(p + PAIRS, int(done[-1]))
                    f, l = np.searchsorted(done, p, "right") - 1, np.searchsorted(done, q, "left")
                    ends = np.clip(done[f : l + 1], p, q)
                    b = np.arange(p, q) + np.repeat(start[f:l] - done[f:l], np.diff(ends))
                    met = pa.ListArray.from_arrays(pa.array(ends - p, pa.int32()), pa.array(ids[b]))
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(t.column(c)[i], l - f) for c in keys], pa.array(ids[f:l]), met], [*keys, "a", "_b"])

    return lists.mapInArrow(run, kept).select(*keys, "a", F.explode("_b").alias("b"))


def trio_truth(child: DataFrame, *parents: DataFrame, **rule) -> DataFrame:
    """Calls of a child with the parents (0, 1, ...) whose calls they match: call_id, parents. One matching a parent, merged on the call."""
    t = child.select(F.col("call_id").alias("variant_id"), "chrom", "pos", "svtype", "len")
    every = reduce(DataFrame.unionByName, [p.select("call_id", "chrom", "pos", "svtype", "len", F.lit(i).alias("parent")) for i, p in enumerate(parents)])
    best = matched(t, every, ["parent"], **rule)
    return exact_merge(best.withColumnRenamed("call_id", "_of").withColumnRenamed("variant_id", "call_id"), ["call_id"], "parent").select("call_id", F.col("samples").alias("parents"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the value of their key; a key that the table lacks is an error when the row is read."""
    got = rows.join(table.select(key, F.col(value).alias("_v"), F.lit(True).alias("_there")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string"))).cast(table.schema[value].dataType)
    return got.withColumn(value, F.when(F.col("_there").isNull(), missing).otherwise(F.col("_v"))).drop("_v", "_there")


def genotype_matches(truth: DataFrame, calls: DataFrame, kinds: list[str], runs: list[str], **rule) -> DataFrame:
    """Per ``kinds`` (columns of truth) and ``runs`` (columns of calls): tp, same (matches of equal genotype) and measured (recall). Each run is matched for itself; truth and calls have a genotype, ``t_gt`` and ``gt``."""
    best = matched(truth, calls, runs, keep=tuple(dict.fromkeys((*kinds, "t_gt", "gt"))), **rule)
    tp = best.groupBy(*kinds, *runs).agg(F.count(F.lit(1)).alias("tp"), F.count_if(F.col("t_gt") == F.col("gt")).alias("same"))
    n = truth.groupBy(*kinds).agg(F.count(F.lit(1)).alias("_n"))
    return tp.join(n, kinds).select(*kinds, *runs, "tp", "same", (F.col("tp") / F.col("_n")).alias("measured"))


def genotype_concordance(matches: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Of ``genotype_matches``: n_true, the true variants that matches and recall imply at the largest ``level``; and against it recall, share of matches of equal genotype, and recall of those."""
    top = F.first(F.col("tp") / F.col("measured")).over(Window.partitionBy(*keys).orderBy(F.desc(level)))
    d = matches.withColumn("n_true", top)
    return d.select(*keys, level, "tp", "n_true", (F.col("tp") / F.col("n_true")).alias("recall"), (F.col("same") / F.col("tp")).alias("concordance"), (F.col("same") / F.col("n_true")).alias("exact_recall"))
