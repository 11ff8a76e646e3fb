"""Empirical statistics: histograms, smoothing, distributions, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def length_bin(length: Column, least: int = 50, step: int = 50, last: int = 19999) -> Column:
    return F.least(F.floor((length - least) / step), F.lit(last)).cast("long")


def histogram(df: DataFrame, keys: list, bin: Column) -> DataFrame:
    return df.groupBy(*keys, bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def densify(hist: DataFrame, keys: list[str], last: Column | int) -> DataFrame:
    """Every bin from 0 to ``last`` of every key, absent ones with n 0. ``last`` is fixed or a column of the keys' own."""
    frame = hist.groupBy(*keys).agg((last if isinstance(last, Column) else F.lit(last)).cast("long").alias("_last"))
    frame = frame.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("bin"))
    return frame.join(hist, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smooth(dense: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Centred moving average over 2 * radius + 1 bins; bins nearer to an edge keep their count."""
    w = Window.partitionBy(*keys).orderBy("bin")
    inside = (F.row_number().over(w) > radius) & (F.lead("bin", radius).over(w).isNotNull())
    mean = F.sum("n").over(w.rowsBetween(-radius, radius)) / (2 * radius + 1)
    return dense.withColumn("smoothed", F.when(inside, mean).otherwise(F.col("n").cast("double")))


def smooth_int(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Three-bin sum divided by 3 without remainder; edges keep their count."""
    w = Window.partitionBy(*keys).orderBy("bin")
    inside = F.lag("bin").over(w).isNotNull() & F.lead("bin").over(w).isNotNull()
    return dense.withColumn("smoothed", F.when(inside, F.floor(F.sum("n").over(w.rowsBetween(-1, 1)) / 3)).otherwise(F.col("n")).cast("long"))


def distribution(hist: DataFrame, keys: list[str], by: str = "bin") -> DataFrame:
    """Probability and cumulative probability within each key."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("cum", F.sum("n").over(run) / F.sum("n").over(w))


def maxima(dense: DataFrame, width: int, least_n: int = 500, from_len: int = 1000, to_len: int = 25000, n: str = "n") -> DataFrame:
    """Strict local maxima with enough reads in the length range; the last two."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")  # bins, not reads: bounded by the longest length over the width
    d = dense.withColumn("_a", F.lag(n).over(w)).withColumn("_b", F.lead(n).over(w))
    top = d.where((F.col(n) > F.col("_a")) & (F.col(n) > F.col("_b")) & (F.col(n) >= least_n) & ((F.col("bin") + 1) * width - 1 >= from_len) & (F.col("bin") * width <= to_len))
    return top.orderBy(F.desc("bin")).limit(2).select("bin", n)


def first_minimum(dense: DataFrame, n: str = "n") -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    d = dense.withColumn("_a", F.lag(n).over(w)).withColumn("_b", F.lead(n).over(w))
    return d.where((F.col(n) < F.col("_a")) & (F.col(n) < F.col("_b"))).agg(F.min("bin").alias("bin"))


def equal_width(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """Histogram between each key's minimum and maximum; the maximum falls into the last bin."""
    edge = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("total"))
    q = (F.col("hi") - F.col("lo")) / bins
    bin = F.when(q > 0, F.least(F.floor((F.col(x) - F.col("lo")) / q), F.lit(bins - 1))).otherwise(0).cast("long")
    out = df.join(edge, keys).groupBy(*keys, "lo", "hi", "total", bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("p", F.col("n") / F.col("total")).drop("total")


def mirrored_deviation(dense: DataFrame, mode: int, width: int) -> DataFrame:
    """Standard deviation around a mode if the side above it is mirrored below."""
    d = (F.col("bin") - mode) * width
    up, at = F.col("bin") > mode, F.col("bin") == mode
    two = F.sum(F.when(up, 2 * F.col("n") * d * d).otherwise(0)) / (F.sum(F.when(up, 2 * F.col("n")).otherwise(0)) + F.sum(F.when(at, F.col("n")).otherwise(0)))
    return dense.agg(F.sqrt(two).alias("sd"))


def by_edges(df: DataFrame, keys: list[str], x: str, edges: list[int]) -> DataFrame:
    """Counts between arbitrary edges; below the first edge is bin 0."""
    bin = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + (F.abs(F.col(x)) >= e).cast("int"))
    return df.where(F.col(x).isNotNull()).groupBy(*keys, bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def project_arms(hist: DataFrame, arms: DataFrame, target_p: int, target_q: int, width: int) -> DataFrame:
    """Counts of position bins rescaled to a target chromosome, arm by arm.

    hist: chrom, bin, n; arms: chrom, p (length of the short arm), length. A bin's mass
    is spread over the target bins that its image covers, in proportion.
    """
    b = hist.join(arms, "chrom").withColumn("s", F.col("bin") * width).withColumn("e", F.least(F.col("s") + width, F.col("length"))).where("s < e")
    in_p = F.col("s") + (F.col("e") - F.col("s")) / 2 < F.col("p")
    scale = F.when(in_p, F.lit(target_p) / F.col("p")).otherwise(F.lit(target_q) / (F.col("length") - F.col("p")))
    to = lambda x: F.when(in_p, F.least(x * scale, F.lit(float(target_p)))).otherwise(F.lit(target_p) + F.greatest(x - F.col("p"), F.lit(0)) * scale)
    b = b.withColumn("ts", to(F.col("s"))).withColumn("te", to(F.col("e"))).where("te > ts")
    t = b.withColumn("target", F.explode(F.sequence(F.floor(F.col("ts") / width), F.floor((F.col("te") - 1e-9) / width))))
    share = (F.least(F.col("te"), (F.col("target") + 1) * width) - F.greatest(F.col("ts"), F.col("target") * width)) / (F.col("te") - F.col("ts"))
    return t.groupBy(F.col("target").alias("bin")).agg(F.sum(F.col("n") * share).alias("mass"))


def read_profile(reads: DataFrame) -> DataFrame:
    """One row: number of reads, lengths (total, shortest, longest, mean, sd) and accuracies of their qualities (mean, sd, least, largest)."""
    from ..functions.variants import accuracy

    d = reads.select(F.length("sequence").cast("long").alias("n"), accuracy(F.col("quality")).alias("a"))
    lengths = [F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd")]
    return d.agg(*lengths, F.avg("a").alias("accuracy"), F.stddev_pop("a").alias("accuracy_sd"), F.min("a").alias("accuracy_min"), F.max("a").alias("accuracy_max"))
