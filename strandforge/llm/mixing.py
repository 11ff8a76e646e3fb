"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every (document, copy) gets a virtual finish time: the words its source has sent by
then, itself included, divided by the source's target. All are put in the order of
that time and the mix ends when the budget is used. A source's running sum is taken
in buckets of a hashed key: bucket sums, their prefix, then a window inside each
bucket, so a source with most rows is spread over all buckets. The global order is
cut likewise: sums by slice of virtual time find the slice in which the budget ends,
and only that slice is sorted row by row. Buckets and slices are 4096 at least and
grow with the rows, so that none holds much more than ``PER_BUCKET`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import n_words

#: Rows of a bucket, beyond 4096 buckets.
PER_BUCKET = 50_000


def digits(rows: int) -> int:
    """Hexadecimal digits of the key that name a bucket."""
    n = 3
    while rows > PER_BUCKET * 16**n and n < 6:
        n += 1
    return n


def source_targets(sizes: DataFrame, budget: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per ``_skey``: ``_ssize`` and ``_target``. sizes: one row per source (``_skey``, ``_ssize``).

    Targets share ``budget`` of all words by weight; none exceeds ``most`` times its
    source. Sorted by cap over weight, the first source whose cap is not below its
    share of what is left sets the level for itself and all later ones.
    """
    alone = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("_skey")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    t = sizes.withColumn("_w", w).withColumn("_cap", (F.col("_ssize") * most).cast("double")).withColumn("_all", F.sum("_ssize").over(alone) * budget)
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_skey")
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("_level", (F.col("_all") - before) / F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(alone)
    return t.withColumn("_l", level).select("_skey", "_ssize", F.least("_cap", F.coalesce(F.col("_l") * F.col("_w"), F.col("_cap"))).alias("_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, budget: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken (words), copies (times taken).

    A null text has size 0. Null sources form one source, ordered last. Sources of
    no words get target 0, as has every source of an empty mix. Documents are taken
    whole, at most ``most`` times; the one in which the budget ends is taken, and
    documents of no words are taken as often as their place in the order says. The
    order comes from a hash of id and size, so reruns agree; rows equal in both are
    interchangeable. Columns of other names are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("")), n_words(docs[text_col]).cast("string")))
    skey = F.coalesce(F.concat(F.lit("0"), docs[source_col].cast("string")), F.lit("1"))
    rows = materialize(docs.select(docs[id_col].alias("_id"), skey.alias("_skey"), n_words(docs[text_col]).alias("_size"), key.alias("_key")), "mix-sizes")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    width = digits(n_rows)
    rows = rows.withColumn("_b", F.substring("_key", 1, width))

    buckets = rows.groupBy("_skey", "_b").agg(F.sum("_size").alias("_bsize"))
    inner = Window.partitionBy("_skey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_before", F.coalesce(F.sum("_bsize").over(inner), F.lit(0)))
    targets = source_targets(buckets.groupBy("_skey").agg(F.sum("_bsize").alias("_ssize")), budget, weights, most)
    offsets = offsets.join(targets, "_skey")
    run = Window.partitionBy("_skey", "_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_run", F.sum("_size").over(run)).join(offsets.select("_skey", "_b", "_before", "_ssize", "_target"), ["_skey", "_b"])
    placed = materialize(placed.withColumn("_cum", F.col("_before") + F.col("_run")), "mix-placed")

    def finish(copy):
        return (copy * F.col("_ssize") + F.col("_cum")).cast("double") / F.col("_target")

    copies = placed.where("_target > 0 and _size > 0").select("*", F.explode(F.array(*map(F.lit, range(most)))).alias("_copy")).withColumn("_f", finish(F.col("_copy")))
    # All copies by virtual time 1 make up the budget but for a document a source; later times share one slice.
    copies = copies.withColumn("_slice", F.floor(F.least(F.col("_f"), F.lit(2.0)) * (1 << (4 * width))).cast("int"))
    limit = total * budget
    sums = copies.groupBy("_slice").agg(F.sum("_size").alias("_n"))
    sums = sums.withColumn("_until", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
    edge = sums.where(F.col("_until") >= limit).orderBy("_slice").limit(1).first()
    taken = F.lit(0)
    if total and edge is None:  # the caps end the mix before the budget does
        taken = F.lit(most)
    elif total:
        ordered = Window.partitionBy("_slice").orderBy("_f", "_skey", "_key", "_copy")
        last = copies.where(F.col("_slice") == edge["_slice"]).withColumn("_sum", F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + (edge["_until"] - edge["_n"]))
        cut = last.where(F.col("_sum") >= limit).orderBy("_f", "_skey", "_key", "_copy").limit(1).first()
        for c in range(most):
            here = F.struct(finish(F.lit(c)), F.col("_skey"), F.col("_key"), F.lit(c))
            until = F.struct(F.lit(cut["_f"]), F.lit(cut["_skey"]), F.lit(cut["_key"]), F.lit(cut["_copy"]))
            taken = taken + (here <= until).cast("int")
        taken = F.when(F.col("_target") > 0, taken).otherwise(0)
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_ssize").alias("source_size"), F.col("_target").cast("double").alias("target"), (F.col("_size") * taken).cast("long").alias("taken"), taken.cast("int").alias("copies"), F.col("_key").alias("mix_key")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, whole, each as many times as the mix takes it (rows of no words: at most once).

    Null ids, sources and texts, ties and repeated rows are taken as ``mix`` says; an empty
    table gives none; columns may share names.
    """
    taken = mix(docs, id_col, text_col, source_col, **options)
    times = taken.groupBy(F.xxhash64(id_col).alias("_a"), F.col("size").alias("_b")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    cols = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)], F.xxhash64(docs[id_col]).alias("_a"), n_words(docs[text_col]).alias("_b"))
    # Rows of one id and size are interchangeable to the mix: the first of them take what doesn't divide evenly.
    order = Window.partitionBy("_a", "_b").orderBy(F.xxhash64(*[c for c, f in zip(cols, docs.schema.fields) if f.dataType.typeName() not in ("map", "variant")]))
    joined = rows.join(times, ["_a", "_b"]).withColumn("_rn", F.row_number().over(order))
    k = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_rn") <= F.col("_copies") % F.col("_rows")).cast("int")
    n = F.when(F.col("_b") == 0, F.least(k, F.lit(1))).otherwise(k).cast("int")
    out = joined.withColumn("_n", n).where("_n > 0")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_c"), *cols).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
