"""Exact dedup by skew-safe combining, with DataFrame functions only.

Copies meet in three steps: the partial aggregate removes those of one input
partition, a salted aggregate merges up to ``salts`` partial results of one text,
and a global aggregate combines the salt winners. Every step groups by digest AND
full text, so equal digests of different texts never merge. What a hot text sends
is bounded by the number of input partitions, then by ``salts``.

Each row learns its class by a join on the digest; Spark splits hot digests of
that join at run time. Should one digest have several texts, its rows are matched
by full text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import ascii_lower, keep_rows, row_hash


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row per class of equal (``_digest``, ``_text``): ``_keep`` (largest ``_id``) and ``_n``."""
    salted = rows.withColumn("_salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return merged.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def _decide(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """Per row: _id, _keep, _n, _kept, _sha, and _tie, a hash of the whole row."""
    t = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(docs[id_col].alias("_id"), t.alias("_text"), row_hash(docs).alias("_tie"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    classes = combine(rows.select("_id", "_text", "_digest"), salts)
    by_digest = classes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n"))
    by_digest = materialize(by_digest, "exact-classes")
    # The order within (digest, id) matters only where an id repeats.
    first = F.row_number().over(Window.partitionBy("_digest", "_id").orderBy("_tie")) == 1
    sha = F.sha2(F.col("_text"), 256).alias("_sha")
    out = rows.select("_id", "_digest", sha, "_tie").withColumn("_first", first).join(by_digest.where("_texts = 1").drop("_texts"), "_digest")
    clash = by_digest.where("_texts > 1").select("_digest")
    if not clash.isEmpty():
        hard = rows.join(clash, "_digest", "left_semi")
        hard = hard.withColumn("_first", F.row_number().over(Window.partitionBy("_digest", "_text", "_id").orderBy("_tie")) == 1)
        hard = hard.join(combine(hard.select("_id", "_text", "_digest"), salts), ["_digest", "_text"])
        out = out.unionByName(hard.withColumn("_sha", sha).drop("_text"))
    return out.withColumn("_kept", F.col("_id").eqNullSafe(F.col("_keep")) & F.col("_first"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """Per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as
    empty. The largest id of a class stays; null ids come before all others, so a
    class of null ids has keep_id null. Of rows that share both text and id, one
    stays: the first by a hash of their columns. An empty table gives an empty
    result. Other columns of ``docs``, whatever their names, are read for that tie
    only. ``digest`` may be weak: classes compare full texts.
    """
    return _decide(docs, id_col, text_col, salts, digest).select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    kept = _decide(docs, id_col, text_col, salts, sha256_bytes).where("_kept")
    return keep_rows(docs, kept.select(F.xxhash64("_id").alias("_a"), F.col("_tie").alias("_b")), id_col)
