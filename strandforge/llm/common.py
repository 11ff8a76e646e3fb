"""What several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` has a fast path for pure ASCII, where it does just that."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def atomic(df: DataFrame) -> list[Column]:
    """The columns that can be hashed."""
    return [df[f"`{f.name}`"] for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*atomic(df))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose (hash of id, ``row_hash``) is in ``kept`` (``_a``, ``_b``); of rows equal in everything, one."""
    cols = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[f"`{c}`"].alias(x) for c, x in zip(docs.columns, cols)], F.xxhash64(docs[id_col]).alias("_a"), row_hash(docs).alias("_b"))
    one = rows.join(kept, ["_a", "_b"], "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("_a", "_b").orderBy(F.lit(0)))).where("_rn = 1")
    return one.select(*[F.col(x).alias(c) for c, x in zip(docs.columns, cols)])
