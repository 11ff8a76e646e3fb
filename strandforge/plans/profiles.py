"""Queries over reads and models: profiles with accuracies, text models, coverage by fractions, numeric functions, allele-length records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import sampling, statistics
from ..session import scratch
from ..sources import formats, sinks
from .catalog import query

_ACCURACY = "(SELECT 1-avg(power(10.0,-(ascii(c)-33)/10.0)) FROM (SELECT unnest(string_split(translate(seq,'ACGTN','I5+?!'),'')) AS c) u)"


def _fastq(dna: DataFrame) -> DataFrame:
    path = scratch(dna.sparkSession, "fastq")
    rows = dna.select(F.concat(F.lit("@r"), F.col("seq_id").cast("string")).alias("header"), F.col("seq").substr(F.lit(1), (F.col("seq_id") % 8 + 1).cast("int")).alias("sequence"))
    sinks.write_fastq(rows.withColumn("quality", F.translate("sequence", "ACGTN", "I5+?!")), path)
    return formats.fastq(dna.sparkSession, path, 1 << 16)


@query("dna", f"WITH s AS (SELECT substr(seq,1,CAST(seq_id%8+1 AS INTEGER)) AS seq FROM dna), x AS (SELECT length(seq) AS n, {_ACCURACY} AS a FROM s) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total, min(n) AS shortest, max(n) AS longest, round(avg(n),6) AS mean, round(stddev_pop(n),6) AS sd, round(avg(a),6) AS accuracy, round(stddev_pop(a),6) AS accuracy_sd, round(min(a),6) AS accuracy_min, round(max(a),6) AS accuracy_max FROM x")
def agg13_src17_fastq_profile(dna):
    """AGG13, SRC17, SRC16: lengths and accuracies of a FASTQ, its profile stored and read back."""
    spark, path = dna.sparkSession, scratch(dna.sparkSession, "profile")
    statistics.read_profile(_fastq(dna)).write.parquet(path)
    p = spark.read.parquet(path)
    return p.select("n", "total", "shortest", "longest", *[F.round(c, 6).alias(c) for c in p.columns[4:]])


@query("dna", f"WITH s AS (SELECT seq_id, substr(seq,1,CAST(seq_id%8+1 AS INTEGER)) AS seq FROM dna) SELECT concat('@r',CAST(seq_id AS VARCHAR)) AS header, round(a,9) AS accuracy FROM (SELECT seq_id, length(seq) AS n, {_ACCURACY} AS a FROM s) x WHERE n BETWEEN 3 AND 7 AND a BETWEEN 0.7 AND 0.97")
def flt20_src17_accuracy_window(dna):
    """FLT20, SRC17: reads of a FASTQ in a window of lengths and of accuracies of their qualities."""
    from ..functions import variants as fn

    d = _fastq(dna).withColumn("accuracy", fn.accuracy(F.col("quality")))
    return d.where(F.length("sequence").between(3, 7) & F.col("accuracy").between(0.7, 0.97)).select("header", F.round("accuracy", 9).alias("accuracy"))


_TYPES = ("DEL", "DUP", "INS", "INV")
_I = "CASE svtype WHEN 'DEL' THEN 0 WHEN 'DUP' THEN 1 WHEN 'INS' THEN 2 ELSE 3 END"


@query("variants", f"""
WITH v AS (SELECT {_I} AS i, CASE filter WHEN 'PASS' THEN 0 WHEN 'MULTIALLELIC' THEN 1 ELSE 2 END AS j, least(CAST(floor((len-50)/50.0) AS BIGINT),99) AS b, least(CAST(floor(pos/100000) AS BIGINT),20) AS p, CAST(floor(af*50) AS BIGINT) AS a, af FROM variants)
SELECT 'types' AS part, CAST(i AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY i UNION ALL SELECT 'contexts', i, j, NULL, NULL, NULL, count(*) FROM v GROUP BY i, j
 UNION ALL SELECT 'lengths', i, j, b, NULL, NULL, count(*) FROM v GROUP BY i, j, b UNION ALL SELECT 'frequencies', i, a, NULL, min(min(af)) OVER (PARTITION BY i), max(max(af)) OVER (PARTITION BY i), count(*) FROM v GROUP BY i, a UNION ALL SELECT 'positions', i, p, NULL, NULL, NULL, count(*) FROM v GROUP BY i, p""")
def src13_text_model(variants):
    """SRC13, SNK6: a model in text files, written and imported: its five statistics with the bounds of frequencies; what is not 0."""
    spark, path = variants.sparkSession, scratch(variants.sparkSession, "text-model")
    index = lambda c, names: (F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("long")
    v = variants.select(index("svtype", _TYPES).alias("i"), index("filter", ("PASS", "MULTIALLELIC", "LOWQUAL")).alias("j"), F.least(F.floor((F.col("len") - 50) / 50), F.lit(99)).alias("b"), F.least(F.floor(F.col("pos") / 100_000), F.lit(20)).alias("p"), F.floor(F.col("af") * 50).alias("a"), "af")
    n = lambda *keys: v.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, "ijk")]).agg(F.count(F.lit(1)).cast("double").alias("value"))
    bounds = v.groupBy("i").agg(F.min("af").alias("low"), F.max("af").alias("high"))
    sinks.write_text_model({"types": (n("i"), (4,), None), "contexts": (n("i", "j"), (4, 3), None), "lengths": (n("i", "j", "b"), (4, 3, 100), None), "frequencies": (n("i", "a"), (4, 50), bounds), "positions": (n("i", "p"), (4, 21), None)}, path, spark)
    parts = [d.select(F.lit(k).alias("part"), *[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("k", "long"), ("low", "double"), ("high", "double"))], "value") for k, d in formats.text_model(spark, path).items()]
    return reduce(DataFrame.unionByName, parts).where("value <> 0")


@query("reads", "WITH o AS (SELECT len, sum(len) OVER (ORDER BY read_id%97, read_id ROWS UNBOUNDED PRECEDING)-len AS before FROM reads) SELECT c AS level, count(*) AS n, CAST(sum(len) AS BIGINT) AS bp FROM o, unnest(range(1,9)) r(c) WHERE before<c*12500.5 GROUP BY 1")
def win13_fractional_levels(reads):
    """WIN13: reads up to every multiple of a quantum of bases that need not be whole, from one scan: the level of each read, then running sums."""
    bucket = F.struct(F.col("read_id") % 97, F.floor(F.col("read_id") / 65536))
    return sampling.prefix_levels(reads, [F.col("read_id") % 97, F.col("read_id")], "len", 12500.5, 8, bucket)


@query("variants", "SELECT variant_id, round(lgamma(len%500+0.5),6) AS log_gamma, round(gamma(len%20+1.25)/gamma(len%20+1),6) AS ratio, round(exp(-(len%1000)/1000.0),9) AS decay FROM variants")
def fn14_gamma_exp(variants):
    """FN14: gamma and exponential functions."""
    n = F.col("len")
    ratio = F.exp(numbers.log_gamma(n % 20 + 1.25) - numbers.log_gamma(n % 20 + 1.0))
    return variants.select("variant_id", F.round(numbers.log_gamma(n % 500 + 0.5), 6).alias("log_gamma"), F.round(ratio, 6).alias("ratio"), F.round(F.exp(-(n % 1000) / 1000.0), 9).alias("decay"))


@query("dna", """
WITH a AS (SELECT seq_id, substr(seq,1,CAST(CASE WHEN seq_id%2=0 THEN 1 ELSE seq_id%8+1 END AS INTEGER)) AS ref, substr(seq,1,CAST(CASE WHEN seq_id%2=0 THEN seq_id%8+1 ELSE 1 END AS INTEGER)) AS alt FROM dna),
 k AS (SELECT *, CASE WHEN length(ref)=1 AND length(alt)>=5 THEN 'INS' WHEN length(ref)>=5 AND length(alt)=1 THEN 'DEL' END AS t, greatest(length(ref),length(alt))-1 AS n FROM a)
SELECT seq_id, concat_ws(chr(9), 'chr1', CAST(seq_id+1 AS VARCHAR), '.', ref, alt, '60', 'PASS', concat('SVTYPE=', t, ';SVLEN=', CASE WHEN t='DEL' THEN '-' ELSE '' END, CAST(n AS VARCHAR), ';END=', CAST(seq_id+1+CASE WHEN t='INS' THEN 1 ELSE n END AS VARCHAR), ';QNAME=t'), 'GT', '1/1') AS line FROM k WHERE t IS NOT NULL""")
def prj1_allele_length_records(dna):
    """PRJ1, FLT15: records of explicit alleles with FILTER and INFO rewritten: type, signed length and END from the alleles, before what INFO had; others are dropped."""
    even = F.col("seq_id") % 2 == 0
    n = (F.col("seq_id") % 8 + 1).cast("int")
    line = F.concat_ws("\t", F.lit("chr1"), (F.col("seq_id") + 1).cast("string"), F.lit("."), F.col("seq").substr(F.lit(1), F.when(even, 1).otherwise(n)), F.col("seq").substr(F.lit(1), F.when(even, n).otherwise(1)), F.lit("60"), F.lit("q"), F.lit("QNAME=t"), F.lit("GT"), F.lit("1/1"))
    return dna.select("seq_id", sinks.allele_length_record(line, 4).alias("line")).where("line is not null")


@query("reads")
def sim20_one_mode(reads):
    """SIM20: the mixture with all weight on one mode."""
    from . import studies

    return studies.read_length_study(reads, left_weight=1.0, target=50_000)
