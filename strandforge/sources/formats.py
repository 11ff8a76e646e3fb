"""Readers for the text formats of annotations, calls, reads and families.

Each returns a DataFrame with an explicit schema. Where a format spans lines (FASTA,
FASTQ), records are split by the reader itself, so a file is read in parallel where
its compression allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import records


def fasta(spark: SparkSession, path: str, least: int = 100, most: int = 10**9) -> DataFrame:
    """name, sequence; one row per record. Sequences outside [least, most] are left out."""
    lines = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    at = F.instr("value", "\n")
    seq = F.regexp_replace(F.col("value").substr(at + 1, F.length("value")), r"\s", "")
    out = lines.select(F.trim(F.split(F.substring_index("value", "\n", 1), r"\s")[0]).alias("name"), F.when(at > 0, seq).otherwise(F.lit("")).alias("sequence"))
    return out.where(F.length("sequence").between(least, most))


def fastq(spark: SparkSession, path: str | list[str], size: int = records.RANGE) -> DataFrame:
    """file, header, sequence, quality. Files are read by ranges of ``size`` bytes, block-wise gzip too; other gzip is one range that streams."""
    return records.fastq(spark, path, size)


VCF = T.StructType([T.StructField(n, t) for n, t in (("chrom", T.StringType()), ("pos", T.LongType()), ("id", T.StringType()), ("ref", T.StringType()), ("alt", T.StringType()), ("qual", T.StringType()), ("filter", T.StringType()), ("info", T.StringType()), ("format", T.StringType()), ("samples", T.ArrayType(T.StringType())))])


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths in a file of paths, one a line; empty lines are none. A plan names its files on the driver anyway."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> ''").select(F.trim("value")).collect()]


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The fixed columns, FORMAT, samples and the file of every record; header lines are skipped."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("file", F.input_file_name())
    cols = [F.get(p, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(VCF.fields[:-1])]
    samples = F.when(F.size(p) > 9, F.slice(p, F.lit(10), F.size(p))).alias("samples")
    return lines.select("file", *cols, samples)


def named_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``vcf`` with caller, individual, read_length and coverage from names like caller_i12_l10000_c8.vcf."""
    name = F.regexp_extract("file", "([^/]*)$", 1)
    part = lambda rx: F.regexp_extract(name, rx, 1)
    return vcf(spark, path).select("*", part("^([^_]+)_").alias("caller"), part("_i([^_.]+)").alias("individual"), part("_l([0-9]+)").cast("int").alias("read_length"), part("_c([0-9]+)").cast("int").alias("coverage"))


def _csv(spark: SparkSession, path, columns: dict[int, tuple[str, str]], width: int, **options) -> DataFrame:
    schema = ", ".join(f"{columns[i][0]} {columns[i][1]}" if i in columns else f"_u{i} string" for i in range(width))
    return spark.read.schema(schema).csv(path, **options).select(*[n for n, _ in columns.values()])


def repeat_masker(spark: SparkSession, path: str) -> DataFrame:
    """0-based closed intervals with consensus coordinates by strand; names in lower case."""
    c = {4: ("chrom", "string"), 5: ("start", "long"), 6: ("end", "long"), 8: ("strand", "string"), 9: ("repeat", "string"), 10: ("family", "string"), 11: ("c1", "string"), 12: ("c2", "string"), 13: ("c3", "string")}
    r = _csv(spark, path, c, 14)
    number = lambda x: F.regexp_replace(x, "[()]", "").cast("long")
    fwd = F.col("strand") == "+"
    return r.select("chrom", (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"), number(F.when(fwd, F.col("c1")).otherwise(F.col("c3"))).alias("rep_start"), number(F.col("c2")).alias("rep_end"), fwd.alias("fwd"), F.lower("repeat").alias("repeat"), F.lower("family").alias("family"), F.lower("family").contains("satellite").alias("is_satellite"))


def tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, {0: ("chrom", "string"), 1: ("start", "long"), 2: ("end", "long")}, 3).select("chrom", (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"))


def segmental_duplications(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, {1: ("chrom", "string"), 2: ("start", "long"), 3: ("end", "long")}, 4, sep="\t", header=True, enforceSchema=True)


def chromosomes(column: Column) -> Column:
    return column.rlike("^chr([0-9]{1,2}|X|Y)$")


def fai(spark: SparkSession, path: str) -> DataFrame:
    d = _csv(spark, path, {0: ("chrom", "string"), 1: ("length", "long")}, 5, sep="\t")
    return d.where(chromosomes(F.col("chrom")))


def genome_length(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, {0: ("chrom", "string"), 1: ("length", "long")}, 5, sep="\t").agg(F.sum("length").alias("length"))


def short_arms(spark: SparkSession, path: str) -> DataFrame:
    """chrom, p: the end of the short arm, from cytobands."""
    d = _csv(spark, path, {0: ("chrom", "string"), 1: ("start", "long"), 2: ("end", "long"), 3: ("band", "string")}, 5, sep="\t")
    return d.where(F.col("band").startswith("p")).groupBy("chrom").agg(F.max("end").alias("p"))


def insertions(spark: SparkSession, path: str, quantum: int = 50) -> DataFrame:
    """seq_id in order of length, sequence, and its length bin."""
    d = spark.read.text(path).where("value <> ''").select(F.col("value").alias("seq")).distinct()
    bins = d.withColumn("bin", F.floor(F.length("seq") / quantum))
    before = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    i = F.row_number().over(Window.partitionBy("bin").orderBy(F.length("seq"), "seq")) - 1
    return bins.withColumn("i", i).join(before, "bin").select((F.col("before") + F.col("i")).alias("seq_id"), "seq", "bin")


def _named(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Columns by name, whatever their case and order."""
    d = spark.read.csv(path, sep=sep, header=True)
    by = {c.strip().lower(): c for c in d.columns}
    if missing := [n for n in names if n not in by]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return d.select(*[F.col(f"`{by[n]}`").alias(n) for n in names])


def trios(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.variants import birth_year

    d = _named(spark, path, ["family_id", "research_id", "date_of_birth", "sex_at_birth"])
    return d.select("family_id", "research_id", F.col("sex_at_birth").alias("sex"), birth_year(F.col("date_of_birth")).alias("birth_year"))


def samples(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    d = _named(spark, path, ["research_id", "hifi_fq"])
    return d.join(known.select("research_id").distinct(), "research_id", "left_semi") if known is not None else d


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header, tabs, gzip or not; NA and empty fields stay as they are written."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="\0", emptyValue="").na.fill("")


def hmm_model(spark: SparkSession, path: str) -> DataFrame:
    """accuracy, kind (IP, EP or TP), state, place, p from lines 'acc kind state p0 p1 ...'."""
    p = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).where("value <> ''").select(p[0].cast("int").alias("accuracy"), p[1].alias("kind"), p[2].cast("int").alias("state"), F.posexplode(F.slice(p, F.lit(4), F.size(p))).alias("place", "p"))
    return d.withColumn("p", F.col("p").cast("double"))


def model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``sinks.write_model`` wrote."""
    names = ("types", "lengths", "frequencies", "positions", "segments")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: Statistics of a text model: number of dimensions, and of the columns before the values.
TEXT_MODEL = {"types": (1, 0), "contexts": (2, 0), "lengths": (3, 0), "frequencies": (2, 2), "positions": (2, 0)}


def text_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The statistics of a model in text files: i, j, k as far as there are dimensions, value, and low and high where bounds come before the values. A file whose lines do not fit its dimensions is an error when it is read."""
    out = {}
    for name, (n, lead) in TEXT_MODEL.items():
        lines = numbered_lines(spark, f"{path}/{name}.txt").where("line <> ''")
        dims = F.transform(F.split("line", ","), lambda x: x.cast("long"))
        head = lines.where("no = 0").select(dims.alias("dims"), F.aggregate(F.slice(dims, 1, n - 1), F.lit(1).cast("long"), lambda a, x: a * x).alias("rows"))
        p = F.split("line", ",")
        d = lines.where("no > 0").join(F.broadcast(head))  # one row
        values = F.slice(p, lead + 1, F.greatest(F.size(p) - lead, F.lit(0)))
        good = (F.size("dims") == n) & (F.col("no") <= F.col("rows")) & (F.size(values) == F.element_at("dims", -1))
        row = F.when(good, F.col("no") - 1).otherwise(F.raise_error(F.concat(F.lit(f"{name}: line does not fit the dimensions: "), F.substring("line", 1, 80))).cast("long"))
        d = d.select(row.alias("row"), "dims", *[p[i].cast("double").alias(c) for i, c in enumerate(("low", "high")[:lead])], F.posexplode(values).alias("at", "value"))
        last = F.col("at").cast("long")
        at = {1: [last], 2: [F.col("row"), last], 3: [F.floor(F.col("row") / F.col("dims")[1]), F.col("row") % F.col("dims")[1], last]}[n]
        out[name] = d.select(*[c.alias(k) for k, c in zip("ijk", at)], *("low", "high")[:lead], F.col("value").cast("double").alias("value"))
    return out


def graph_segments(spark: SparkSession, path: str) -> DataFrame:
    """S lines of an assembly graph: name, sequence."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").startswith("S\t")).select(p[1].alias("name"), p[2].alias("sequence"))


def finished(spark: SparkSession, packages: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Work packages without a result yet: resume by what exists."""
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # nothing written so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return packages
    return packages.join(done, keys, "left_anti")


def numbered_lines(spark: SparkSession, path: str, size: int = records.RANGE) -> DataFrame:
    """Line number (0-based) and text of one file, read by ranges, for importers of line-counted formats."""
    return records.numbered(spark, path, size).select("no", "line")


def carriers(spark: SparkSession, path: str) -> DataFrame:
    """haplotype_id, variant_id from lines 'last,v0,v1,...' after a line with their number."""
    d = numbered_lines(spark, path).where("no > 0 and line <> ''")
    p = F.split("line", ",")
    return d.select((F.col("no") - 1).alias("haplotype_id"), F.explode(F.slice(p, F.lit(2), F.greatest(p[0].cast("int") + 1, F.lit(0))).cast("array<bigint>")).alias("variant_id"))


#: The ten lines of a serialised variant, in order.
VARIANT_LINES = ("sv_type", "length", "af", "position", "ctx", "ctx_start", "ctx_end", "surface", "is_active", "sequence")


def population(spark: SparkSession, path: str) -> DataFrame:
    """Variants of ten lines each after a line with their number."""
    d = numbered_lines(spark, path).where("no > 0").select(F.floor((F.col("no") - 1) / 10).alias("variant_id"), ((F.col("no") - 1) % 10).alias("k"), "line")
    cols = [F.max(F.when(F.col("k") == i, F.col("line"))).alias(n) for i, n in enumerate(VARIANT_LINES)]
    return d.groupBy("variant_id").agg(*cols).where("length is not null")


def intervals_text(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """type, start, end (or start, end) lines after a line with their number."""
    p = F.split("line", ",")
    names = ("type", "start", "end") if typed else ("start", "end")
    return numbered_lines(spark, path).where("no > 0 and line <> ''").select(*[p[i].cast("long").alias(n) for i, n in enumerate(names)])
