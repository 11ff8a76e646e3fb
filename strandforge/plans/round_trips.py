"""Readers and writers as queries: a view is written in its text format to the shared folder, whole, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import formats, sinks
from .catalog import query


def _lines(df: DataFrame, *fields: Column | str, sep: str = "\t") -> str:
    """The path of a text with one line a row."""
    path = scratch(df.sparkSession, "lines")
    df.select(F.concat_ws(sep, *[F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields])).write.text(path)
    return path


def _table(df: DataFrame, sep: str = "\t", **options) -> str:
    """The path of a table with a line of column names."""
    path = scratch(df.sparkSession, "table")
    df.write.csv(path, sep=sep, header=True, **options)
    return path


c = F.col


@query("dna", "SELECT concat('s',CAST(seq_id AS VARCHAR)) AS name, seq AS sequence FROM dna WHERE seq NOT LIKE '%NNNNN%'")
def src1_src16_src18_snk8_fasta(dna):
    """SRC1, SRC16, SRC18, SNK8: FASTA; runs of five N are not written."""
    path = scratch(dna.sparkSession, "fasta")
    sinks.write_fasta(dna.select(F.concat(F.lit("s"), c("seq_id")).alias("name"), c("seq").alias("sequence")), path)
    return formats.fasta(dna.sparkSession, path, least=1)


@query("dna", "SELECT concat('@r',CAST(seq_id AS VARCHAR)) AS header, seq AS sequence, translate(seq,'ACGTN','IJKL!') AS quality FROM dna")
def src2_snk9_fastq(dna):
    """SRC2, SNK9: FASTQ."""
    path = scratch(dna.sparkSession, "fastq")
    sinks.write_fastq(dna.select(F.concat(F.lit("@r"), c("seq_id")).alias("header"), c("seq").alias("sequence"), F.translate("seq", "ACGTN", "IJKL!").alias("quality")), path)
    return formats.fastq(dna.sparkSession, path).drop("file")


@query("vcf_lines", "WITH p AS (SELECT string_split(line, chr(9)) AS f FROM vcf_lines) SELECT f[1] AS chrom, CAST(f[2] AS BIGINT) AS pos, f[3] AS id, f[4] AS ref, f[5] AS alt, f[6] AS qual, f[7] AS filter, f[8] AS info, '0|1' AS sample FROM p")
def src3_src4_vcf(vcf_lines):
    """SRC3, SRC4: VCF of several files named in a file of paths, header lines skipped."""
    spark = vcf_lines.sparkSession
    head = spark.createDataFrame([(x,) for x in sinks.vcf_header("S").split("\n")], "line string")
    # The paths go to a file of paths, as a list of inputs comes.
    paths = [_lines(head.unionByName(part), c("line")) for part in (vcf_lines.where("length(line) % 2 = 0").withColumn("line", F.concat("line", F.lit("\tGT\t0|1"))), vcf_lines.where("length(line) % 2 = 1").withColumn("line", F.concat("line", F.lit("\tGT\t0|1"))))]
    named = _lines(spark.createDataFrame([(x,) for x in paths], "path string"), c("path"))
    return formats.vcf(spark, formats.listed(spark, named)).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", F.get("samples", F.lit(0)).alias("sample"))


@query("repeats", """SELECT chrom, rstart AS start, rend AS "end", CASE WHEN rstart%3=0 THEN rstart%500+1 ELSE rstart%7 END AS rep_start, rstart%500+rend-rstart AS rep_end, rstart%3=0 AS fwd,
 concat('alu_',CAST(rstart%5 AS VARCHAR)) AS repeat, CASE WHEN is_sat=1 THEN 'satellite/centr' ELSE 'sine' END AS family, is_sat=1 AS is_satellite FROM repeats""")
def src5_repeat_masker(repeats):
    """SRC5: repeat annotations, consensus by strand, names in lower case."""
    fwd, at, left = c("rstart") % 3 == 0, c("rstart") % 500 + 1, F.concat(F.lit("("), c("rstart") % 11, F.lit(")"))
    path = _lines(
        repeats, "9", "1.0", "0", "0", c("chrom"), c("rstart") + 1, c("rend") + 1, "(7)", F.when(fwd, "+").otherwise("C"), F.concat(F.lit("Alu_"), c("rstart") % 5), F.when(c("is_sat") == 1, "Satellite/centr").otherwise("SINE"),
        F.when(fwd, at.cast("string")).otherwise(left), c("rstart") % 500 + c("rend") - c("rstart"), F.when(fwd, left).otherwise((c("rstart") % 7).cast("string")), sep=",",
    )
    return formats.repeat_masker(repeats.sparkSession, path)


@query("repeats", 'SELECT chrom, rstart AS start, rend AS "end" FROM repeats')
def src6_tandem_repeats(repeats):
    return formats.tandem_repeats(repeats.sparkSession, _lines(repeats, c("chrom"), c("rstart") + 1, c("rend") + 1, sep=","))


@query("segdups", "SELECT chrom, sstart AS start, send AS \"end\" FROM segdups")
def src7_segmental_duplications(segdups):
    path = _table(segdups.select(F.lit(585).alias("bin"), "chrom", c("sstart").alias("chromStart"), c("send").alias("chromEnd")))
    return formats.segmental_duplications(segdups.sparkSession, path).toDF("chrom", "start", "end")


@query("repeats", "WITH l AS (SELECT chrom, max(rend) AS length FROM repeats GROUP BY 1) SELECT chrom, length, (SELECT CAST(sum(length) AS BIGINT)*2 FROM l) AS genome FROM l")
def src8_src22_lengths(repeats):
    """SRC8, SRC22: chromosome lengths of an index, others ignored, and the length of all."""
    spark = repeats.sparkSession
    n = repeats.groupBy("chrom").agg(F.max("rend").alias("n"))
    path = _lines(n.unionByName(n.withColumn("chrom", F.concat("chrom", F.lit("_alt")))), c("chrom"), c("n"), "6", "60", "61")
    return formats.fai(spark, path).join(F.broadcast(formats.genome_length(spark, path).toDF("genome")))


@query("segdups", "SELECT chrom, max(send) AS p FROM segdups WHERE sstart%2=0 GROUP BY 1")
def src9_short_arms(segdups):
    """SRC9: the end of the short arm by bands."""
    path = _lines(segdups, c("chrom"), c("sstart"), c("send"), F.when(c("sstart") % 2 == 0, "p1").otherwise("q1"), "gneg")
    return formats.short_arms(segdups.sparkSession, path)


@query("dna", "WITH s AS (SELECT DISTINCT substr(seq, 1, CAST(seq_id%8+1 AS INTEGER)) AS seq FROM dna) SELECT row_number() OVER (ORDER BY length(seq), seq)-1 AS seq_id, seq, CAST(floor(length(seq)/2.0) AS BIGINT) AS bin FROM s")
def src10_insertions(dna):
    """SRC10: insertions numbered by length."""
    return formats.insertions(dna.sparkSession, _lines(dna, c("seq").substr(F.lit(1), (c("seq_id") % 8 + 1).cast("int"))), 2)


_PEOPLE = "SELECT CAST(family_id AS VARCHAR) AS family_id, research_id, sex, CASE WHEN birth_year%3=0 THEN 1800 ELSE birth_year END AS birth_year FROM individuals"


def _people(individuals: DataFrame) -> DataFrame:
    date = F.when(c("birth_year") % 3 == 0, "unknown").otherwise(F.concat(c("birth_year").cast("string"), F.lit("-01-31")))
    return formats.trios(individuals.sparkSession, _table(individuals.select(c("research_id").alias("Research_ID"), "family_id", date.alias("Date_Of_Birth"), c("sex").alias("sex_at_birth"))))


@query("individuals", _PEOPLE)
def src11_trios(individuals):
    """SRC11: columns by name, whatever their case and order."""
    return _people(individuals).withColumn("birth_year", c("birth_year").cast("long"))


@query("individuals fastqs", f"WITH t AS ({_PEOPLE}) SELECT * FROM fastqs WHERE research_id IN (SELECT research_id FROM t WHERE birth_year>1950)")
def src12_samples(individuals, fastqs):
    """SRC12: samples of known people."""
    return formats.samples(fastqs.sparkSession, _table(fastqs.select(c("hifi_fq").alias("HIFI_FQ"), "research_id")), _people(individuals).where("birth_year > 1950"))


@query("variants", """
WITH t AS (SELECT 'types' AS part, count(*) AS n FROM variants GROUP BY svtype UNION ALL SELECT 'lengths', count(*) FROM variants GROUP BY svtype, floor((len-50)/50.0) UNION ALL SELECT 'frequencies', count(*) FROM variants GROUP BY svtype, af
 UNION ALL SELECT 'positions', count(*) FROM variants GROUP BY svtype, floor(pos/100000) UNION ALL SELECT 'segments', count(*) FROM variants WHERE chrom='chr1' GROUP BY floor(pos/1000))
SELECT part, count(*) AS rows, CAST(sum(n*n) AS BIGINT) AS squares FROM t GROUP BY 1""")
def src13_snk6_model(variants):
    """SRC13, SNK6: a model written and read, its intervals of chr1 alone as the format has it."""
    spark = variants.sparkSession
    n = lambda d, *keys: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bins = {"types": [], "lengths": [F.floor((c("len") - 50) / 50).alias("bin")], "frequencies": ["af"], "positions": [F.floor(c("pos") / 100_000).alias("bin")]}
    tables = {k: n(variants, "svtype", *b) for k, b in bins.items()} | {"segments": n(variants.where("chrom = 'chr1'"), F.floor(c("pos") / 1000).alias("bin"))}
    path = scratch(spark, "model")
    sinks.write_model(tables, path)
    every = [d.agg(F.count(F.lit(1)).alias("rows"), F.sum(c("n") * c("n")).alias("squares")).withColumn("part", F.lit(k)) for k, d in formats.model(spark, path).items()]
    out = every[0]
    for d in every[1:]:
        out = out.unionByName(d)
    return out


@query("genotypes variants", "SELECT g.haplotype_id, v.svtype, count(*) AS n, CAST(sum(v.len) AS BIGINT) AS bases FROM genotypes g JOIN variants v ON g.variant_id=v.variant_id%977 GROUP BY 1,2")
def src14_snk7_population(genotypes, variants):
    """SRC14, SNK7: a population written and read: variants and bases of each carrier."""
    spark, path = variants.sparkSession, scratch(variants.sparkSession, "population")
    sinks.write_population(genotypes, variants, path)
    v = spark.read.parquet(f"{path}/variants").select("variant_id", "svtype", "len", (c("variant_id") % 977).alias("k"))
    return spark.read.parquet(f"{path}/carriers").withColumnRenamed("variant_id", "k").join(v, "k").groupBy("haplotype_id", "svtype").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query("variants", "SELECT chrom, CAST(pos AS VARCHAR) AS pos, CASE WHEN len%3=0 THEN 'NA' ELSE svtype END AS kind, CASE WHEN len%5=0 THEN '' ELSE filter END AS note FROM variants")
def src15_bed(variants):
    """SRC15: compressed BED with a header; NA and empty fields stay as written."""
    d = variants.select("chrom", c("pos").cast("string").alias("pos"), F.when(c("len") % 3 == 0, "NA").otherwise(c("svtype")).alias("kind"), F.when(c("len") % 5 == 0, "").otherwise(c("filter")).alias("note"))
    return formats.bed(variants.sparkSession, _table(d, compression="gzip", emptyValue=""))


@query("dna", "SELECT CAST(80+seq_id%20 AS INTEGER) AS accuracy, CASE seq_id%3 WHEN 0 THEN 'IP' WHEN 1 THEN 'EP' ELSE 'TP' END AS kind, CAST(seq_id AS INTEGER) AS state, CAST(i AS INTEGER) AS place, (seq_id%4+1)/4.0::DOUBLE/(i+1)::DOUBLE AS p FROM dna, unnest(range(0,3)) r(i) WHERE i<2")
def src19_state_model(dna):
    """SRC19: probabilities of a model with states, one a row."""
    p = (c("seq_id") % 4 + 1) / 4
    return formats.hmm_model(dna.sparkSession, _lines(dna, 80 + c("seq_id") % 20, F.element_at(F.array(*map(F.lit, ("IP", "EP", "TP"))), (c("seq_id") % 3 + 1).cast("int")), c("seq_id"), p, p / 2, sep=" "))


@query("truth", "SELECT CAST(variant_id%4 AS INTEGER) AS individual, concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), svtype) AS value FROM truth")
def snk2_individuals(truth):
    """SNK2: one folder per individual."""
    path = scratch(truth.sparkSession, "individuals")
    sinks.write_individuals(truth.select((c("variant_id") % 4).alias("individual"), "pos", F.concat_ws("\t", "chrom", c("pos").cast("string"), "svtype").alias("line")), path)
    return truth.sparkSession.read.text(path)


@query("truth", "SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), svtype) AS value FROM truth")
def snk3_sorted_records(truth):
    """SNK3: records in order, the header beside them."""
    path = scratch(truth.sparkSession, "vcf")
    sinks.write_vcf(truth.select("chrom", "pos", F.concat_ws("\t", "chrom", c("pos").cast("string"), "svtype").alias("line")), path)
    return truth.sparkSession.read.text(f"{path}/records")


@query("reads", "SELECT CAST(floor(len/500) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1")
def snk10_snk17_histogram(reads):
    """SNK10, SNK17: a histogram as CSV."""
    path = scratch(reads.sparkSession, "histogram")
    sinks.write_histogram(reads.groupBy(F.floor(c("len") / 500).alias("bin")).agg(F.count(F.lit(1)).alias("n")), path)
    return reads.sparkSession.read.schema("bin long, n long").csv(path)


@query("calls", "SELECT caller, svtype, count(*)+CASE WHEN caller='pbsv' THEN 1 ELSE 0 END AS n FROM calls GROUP BY 1,2")
def snk12_overwritten_matrix(calls):
    """SNK12: a matrix of which one caller's rows are written again, the others staying."""
    spark, path = calls.sparkSession, scratch(calls.sparkSession, "matrix")
    n = calls.groupBy("caller", "svtype").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_matrix(n, path, ["caller"])
    sinks.write_matrix(n.where("caller = 'pbsv'").withColumn("n", c("n") + 1), path, ["caller"])
    return spark.read.parquet(path)


@query("vcf_lines", "WITH p AS (SELECT string_split(line, chr(9)) AS f FROM vcf_lines) SELECT concat_ws(chr(9), f[1], f[2], f[3], f[4], f[5], f[6], f[7], f[8], 'GT', '.') AS value FROM p")
def snk13_plain_vcf(vcf_lines):
    """SNK13: other sample columns go."""
    return sinks.plain_vcf(vcf_lines.select(F.concat("line", F.lit("\tGT:DP\t0|1:9\t1|1:4")).alias("value")))


@query("calls", "SELECT DISTINCT caller, svtype FROM calls WHERE svtype<>'DEL'")
def work_left(calls):
    """Resume by what exists: work packages without a result."""
    path = scratch(calls.sparkSession, "results")
    packages = calls.select("caller", "svtype").distinct()
    calls.where("svtype = 'DEL'").groupBy("caller", "svtype").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return formats.finished(calls.sparkSession, packages, path, ["caller", "svtype"])
