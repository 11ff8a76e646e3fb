"""The driver's tables as variants, repeats, reads and families: one portable SELECT each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "variants": """SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey AS variant_id, concat('chr',CAST(l_suppkey%22+1 AS STRING)) AS chrom,
 (l_partkey*3701+l_orderkey*911+l_linenumber*131)%2000000 AS pos,
 CASE l_linenumber%4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INS' ELSE 'INV' END AS svtype,
 50+CAST(floor(l_extendedprice) AS BIGINT)%5000 AS len,
 CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'MULTIALLELIC' ELSE 'LOWQUAL' END AS filter,
 CASE WHEN l_linestatus='F' THEN 'SR' WHEN l_orderkey%2=0 THEN 'PE' ELSE 'RD' END AS evidence,
 CAST(l_orderkey%1000 AS DOUBLE)/1000 AS af FROM lineitem""",
    "repeats": """SELECT concat('chr',CAST(o_custkey%22+1 AS STRING)) AS chrom,(o_orderkey*6143)%2000000 AS rstart,
 (o_orderkey*6143)%2000000+20+CAST(floor(o_totalprice) AS BIGINT)%900 AS rend,
 CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS is_sat FROM orders""",
    "segdups": """SELECT concat('chr',CAST(c_nationkey%22+1 AS STRING)) AS chrom,(c_custkey*13007)%2000000 AS sstart,
 (c_custkey*13007)%2000000+1000+CAST(floor(abs(c_acctbal)) AS BIGINT)%4000 AS send FROM customer""",
    "reads": "SELECT doc_id AS read_id, source AS flowcell, n_chars AS len FROM documents",
    "individuals": """SELECT CAST(floor(c_custkey/4.0) AS BIGINT) AS family_id, concat('P',CAST(c_custkey AS STRING)) AS research_id,
 CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'Female' WHEN c_mktsegment IN ('AUTOMOBILE','FURNITURE') THEN 'Male' ELSE 'Other' END AS sex,
 1940+CAST(floor(abs(c_acctbal)) AS BIGINT)%70 AS birth_year FROM customer""",
    "fastqs": "SELECT concat('P',CAST(o_custkey AS STRING)) AS research_id, concat('fq_',CAST(o_orderkey AS STRING)) AS hifi_fq FROM orders WHERE o_orderkey%2=0",
    "genotypes": "SELECT DISTINCT (l_orderkey*7+l_partkey*3+l_suppkey)%64 AS haplotype_id, l_partkey%500 AS variant_id FROM lineitem",
    "truth": "SELECT * FROM variants WHERE filter='PASS'",
    "calls": """SELECT -variant_id AS call_id,chrom,pos+variant_id%300 AS pos,svtype,len+variant_id%40 AS len,
 CASE variant_id%3 WHEN 1 THEN 'pbsv' ELSE 'sniffles2' END AS caller FROM variants WHERE filter='PASS' AND variant_id%3<>0""",
    "vcf_lines": """SELECT concat_ws(chr(9),chrom,CAST(pos AS STRING),concat('sv_',CAST(variant_id AS STRING)),'N',concat('<',svtype,'>'),'999',filter,
 concat('END=',CAST(pos+len AS STRING),';SVTYPE=',svtype,CASE WHEN svtype='DEL' THEN concat(';SVLEN=-',CAST(len AS STRING)) WHEN svtype='INS' THEN concat(';SVLEN=',CAST(len AS STRING)) ELSE '' END,';AF=',CAST(af AS STRING))) AS line FROM variants""",
    "dna": "SELECT part.p_partkey AS seq_id, concat(" + ",".join(f"substr('ACGTN',CAST((p_partkey*{a}+p_size*{b}+{k})%5+1 AS INT),1)" for k, (a, b) in enumerate(((7, 3), (3, 1), (11, 2), (13, 4), (1, 1), (2, 3), (17, 1), (9, 7)))) + ") AS seq FROM part",
}
_TABLES = {"variants": "lineitem", "repeats": "orders", "segdups": "customer", "reads": "documents", "individuals": "customer", "fastqs": "orders", "genotypes": "lineitem", "dna": "part"}
_OVER = {"truth": ("variants",), "calls": ("variants",), "vcf_lines": ("variants",)}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*_OVER.get(n, ()), n):
            if x not in out:
                out.append(x)
    return out


def with_views(*names: str) -> str:
    """'v AS (...), w AS (...)' for a WITH clause, with what they depend on first."""
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in _order(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. Parquet files are named in the query itself, so no session state is left behind."""
    sql = VIEWS[name]
    for n in reversed(_order((name,))[:-1]):
        sql = f"WITH {n} AS ({VIEWS[n]}) {sql}"
    table = _TABLES[_order((name,))[0]]
    df = spark.sql(sql.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet` AS {table}"))
    # A few small files are a few tasks' work; with as many files, or ranges of large ones, as cores nothing is dealt out anew.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df
