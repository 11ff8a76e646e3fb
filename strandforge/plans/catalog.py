"""Queries over the driver's tables, each with SQL of its own for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import variants as fn
from ..operators import call_files, families, intervals, matching, statistics
from ..sources.fixtures import view, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(views: str, sql: str | None = None):
    """Register a function of the named views; sql follows their WITH list."""

    def add(f):
        name = f.__name__
        names = views.split()
        _QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in names])
        if sql is not None:
            body = sql.strip()
            word = next((w for w in ("WITH RECURSIVE", "WITH") if body.upper().startswith(w)), "")
            _SQL[name] = f"{word or 'WITH'} {with_views(*names)}{',' * bool(word)} {body[len(word):].lstrip()}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_more, genome, profiles, round_trips  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more, genome, profiles, round_trips  # noqa: F401

    return dict(_SQL)


def spanned(variants: DataFrame) -> DataFrame:
    """first and last base of each variant; an insertion has one base."""
    return variants.withColumn("first", F.col("pos")).withColumn("last", F.when(F.col("svtype") == "INS", F.col("pos")).otherwise(F.col("pos") + F.col("len") - 1))


# --- contexts in SQL: intervals and windows meet by bins of 4096 bases ---------

_BINS = "unnest(range(CAST(floor({0}/4096.0) AS BIGINT), CAST(floor({1}/4096.0) AS BIGINT)+1)) AS b"
RB_ALONE = f"rb AS (SELECT chrom, rstart, rend, is_sat, {_BINS.format('rstart', 'rend')} FROM repeats)"
RB = f"{RB_ALONE}, sb AS (SELECT chrom, sstart, send, {_BINS.format('sstart', 'send')} FROM segdups)"


def context_sql(name: str, source: str, lo: str, hi: str, slo: str, shi: str) -> str:
    """CTEs that end in ``name`` (variant_id, ctx): the context of a window for repeats and one for duplications. Needs ``RB``."""
    n = name
    return f"""{n}w AS (SELECT DISTINCT variant_id, chrom, {lo} AS lo, {hi} AS hi, {slo} AS slo, {shi} AS shi FROM {source}),
 {n}p AS (SELECT *, {_BINS.format('lo', 'hi')} FROM {n}w), {n}q AS (SELECT *, {_BINS.format('slo', 'shi')} FROM {n}w),
 {n}r AS (SELECT variant_id, CASE WHEN min(is_sat)=max(is_sat) THEN min(is_sat) ELSE 2 END AS t FROM {n}p p JOIN rb ON p.chrom=rb.chrom AND p.b=rb.b WHERE rstart<=hi AND rend>=lo GROUP BY 1),
 {n}s AS (SELECT DISTINCT variant_id FROM {n}q q JOIN sb ON q.chrom=sb.chrom AND q.b=sb.b WHERE sstart<=shi AND send>=slo),
 {n} AS (SELECT DISTINCT w.variant_id, CAST(coalesce(t, CASE WHEN s.variant_id IS NOT NULL THEN 3 END, 4) AS INTEGER) AS ctx FROM {n}w w LEFT JOIN {n}r r ON w.variant_id=r.variant_id LEFT JOIN {n}s s ON w.variant_id=s.variant_id)"""


_ISLANDS = "im AS (SELECT *, max(rend) OVER (PARTITION BY chrom ORDER BY rstart,rend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM repeats), ig AS (SELECT *, sum(CASE WHEN pe IS NULL OR rstart>pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY rstart,rend ROWS UNBOUNDED PRECEDING) AS g FROM im), il AS (SELECT chrom, min(rstart) AS s, max(rend) AS e FROM ig GROUP BY chrom, g), ib AS (SELECT *, " + _BINS.format("s", "e") + " FROM il)"


def covered_sql(spans: str, key: str) -> str:
    """CTEs ending in cov (key, covered): bases of spans (key, chrom, first, last) under merged repeats."""
    return f"{_ISLANDS}, cs AS (SELECT *, {_BINS.format('first', 'last')} FROM {spans}), cov AS (SELECT {key}, CAST(sum(least(last,e)-greatest(first,s)+1) AS BIGINT) AS covered FROM cs JOIN ib ON cs.chrom=ib.chrom AND cs.b=ib.b WHERE s<=last AND e>=first AND cs.b=CAST(floor(greatest(first,s)/4096.0) AS BIGINT) GROUP BY 1)"


_T = "(CASE evidence WHEN 'SR' THEN 25 WHEN 'PE' THEN 250 ELSE 1000 END)"
#: First and second breakpoint; insertions have the first alone.
FIRST = context_sql("c1", "variants", f"pos-{_T}", f"pos+{_T}", "pos-25", "pos+25")
SECOND = context_sql("c2", "(SELECT variant_id, chrom, evidence, pos+len-1 AS pos FROM variants WHERE svtype<>'INS') y", f"pos-{_T}", f"pos+{_T}", "pos-25", "pos+25")


def first_context(variants: DataFrame, repeats: DataFrame, segdups: DataFrame) -> DataFrame:
    """variant_id, ctx."""
    return intervals.annotate(variants.withColumn("tol", fn_tolerance()), repeats, segdups)


def second_context(variants: DataFrame, repeats: DataFrame, segdups: DataFrame) -> DataFrame:
    """variant_id, ctx; insertions left out."""
    v = variants.where("svtype <> 'INS'").withColumn("pos", F.col("pos") + F.col("len") - 1).withColumn("tol", fn_tolerance())
    return intervals.annotate(v, repeats, segdups)


# --- joins -----------------------------------------------------------------

_TOL = "(CASE v.evidence WHEN 'SR' THEN 25 WHEN 'PE' THEN 250 ELSE 1000 END)"


@query("variants repeats segdups", f"""
WITH r AS (SELECT v.variant_id, CASE WHEN min(is_sat)=max(is_sat) THEN min(is_sat) ELSE 2 END AS t FROM (SELECT DISTINCT variant_id,chrom,pos,evidence FROM variants) v JOIN repeats r ON v.chrom=r.chrom AND r.rstart<=v.pos+{_TOL} AND r.rend>=v.pos-{_TOL} GROUP BY v.variant_id),
 s AS (SELECT DISTINCT v.variant_id FROM variants v JOIN segdups s ON v.chrom=s.chrom AND s.sstart<=v.pos+25 AND s.send>=v.pos-25)
SELECT v.variant_id, CAST(coalesce(r.t, CASE WHEN s.variant_id IS NOT NULL THEN 3 END, 4) AS INTEGER) AS ctx FROM (SELECT DISTINCT variant_id FROM variants) v LEFT JOIN r ON v.variant_id=r.variant_id LEFT JOIN s ON v.variant_id=s.variant_id""")
def jn1_annotate(variants, repeats, segdups):
    """JN1, FLT5: context of the first breakpoint under a tolerance by evidence."""
    return intervals.annotate(variants.withColumn("tol", fn_tolerance()), repeats, segdups)


def fn_tolerance():
    return intervals.tolerance(F.col("evidence"))


@query("variants repeats segdups", f"WITH {RB}, {SECOND} SELECT variant_id, ctx FROM c2")
def jn2_second_breakpoint(variants, repeats, segdups):
    """JN2: the same for the last base, insertions left out."""
    return second_context(variants, repeats, segdups)


@query("variants repeats", """
SELECT v.variant_id, CAST(CASE WHEN count(r.chrom)=0 THEN 4 WHEN min(is_sat)=max(is_sat) THEN min(is_sat) ELSE 2 END AS INTEGER) AS ctx FROM variants v LEFT JOIN repeats r ON v.chrom=r.chrom AND r.rstart<=v.pos+100 AND r.rend>=v.pos-100 GROUP BY v.variant_id""")
def jn3_fixed_tolerance(variants, repeats):
    """JN3: simulated variants, tolerance 100."""
    return intervals.annotate(variants.withColumn("tol", F.lit(100)), repeats)


_SPANS = "s AS (SELECT variant_id, chrom, pos AS first, CASE WHEN svtype='INS' THEN pos ELSE pos+len-1 END AS last FROM variants)"


@query("variants repeats segdups", f"""
WITH {_SPANS}, a AS (SELECT chrom, rstart AS a, rend AS z, is_sat AS kind FROM repeats UNION ALL SELECT chrom, sstart, send, 3 FROM segdups),
 x AS (SELECT *, unnest(range(CAST(floor(a/4096.0) AS BIGINT), CAST(floor(z/4096.0) AS BIGINT)+1)) AS b FROM a), y AS (SELECT *, unnest(range(CAST(floor(first/4096.0) AS BIGINT), CAST(floor(last/4096.0) AS BIGINT)+1)) AS b FROM s)
SELECT variant_id, kind, a, greatest(first,a) AS from_pos, least(last,z) AS to_pos, count(*) AS n FROM x JOIN y ON x.chrom=y.chrom AND x.b=y.b WHERE a<=last AND z>=first AND x.b=CAST(floor(greatest(first,a)/4096.0) AS BIGINT) GROUP BY ALL""")
def jn4_clipped_overlap(variants, repeats, segdups):
    """JN4: intersections of variants with repeats, satellites and duplications."""
    every = repeats.select("chrom", F.col("rstart").alias("a"), F.col("rend").alias("z"), F.col("is_sat").cast("int").alias("kind")).unionByName(segdups.select("chrom", F.col("sstart").alias("a"), F.col("send").alias("z"), F.lit(3).alias("kind")))
    return intervals.clipped_counts(spanned(variants), every, "chrom", "variant_id", "kind", ("first", "last"), ("a", "z"))


_CI_LO = "CASE variant_id%3 WHEN 0 THEN len%150 WHEN 1 THEN CAST(floor(((len%50)+0.5)*3+0.5) AS BIGINT) ELSE 0 END"
_CI_HI = "CASE variant_id%3 WHEN 0 THEN len%70 WHEN 1 THEN CAST(floor(((len%50)+0.5)*3+0.5) AS BIGINT) ELSE 0 END"


@query("variants repeats segdups", f"""
WITH {RB}, ci AS (SELECT variant_id, chrom, pos-greatest(10,least(100,{_CI_LO})) AS lo, pos+greatest(10,least(100,{_CI_HI})) AS hi FROM variants), {context_sql("c5", "ci", "lo", "hi", "lo", "hi")} SELECT variant_id, ctx FROM c5""")
def jn5_confidence_context(variants, repeats, segdups):
    """JN5, FN4, FN5: context in the clamped confidence window that INFO gives: a pair, a deviation, or nothing."""
    k, n = F.col("variant_id") % 3, F.col("len")
    info = F.when(k == 0, F.concat(F.lit("CIPOS=-"), (n % 150).cast("string"), F.lit(","), (n % 70).cast("string"))).when(k == 1, F.concat(F.lit("STD_quant_start="), (n % 50).cast("string"), F.lit(".5"))).otherwise("A=1")
    lo, hi = fn.clamp_window(F.col("pos"), *fn.confidence(info))
    w = variants.select("variant_id", "chrom", "pos", lo.alias("lo"), hi.alias("hi"))
    return intervals.annotate(w, repeats, segdups, lo=F.col("lo"), hi=F.col("hi"), segdup_tolerance=None)


@query("repeats segdups", """
SELECT DISTINCT s.chrom, s.sstart, s.send FROM segdups s WHERE EXISTS (SELECT 1 FROM repeats r WHERE r.chrom=s.chrom AND r.rstart<=s.send AND r.rend>=s.sstart)""")
def jn6_intersecting_segdups(repeats, segdups):
    """JN6: non-empty intersection test."""
    return intervals.range_join(segdups, repeats, ["chrom"], ("sstart", "send"), ("rstart", "rend")).select("chrom", "sstart", "send").distinct()


_TRIOS = """r AS (SELECT *,row_number() OVER (PARTITION BY family_id ORDER BY birth_year,research_id) AS rn,count(*) OVER (PARTITION BY family_id) AS n FROM individuals),
 p AS (SELECT family_id,max(CASE WHEN rn=1 THEN research_id END) AS p1,max(CASE WHEN rn=2 THEN research_id END) AS p2,max(CASE WHEN rn=1 THEN sex END) AS s1,max(CASE WHEN rn=2 THEN sex END) AS s2,max(CASE WHEN rn=2 THEN birth_year END) AS y2,max(birth_year) AS ymax FROM r WHERE n>=3 GROUP BY family_id),
 t AS (SELECT r.research_id AS child,p.p1,p.p2 FROM r JOIN p ON r.family_id=p.family_id WHERE r.rn>=3 AND p.s1<>p.s2 AND p.s1<>'Other' AND p.s2<>'Other' AND p.ymax-p.y2>=12)"""


@query("individuals", f"WITH {_TRIOS} SELECT * FROM t")
def jn7_trio_children(individuals):
    """JN7, FLT17, WIN11, SET7: parents and children of families."""
    return families.children(individuals)


_READY = "ready AS (SELECT * FROM t WHERE child IN (SELECT research_id FROM fastqs) AND p1 IN (SELECT research_id FROM fastqs) AND p2 IN (SELECT research_id FROM fastqs))"


@query("individuals fastqs", f"WITH {_TRIOS}, {_READY} SELECT * FROM ready")
def jn8_trios_with_reads(individuals, fastqs):
    """JN8: children of whom all three members have read files."""
    return families.with_reads(families.children(individuals), fastqs)


@query("individuals fastqs", f"""
WITH {_TRIOS}, {_READY}, m AS (SELECT child,'child' AS member,child AS research_id FROM ready UNION ALL SELECT child,'p1',p1 FROM ready UNION ALL SELECT child,'p2',p2 FROM ready)
SELECT child, member, m.research_id, count(hifi_fq) AS n_files, string_agg(hifi_fq, ',' ORDER BY hifi_fq) AS files FROM m JOIN fastqs f ON m.research_id=f.research_id GROUP BY 1,2,3""")
def snk11_family_reads(individuals, fastqs):
    """SNK11, SET9: the members of each family with their files."""
    files = families.read_files(families.with_reads(families.children(individuals), fastqs), fastqs)
    return files.select("child", "member", "research_id", F.size("files").cast("long").alias("n_files"), F.concat_ws(",", "files").alias("files"))


@query("genotypes", """
SELECT CAST(floor(haplotype_id/2) AS BIGINT) AS individual, variant_id, concat(CAST(max(CASE WHEN haplotype_id%2=0 THEN 1 ELSE 0 END) AS VARCHAR),'|',CAST(max(CASE WHEN haplotype_id%2=1 THEN 1 ELSE 0 END) AS VARCHAR)) AS gt FROM genotypes GROUP BY 1,2""")
def jn9_genotypes(genotypes):
    """JN9, SNK2: full-outer merge of two haplotypes."""
    return matching.genotypes(genotypes)


_PAIRS = "p AS (SELECT t.variant_id,c.call_id,c.caller,abs(t.pos-c.pos) AS d FROM truth t JOIN calls c ON t.chrom=c.chrom AND t.svtype=c.svtype AND abs(t.pos-c.pos)<=500 AND least(t.len,c.len)*10>=greatest(t.len,c.len)*7 AND t.len BETWEEN 50 AND 50000 AND c.len BETWEEN 30 AND 50000)"
def matching_sql(pairs: str, group: str, r: str = "r", b: str = "b") -> str:
    """CTEs ``r`` and ``b``: greedy matching as rounds; ``b`` has the pairs. A round takes what is first on both sides; the next one drops what that rules out."""
    return f"""{r} AS (SELECT {group}, variant_id, call_id, d, false AS m FROM {pairs} UNION ALL SELECT {group}, variant_id, call_id, d, m FROM (SELECT *, max(m) OVER (PARTITION BY {group}, call_id) AS t FROM (SELECT {group}, variant_id, call_id, d, a AND row_number() OVER (PARTITION BY {group}, call_id ORDER BY d, variant_id, a DESC)=1 AS m FROM (
 SELECT *, row_number() OVER (PARTITION BY {group}, variant_id ORDER BY d, call_id)=1 AS a FROM (SELECT *, max(m) OVER (PARTITION BY {group}, variant_id) AS t FROM {r}) WHERE NOT t))) WHERE m OR NOT t), {b} AS (SELECT {group}, variant_id, call_id, d FROM {r} WHERE m)"""


_BEST = matching_sql("p", "caller")


@query("truth calls", f"WITH {_PAIRS} SELECT caller, count(*) AS pairs, count(DISTINCT variant_id) AS tp_base, count(DISTINCT call_id) AS tp_call FROM p GROUP BY caller")
def jn10_candidates(truth, calls):
    """JN10: fuzzy candidate pairs."""
    return matching.candidates(truth, calls).groupBy("caller").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("variant_id").alias("tp_base"), F.countDistinct("call_id").alias("tp_call"))


@query("truth calls", f"WITH RECURSIVE {_PAIRS}, {_BEST} SELECT caller, variant_id, call_id, d FROM b")
def jn10_mutual_best(truth, calls):
    """JN10: one-to-one matches."""
    return matching.matched(truth, calls, ["caller"]).select("caller", "variant_id", "call_id", "d")


@query("truth calls", f"""
WITH RECURSIVE {_PAIRS}, {_BEST}, n AS (SELECT c.caller, count(*) AS c, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM b WHERE b.caller=c.caller) AS tp FROM calls c GROUP BY c.caller)
SELECT caller, tp, c-tp AS fp, t-tp AS fn, tp/c AS "precision", tp/t AS recall, 2*(tp/c)*(tp/t)/nullif(tp/c+tp/t,0) AS f1 FROM n""")
def agg10_bench(truth, calls):
    """AGG10, SRC21: scores of each caller."""
    return matching.bench(truth, calls, "caller")


@query("truth calls", f"WITH RECURSIVE {_PAIRS}, {_BEST} SELECT t.variant_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.variant_id=t.variant_id)")
def jn10_false_negatives(truth, calls):
    return matching.unmatched(truth, matching.matched(truth, calls, ["caller"]), "variant_id").select("variant_id")


@query("truth calls", f"WITH RECURSIVE {_PAIRS}, {_BEST} SELECT c.call_id, c.caller FROM calls c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.call_id=c.call_id)")
def jn10_false_positives(truth, calls):
    return matching.unmatched(calls, matching.matched(truth, calls, ["caller"]), "call_id").select("call_id", "caller")


@query("calls", f"""
WITH RECURSIVE k AS (SELECT * FROM calls WHERE abs(call_id)%4 IN (0,3)), q AS (SELECT *, abs(call_id)%4-1 AS parent FROM calls WHERE abs(call_id)%4 IN (1,2)),
 p AS (SELECT q.parent, k.call_id AS variant_id, q.call_id, abs(k.pos-q.pos) AS d FROM k JOIN q ON k.chrom=q.chrom AND k.svtype=q.svtype AND abs(k.pos-q.pos)<=500 AND least(k.len,q.len)*10>=greatest(k.len,q.len)*7 AND k.len BETWEEN 50 AND 50000 AND q.len BETWEEN 30 AND 50000),
 {matching_sql("p", "parent")} SELECT variant_id AS call_id, string_agg(DISTINCT CAST(parent AS VARCHAR), ',' ORDER BY CAST(parent AS VARCHAR)) AS parents FROM b GROUP BY 1""")
def jn11_inherited_calls(calls):
    """JN11: calls of a child with the parents that have them: one matching a parent, merged."""
    of = lambda *k: calls.where((F.abs("call_id") % 4).isin(*k))
    return matching.trio_truth(of(0, 3), of(1), of(2)).select("call_id", F.concat_ws(",", F.transform("parents", lambda x: x.cast("string"))).alias("parents"))


_ALLELES = "concat('N', CASE WHEN svtype='DEL' THEN CAST(len%3 AS VARCHAR) ELSE '' END) AS ref, CASE svtype WHEN 'DEL' THEN 'N' ELSE concat('<',svtype,'>') END AS alt"


@query("calls", f"""
WITH a AS (SELECT chrom, CAST(floor(pos/1000) AS BIGINT)*1000 AS pos, {_ALLELES}, caller FROM calls)
SELECT chrom, pos, ref, alt, string_agg(DISTINCT caller, ',' ORDER BY caller) AS samples, CAST(count(DISTINCT caller) AS INTEGER) AS n_samples FROM a GROUP BY 1,2,3,4""")
def jn12_exact_merge(calls):
    """JN12: full-outer merge on the exact allele (chromosome, position, REF, ALT), with the samples of each. Positions of the view are coarse, so that callers agree on some."""
    gone = F.col("svtype") == "DEL"
    ref = F.concat(F.lit("N"), F.when(gone, (F.col("len") % 3).cast("string")).otherwise(""))
    alt = F.when(gone, "N").otherwise(F.concat(F.lit("<"), "svtype", F.lit(">")))
    a = calls.select("chrom", (F.floor(F.col("pos") / 1000) * 1000).alias("pos"), ref.alias("ref"), alt.alias("alt"), "caller")
    return matching.exact_merge(a, ["chrom", "pos", "ref", "alt"], "caller").withColumn("samples", F.concat_ws(",", "samples"))


def greedy_sql(pairs: str, keys: str = "", fewest: bool = False) -> str:
    """CTEs r and gone: rows (a) that greedy choice by (a_n, a) leaves out, as rounds over pairs both ways. ``fewest``: a_n and b_n are the pairs left of each, counted anew in every round."""
    k = f"{keys}, " if keys else ""
    left = f"(SELECT {k}a, b, count(*) OVER (PARTITION BY {k}a) AS a_n, count(*) OVER (PARTITION BY {k}b) AS b_n FROM r WHERE NOT over)" if fewest else "r WHERE NOT over"
    return f"""r AS (SELECT {k}a, b, a_n, b_n, false AS gone, false AS over FROM {pairs} UNION ALL SELECT {k}a, b, a_n, b_n, gone, gone OR x OR y OR off FROM (SELECT *, bool_or(x) OVER (PARTITION BY {k}b) AS off FROM (
 SELECT *, (a_n, a) < min((b_n, b)) OVER (PARTITION BY {k}a) AS x, bool_or(y) OVER (PARTITION BY {k}a) AS gone FROM (SELECT {k}a, b, a_n, b_n, (b_n, b) < min((a_n, a)) OVER (PARTITION BY {k}b) AS y FROM {left})))), gone AS (SELECT DISTINCT {k}a FROM r WHERE gone)"""


@query("calls", f"""
WITH RECURSIVE c AS (SELECT call_id, chrom, pos, svtype, len, -(abs(call_id)%7) AS n FROM calls WHERE len BETWEEN 40 AND 50000),
 p AS (SELECT DISTINCT x.call_id AS a, y.call_id AS b, x.n AS a_n, y.n AS b_n FROM c x JOIN c y ON x.chrom=y.chrom AND x.svtype=y.svtype AND x.call_id<>y.call_id AND abs(x.pos-y.pos)<=500 AND least(x.len,y.len)*10>=greatest(x.len,y.len)*9),
 {greedy_sql("p")}, k AS (SELECT b, a, row_number() OVER (PARTITION BY b ORDER BY a_n, a) AS rn FROM p WHERE b IN (SELECT a FROM gone) AND a NOT IN (SELECT a FROM gone))
SELECT DISTINCT c.call_id, coalesce(k.a, c.call_id) AS kept_id FROM c LEFT JOIN k ON c.call_id=k.b AND rn=1""")
def jn13_collapse(calls):
    """JN13: near-duplicates of all callers fold into kept calls, the best supported first; a kept call is never folded."""
    return matching.collapse(calls.withColumn("support", F.abs("call_id") % 7), "support", size=0.9)


@query("variants repeats", """
SELECT a.svtype, b.is_sat, c.freq, count(*) OVER () AS grid FROM (SELECT DISTINCT svtype FROM variants) a, (SELECT DISTINCT is_sat FROM repeats) b, (VALUES (0.01), (0.1), (0.5)) c(freq)""")
def jn14_work_packages(variants, repeats):
    """JN14, SET6: the grid of filter values; all sides are parameter lists."""
    spark = variants.sparkSession
    f = spark.createDataFrame([(0.01,), (0.1,), (0.5,)], "freq double").select(F.col("freq").cast("decimal(3,2)"))
    g = variants.select("svtype").distinct().crossJoin(repeats.select("is_sat").distinct()).crossJoin(f)
    return g.withColumn("grid", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


@query("variants", f"""
WITH {_SPANS}, h AS (SELECT DISTINCT s.chrom, abs(variant_id)%16 AS haplotype_id, variant_id, first, last FROM s), x AS (SELECT *, unnest(range(CAST(floor(first/4096.0) AS BIGINT), CAST(floor((last+5)/4096.0) AS BIGINT)+1)) AS b FROM h), y AS (SELECT *, CAST(floor(first/4096.0) AS BIGINT) AS b FROM h)
SELECT x.chrom, x.haplotype_id, x.variant_id AS a, y.variant_id AS b FROM x JOIN y ON x.chrom=y.chrom AND x.haplotype_id=y.haplotype_id AND x.b=y.b AND (x.first<y.first OR (x.first=y.first AND x.variant_id<y.variant_id)) AND y.first<=x.last+5""")
def jn15_collisions(variants):
    """JN15, FN18: neighbours on one haplotype and chromosome that come within 5 bases."""
    h = spanned(variants).select("chrom", (F.abs("variant_id") % 16).alias("haplotype_id"), "variant_id", "first", "last")
    return matching.neighbours(h)


_HIST = "h AS (SELECT least(CAST(floor(len/500.0) AS BIGINT),69) AS bin, count(*) AS n FROM reads GROUP BY 1)"


@query("reads", f"WITH {_HIST} SELECT a.bin, a.n, coalesce(b.n,0) AS cap FROM h a LEFT JOIN h b ON b.bin=2*20-a.bin WHERE a.bin<=20")
def jn16_mirror(reads):
    """JN16: each bin below a mode with the count of its mirror image."""
    h = statistics.histogram(reads, [], statistics.length_bin(F.col("len"), 0, 500, 69))
    m = h.select((40 - F.col("bin")).alias("bin"), F.col("n").alias("cap"))
    return h.where("bin <= 20").join(m, "bin", "left").select("bin", "n", F.coalesce("cap", F.lit(0)).alias("cap"))


@query("dna", """
WITH r AS (SELECT seq_id, seq, CAST(seq_id%5 AS INTEGER) AS p FROM dna) SELECT seq_id, substr(seq, p+1, 3) AS piece FROM r""")
def jn17_reference_bases(dna):
    """JN17, FN10: bases of a reference by 0-based position, through chunks of four bases."""
    chunks = dna.select("seq_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.struct(k.alias("k"), F.substring(F.col("seq"), k * 4 + 1, F.lit(4)).alias("c")))).alias("x")).select("seq_id", "x.k", "x.c")
    want = dna.select("seq_id", (F.col("seq_id") % 5).cast("int").alias("p"))
    want = want.withColumn("k", F.explode(F.sequence(F.floor(F.col("p") / 4).cast("int"), F.floor((F.col("p") + 2) / 4).cast("int"))))
    got = want.join(chunks, ["seq_id", "k"]).groupBy("seq_id", "p").agg(F.min("k").alias("k0"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])).alias("s"))
    return got.select("seq_id", F.col("s").substr(F.col("p") - F.col("k0") * 4 + 1, F.lit(3)).alias("piece"))


_CDF = f"{_HIST}, c AS (SELECT bin, sum(n) OVER (ORDER BY bin)/sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY bin)-n)/sum(n) OVER () AS lo FROM h)"


@query("reads", f"WITH {_CDF}, u AS (SELECT read_id, (read_id*7919%10007)/10007.0::DOUBLE AS u FROM reads) SELECT read_id, bin FROM u JOIN c ON u>=lo AND u<hi")
def jn18_inverse_cdf(reads):
    """JN18, WIN5: draws looked up in a cumulative table, small and fixed, by binary search in an array."""
    h = statistics.histogram(reads, [], statistics.length_bin(F.col("len"), 0, 500, 69))
    table = statistics.distribution(h, []).agg(F.sort_array(F.collect_list(F.struct("cum", "bin"))).alias("cdf"))  # 70 bins
    u = reads.select("read_id", ((F.col("read_id") * 7919 % 10007) / F.lit(10007.0)).alias("u"))
    hit = F.get(F.filter("cdf", lambda x: x["cum"] > F.col("u")), F.lit(0))
    return u.join(F.broadcast(table)).select("read_id", hit["bin"].alias("bin"))


@query("variants segdups", f"""
WITH {_SPANS} SELECT DISTINCT variant_id FROM s WHERE NOT EXISTS (SELECT 1 FROM segdups b WHERE b.chrom=s.chrom AND b.sstart<=s.first AND b.send>=s.last)""")
def jn19_outside_larger(variants, segdups):
    """JN19: variants not inside a blacklisted interval."""
    s = spanned(variants).select("variant_id", "chrom", "first", "last")
    return intervals.inside(s, segdups, "chrom", ("first", "last"), ("sstart", "send")).where("not inside").select("variant_id").distinct()


@query("dna variants", """
SELECT v.variant_id, d.seq FROM (SELECT DISTINCT variant_id FROM variants) v JOIN dna d ON d.seq_id=v.variant_id%(SELECT max(seq_id) FROM dna)+1""")
def jn20_sequence_lookup(dna, variants):
    """JN20: sequences by id; an absent id is an error when the row is read."""
    n = dna.agg(F.max("seq_id").alias("m"))
    v = variants.select("variant_id").distinct().join(F.broadcast(n)).select("variant_id", (F.col("variant_id") % F.col("m") + 1).alias("seq_id"))
    return matching.lookup(v, dna, "seq_id", "seq").select("variant_id", "seq")


@query("repeats", "SELECT a.t AS a, b.t AS b, CASE WHEN a.t=b.t THEN a.t ELSE 2 END AS both FROM (VALUES (0),(1),(2)) a(t), (VALUES (0),(1),(2)) b(t)")
def jn21_add_types(repeats):
    """JN21: the union of two context types."""
    t = repeats.sparkSession.createDataFrame([(0,), (1,), (2,)], "a int")
    return t.crossJoin(t.withColumnRenamed("a", "b")).select("a", "b", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(2).alias("both"))


# --- filters and projections -------------------------------------------------


@query("variants", """
SELECT variant_id, lower(filter) AS f FROM variants WHERE upper(filter) IN ('PASS','MULTIALLELIC') AND abs(len)>=50 AND svtype IN ('DEL','DUP','INS','INV') AND chrom NOT IN ('chrX','chrY') AND regexp_matches(chrom,'^chr([0-9]{1,2}|X|Y)$')""")
def flt1_to_6_training_filter(variants):
    """FLT1-4, FLT6, FN7: variants that statistics are learned from."""
    keep = [F.upper("filter").isin("PASS", "MULTIALLELIC"), F.abs("len") >= 50, F.col("svtype").isin("DEL", "DUP", "INS", "INV"), ~F.col("chrom").isin("chrX", "chrY"), F.col("chrom").rlike("^chr([0-9]{1,2}|X|Y)$")]
    return variants.where(intervals.both(keep)).select("variant_id", F.lower("filter").alias("f"))


def package_filter(svtype: str | None = None, least: int | None = None, ctx: tuple[int, int] | None = None, only_pass: bool = True, most_af: float | None = None, fraction: tuple[float, float] | None = None) -> list:
    """FLT10, FLT11: the conjunction of a work package; most_af is for the truth side alone."""
    out = []
    if fraction is not None:
        out.append(F.col("fraction").between(*fraction))
    if svtype is not None:
        out.append(F.col("svtype") == svtype)
    if least is not None:
        out.append(F.abs("len") >= least)
    if ctx is not None:
        out.append((F.col("ctx") == ctx[0]) & (F.col("ctx_end") == ctx[1]))
    if only_pass:
        out.append(F.col("filter") == "PASS")
    if most_af is not None:
        out.append(F.col("af") <= most_af)
    return out


_FRACTION = """fr AS (WITH s AS (SELECT DISTINCT variant_id, chrom, pos AS first, pos+len-1 AS last FROM variants WHERE svtype='DEL'), y AS (SELECT *, unnest(range(CAST(floor(first/4096.0) AS BIGINT), CAST(floor(last/4096.0) AS BIGINT)+1)) AS b FROM s),
  c AS (SELECT DISTINCT variant_id, last-first+1 AS len, greatest(first,rstart) AS a, least(last,rend) AS z FROM y JOIN rb ON y.chrom=rb.chrom AND y.b=rb.b WHERE rstart<=last AND rend>=first),
  m AS (SELECT *, max(z) OVER (PARTITION BY variant_id ORDER BY a,z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM c) SELECT variant_id, sum(greatest(0,z-greatest(a,coalesce(e,-1)+1)+1))/max(len) AS fraction FROM m GROUP BY 1)"""


@query("variants repeats segdups", f"""
WITH {RB}, {FIRST}, {SECOND}, {_FRACTION}, j AS (SELECT v.*, c1.ctx AS ctx, c2.ctx AS ctx_end, coalesce(fraction,0) AS fraction FROM variants v JOIN c1 ON v.variant_id=c1.variant_id JOIN c2 ON v.variant_id=c2.variant_id LEFT JOIN fr ON v.variant_id=fr.variant_id WHERE svtype='DEL'),
 k AS (SELECT * FROM j WHERE len>=500 AND filter='PASS' AND ctx=0 AND ctx_end=0 AND fraction BETWEEN 0.1 AND 0.6)
SELECT 'truth' AS side, count(*) AS n FROM k WHERE af<=0.25 UNION ALL SELECT 'calls', count(*) FROM k""")
def flt10_work_package(variants, repeats, segdups):
    """FLT10: type, length, filter, context of both breakpoints and repeat fraction; frequency for the truth alone."""
    gone = variants.where("svtype = 'DEL'")
    s = spanned(gone).select("variant_id", "chrom", "first", "last").distinct()
    part = s.join(call_files.covered_share(s, call_files.covering(repeats), "variant_id"), "variant_id").select("variant_id", (F.col("covered") / (F.col("last") - F.col("first") + 1)).alias("fraction"))
    v = gone.join(first_context(gone, repeats, segdups), "variant_id").join(second_context(gone, repeats, segdups).withColumnRenamed("ctx", "ctx_end"), "variant_id").join(part, "variant_id", "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    sides = {"truth": 0.25, "calls": None}
    one = v.agg(*[F.count_if(intervals.both(package_filter("DEL", 500, ctx=(0, 0), fraction=(0.1, 0.6), most_af=af))).alias(side) for side, af in sides.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("n")) for x in sides])).alias("r")).select("r.*")


@query("variants", """
WITH l AS (SELECT L, lag(L,1,0) OVER (ORDER BY L) AS P FROM (VALUES (50),(500),(1000),(5000)) t(L)), x AS (SELECT CASE svtype WHEN 'DEL' THEN -len WHEN 'INS' THEN len END AS svlen FROM variants)
SELECT L AS "limit", count(CASE WHEN abs(svlen)>=L THEN 1 END) AS at_least, count(CASE WHEN abs(svlen)>P AND abs(svlen)<=L THEN 1 END) AS between_n, count(CASE WHEN abs(svlen)<=L THEN 1 END) AS at_most FROM l, x WHERE svlen IS NOT NULL AND svlen<>0 GROUP BY L""")
def flt12_length_families(variants):
    """FLT12, WIN8: three families of lengths per limit, with the limit before it. One scan for all limits."""
    limits, svlen = [50, 500, 1000, 5000], F.when(F.col("svtype") == "DEL", -F.col("len")).when(F.col("svtype") == "INS", F.col("len"))
    x = variants.select(F.abs(svlen).alias("x")).where("x > 0")
    one = x.agg(*[F.array(F.count_if(F.col("x") >= b), F.count_if((F.col("x") > a) & (F.col("x") <= b)), F.count_if(F.col("x") <= b)).alias(f"l{b}") for a, b in zip([0, *limits], limits)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("limit"), F.col(f"l{b}")[0].alias("at_least"), F.col(f"l{b}")[1].alias("between_n"), F.col(f"l{b}")[2].alias("at_most")) for b in limits])).alias("r")).select("r.*")


@query("variants", "SELECT CASE WHEN len>=500 THEN 'sv' ELSE 'indel' END AS size, count(*) AS n FROM variants WHERE NOT (svtype='SNV' OR abs(len)<60) GROUP BY 1")
def flt13_14_size_split(variants):
    """FLT13, FLT14, SNK16: drop small ones, split by length."""
    v = variants.where(~((F.col("svtype") == "SNV") | (F.abs("len") < 60)))
    return v.groupBy(F.when(F.col("len") >= 500, "sv").otherwise("indel").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("dna", """
WITH a AS (SELECT seq_id, substr(seq,1,CAST(CASE WHEN seq_id%2=0 THEN 1 ELSE 6 END AS INTEGER)) AS ref, substr(seq,1,CAST(CASE WHEN seq_id%2=0 THEN 5 ELSE 1 END AS INTEGER)) AS alt FROM dna)
SELECT seq_id, CASE WHEN length(ref)=1 AND length(alt)>=5 THEN 'INS' ELSE 'DEL' END AS svtype, abs(length(alt)-length(ref)) AS svlen FROM a WHERE (length(ref)=1 AND length(alt)>=5) OR (length(ref)>=5 AND length(alt)=1)""")
def flt15_prj1_allele_lengths(dna):
    """FLT15, PRJ1: type and length from explicit alleles."""
    even = F.col("seq_id") % 2 == 0
    a = dna.select("seq_id", F.col("seq").substr(F.lit(1), F.when(even, 1).otherwise(6)).alias("ref"), F.col("seq").substr(F.lit(1), F.when(even, 5).otherwise(1)).alias("alt"))
    r, t, m = F.length("ref"), F.length("alt"), 4
    svtype = F.when((r == 1) & (t >= m + 1), "INS").when((r >= m + 1) & (t == 1), "DEL")
    return a.select("seq_id", svtype.alias("svtype"), F.abs(t - r).cast("long").alias("svlen")).where("svtype is not null")


@query("variants", "SELECT variant_id, CASE WHEN len<300 THEN 'too short' WHEN len>4000 THEN 'too long' END AS reason, count(*) AS n FROM variants WHERE svtype='INV' GROUP BY 1,2")
def flt16_inversion_window(variants):
    """FLT16: why an inversion is dropped, null if it is kept."""
    reason = F.when(F.col("len") < 300, "too short").when(F.col("len") > 4000, "too long")
    return variants.where("svtype = 'INV'").groupBy("variant_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("reads", "SELECT read_id, string_agg(CAST(c AS VARCHAR), '-' ORDER BY c) AS left_coverages FROM (SELECT read_id, c FROM reads, (VALUES (4),(8),(12),(16)) v(c) WHERE c<read_id%20 UNION ALL SELECT read_id, read_id%20 FROM reads) x GROUP BY read_id")
def flt18_fn17_coverages(reads):
    """FLT18, FN17: listed coverages below a value, then the value."""
    return reads.select("read_id", F.concat_ws("-", F.transform(fn.coverages_below(F.lit("4-8-12-16"), F.col("read_id") % 20), lambda x: x.cast("string"))).alias("left_coverages"))


@query("variants", "SELECT variant_id, af FROM variants WHERE af>0 AND log10(af) BETWEEN -2.5 AND -1 AND len BETWEEN 100 AND 4000 AND (svtype='INS' OR pos+len<=2000000)")
def flt19_20_21_windows(variants):
    """FLT19-21: log-frequency window, length window, fits the reference."""
    return variants.where((F.col("af") > 0) & F.log10("af").between(-2.5, -1) & F.col("len").between(100, 4000) & ((F.col("svtype") == "INS") | (F.col("pos") + F.col("len") <= 2_000_000))).select("variant_id", "af")


@query("variants", "SELECT variant_id, abs(variant_id)%4 AS batch FROM variants WHERE abs(variant_id)%4=2")
def flt22_batch(variants):
    """FLT22: members of one batch."""
    return variants.select("variant_id", (F.abs("variant_id") % 4).alias("batch")).where("batch = 2")


@query("variants", "SELECT variant_id, CASE WHEN variant_id%5=0 THEN CASE svtype WHEN 'INS' THEN pos+99 ELSE pos+len-1 END WHEN svtype='INS' THEN pos WHEN variant_id%5<4 THEN pos+len-1 END AS last, CASE WHEN svtype<>'INS' AND variant_id%5<4 THEN len END AS length FROM variants")
def prj2_end_and_length(variants):
    """PRJ2: last base and length from END, else from SVLEN, else null; insertions have no length."""
    k, ins = F.col("variant_id") % 5, F.col("svtype") == "INS"
    end = F.when(k == 0, F.when(ins, F.col("pos") + 100).otherwise(F.col("pos") + F.col("len")))
    svlen = F.when(k < 4, F.when(F.col("svtype") == "DEL", -F.col("len")).otherwise(F.col("len")))
    last, length = fn.end_and_length(F.col("svtype"), F.col("pos"), end, svlen)
    return variants.select("variant_id", last.alias("last"), length.alias("length"))


@query("reads", "SELECT read_id, concat('@read', CAST(row_number() OVER (ORDER BY read_id)-1 AS VARCHAR)) AS name FROM reads")
def prj3_short_names(reads):
    """PRJ3, SNK9: short read names in id order; ordinals by sums of range buckets, no single sort."""
    from ..operators.sampling import ordinals

    return ordinals(reads, "read_id").select("read_id", F.concat(F.lit("@read"), F.col("ordinal").cast("string")).alias("name"))


@query("dna", "SELECT seq_id, concat('>s', CAST(seq_id AS VARCHAR), chr(10), seq) AS fasta FROM dna WHERE seq_id%3=0")
def prj4_graph_to_fasta(dna):
    """PRJ4: S lines of an assembly graph as FASTA."""
    lines = dna.select("seq_id", F.when(F.col("seq_id") % 3 == 0, F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), F.col("seq_id").cast("string")), "seq")).otherwise(F.concat_ws("\t", F.lit("L"), F.lit("x"))).alias("line"))
    p = F.split("line", "\t")
    return lines.where(F.col("line").startswith("S\t")).select("seq_id", F.concat(F.lit(">"), p[1], F.lit("\n"), p[2]).alias("fasta"))


@query("variants", "SELECT DISTINCT concat_ws('_','sv',svtype,CASE WHEN len>=2500 THEN 'l2500' END,CASE WHEN filter='PASS' THEN 'pass' END) AS prefix FROM variants")
def prj5_package_names(variants):
    """PRJ5: names from the parts of a work package that are set."""
    return variants.select(F.concat_ws("_", F.lit("sv"), "svtype", F.when(F.col("len") >= 2500, "l2500"), F.when(F.col("filter") == "PASS", "pass")).alias("prefix")).distinct()
