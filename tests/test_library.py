"""Readers, functions and operators on small hand-made cases."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandforge.functions import variants as fn
from strandforge.operators import annotations, families, intervals, matching, reads, reference, sampling, statistics
from strandforge.sources import formats, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("end,islands", [(26, 2), (25, 1), (24, 1)])
def test_merge_by_overlap(spark, end, islands):
    df = spark.createDataFrame([("chr1", 0, 50), ("chr1", end, 90), ("chr2", 10, 20)], "chrom string, s long, e long")
    assert intervals.merge(df, ["chrom"], "s", "e", -25).where("chrom = 'chr1'").count() == islands


@pytest.mark.parametrize("start,islands", [(75, 1), (76, 2)])
def test_merge_by_gap_and_tiles(spark, start, islands):
    df = spark.createDataFrame([("chr1", 0, 50), ("chr1", 5, 7), ("chr1", start, 90)], "chrom string, s long, e long")
    for tile in (None, 8, 64):
        assert intervals.merge(df, ["chrom"], "s", "e", 25, tile=tile).count() == islands


def test_context_by_tolerance(spark):
    points = spark.createDataFrame([(1, 125, "SR"), (2, 126, "SR"), (3, 350, "PE"), (4, 351, "PE"), (5, 1100, "RD"), (6, 1101, "RD"), (7, 9000, "SR"), (8, 9026, "SR"), (9, 20000, "SR")], "variant_id long, pos long, evidence string").withColumn("chrom", F.lit("chr1"))
    points = points.withColumn("tol", intervals.tolerance(F.col("evidence")))
    repeats = spark.createDataFrame([("chr1", 50, 100, 0), ("chr1", 20010, 20011, 0), ("chr1", 20000, 20005, 1), ("chr2", 0, 10**6, 0)], "chrom string, rstart long, rend long, is_sat int")
    segdups = spark.createDataFrame([("chr1", 5000, 9000)], "chrom string, sstart long, send long")
    got = dict(rows(intervals.annotate(points, repeats, segdups)))
    assert got == {1: 0, 2: 4, 3: 0, 4: 4, 5: 0, 6: 4, 7: 3, 8: 4, 9: 2}


def test_range_join_levels(spark):
    import random

    r = random.Random(0)
    a = [(i, s, s + r.choice([0, 10, 10**5])) for i in range(150) for s in [r.randrange(10**6)]]
    b = [(i, s, s + r.choice([1, 5000, 3 * 10**5, 5 * 10**6])) for i in range(150) for s in [r.randrange(10**6)]]
    left = spark.createDataFrame(a, "i long, a long, b long").withColumn("k", F.lit(1))
    right = spark.createDataFrame(b, "j long, c long, d long").withColumn("k", F.lit(1))
    assert rows(intervals.range_join(left, right, ["k"], ("a", "b"), ("c", "d")), "i", "j") == sorted((x[0], y[0]) for x in a for y in b if y[1] <= x[2] and y[2] >= x[1])


def test_info_fields(spark):
    df = spark.createDataFrame([("CIEND=-1,2;END=7",), ("END=9;CIPOS=-3,4",), ("STD_quant_start=2.5",), ("X=1",)], "info string")
    lo, hi = fn.confidence(F.col("info"))
    got = df.select(fn.info_field(F.col("info"), "END"), lo, hi).collect()
    assert [tuple(x) for x in got] == [("7", 0, 0), ("9", -3, 4), (None, -8, 8), (None, 0, 0)]


def test_types_and_sequences(spark):
    df = spark.createDataFrame([("del", "<X>", "AcgtN-"), (None, "<DUP:TANDEM>", "aaT"), ("odd", "T", "")], "t string, alt string, s string")
    got = df.select(fn.sv_type(F.col("t"), F.col("alt")), fn.reverse_complement(F.col("s")), fn.reverse_complement_any(F.col("s"))).collect()
    assert [tuple(x) for x in got] == [("DEL", "NNacgT", "-NacgT"), ("DUP", "Att", "Att"), (None, "", "")]


def test_record_formats(spark):
    df = spark.createDataFrame([("chr1", 10, i, t, 5) for i, t in enumerate(("DEL", "INS", "DUP", "INV"))], "chrom string, pos long, variant_id long, svtype string, len long")
    info = [r[0].split("\t")[7] for r in df.orderBy("variant_id").select(sinks.vcf_record(F.lit("A"), F.lit("C"), F.lit("GG"), F.lit("T"))).collect()]
    assert info == ["END=15;SVLEN=-5;SVTYPE=DEL", "END=11;SVLEN=5;SVTYPE=INS", "END=15;SVTYPE=DUP", "END=15;SVTYPE=INV"]


def test_genotypes(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (1, 3)], "haplotype_id long, variant_id long")
    assert rows(matching.genotypes(df), "variant_id", "gt") == [(1, "1|0"), (2, "0|1"), (3, "1|1")]


def test_families(spark):
    def family(f, years, sexes):
        return [(f, f"{f}{i}", s, y) for i, (y, s) in enumerate(zip(years, sexes))]

    people = family("a", [1950, 1955], "MF") + family("b", [1950, 1951, 1980], "MMF") + family("c", [1950, 1952, 1963], "MFF") + family("d", [1950, 1952, 1964], "MFM")
    sex = {"M": "Male", "F": "Female"}
    df = spark.createDataFrame([(f, i, sex.get(s, "Other"), y) for f, i, s, y in people], "family_id string, research_id string, sex string, birth_year int")
    assert rows(families.children(df)) == [("d2", "d0", "d1")]


def test_coverage_stops_at_target(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "read_id long, len long")
    assert rows(sampling.take_until(df, [F.col("read_id")], "len", 20), "read_id") == [(1,), (2,)]


def test_ordinals(spark):
    df = spark.createDataFrame([(i * 37,) for i in range(200)], "k long")
    assert rows(sampling.ordinals(df, "k"), "k", "ordinal") == [(i * 37, i) for i in range(200)]


def test_independent_set_and_haplotype(spark):
    h = spark.createDataFrame([(0, 1, 10, 20), (0, 2, 22, 30), (0, 3, 33, 40), (0, 4, 90, 95), (1, 1, 10, 20)], "haplotype_id long, variant_id long, first long, last long")
    assert rows(sampling.without_collisions(h)) == [(0, 1), (0, 3), (0, 4), (1, 1)]
    v = spark.createDataFrame([(0, 1, "DEL", 2, 2, None), (0, 2, "DUP", 5, 1, None), (0, 3, "INS", 7, 3, "TTT"), (0, 4, "INV", 8, 2, None)], "haplotype_id long, variant_id long, svtype string, pos long, len long, sequence string")
    assert rows(sampling.apply_variants("ACGTACGTAC", v)) == [(0, "AC" + "A" + "CC" + "G" + "TTT" + "T" + "GT")]


def test_smoothing_and_modes(spark):
    h = spark.createDataFrame([(b, n) for b, n in enumerate([1, 9, 1, 5, 2, 8, 3])], "bin long, n long")
    assert [r[0] for r in statistics.maxima(h, 1000, 5).collect()] == [5, 3]
    assert statistics.first_minimum(h).first()[0] == 2
    assert [r.smoothed for r in statistics.smooth_int(h, []).orderBy("bin").collect()] == [1, 3, 5, 2, 5, 4, 3]


def test_annotation_folds(spark):
    r = [("chr1", 0, 100, 0, 100, True, False, "a", "f"), ("chr1", 120, 200, 110, 190, True, False, "a", "f"), ("chr1", 230, 300, 195, 250, True, False, "a", "f")]
    df = spark.createDataFrame(r, annotations._OUT)
    assert rows(annotations.compact(df), "start", "end", "rep_end") == [(0, 200, 190), (230, 300, 250)]
    # Satellites need no consensus that goes on; the next one has to start near the end in absolute terms; the end is the last member's.
    s = [("chr1", 0, 100, 0, 100, True, True, "a", "f"), ("chr1", 90, 95, 500, 600, True, True, "a", "f"), ("chr1", 97, 200, 0, 9, True, True, "a", "f"), ("chr1", 150, 300, 0, 9, True, True, "a", "f")]
    assert rows(annotations.compact(spark.createDataFrame(s, annotations._OUT)), "start", "end", "rep_end", "is_sat") == [(0, 200, 600, True), (150, 300, 9, True)]
    back = [("chr1", 0, 100, 200, 300, False, False, "a", "f"), ("chr1", 110, 200, 100, 190, False, False, "a", "f")]
    assert rows(annotations.compact(spark.createDataFrame(back, annotations._OUT)), "start", "end", "rep_start") == [(0, 200, 100)]
    t = spark.createDataFrame([("chr1", 190, 250), ("chr1", 400, 410)], "chrom string, start long, end long")
    assert rows(annotations.with_tandem(df, t), "start", "end", "repeat", "rep_start", "is_sat") == [(0, 100, "a", 0, False), (120, 300, "artificial", -1, True), (400, 410, "artificial", -1, True)]
    # An overlap of ten bases is not enough by one: the start has to be at or before end - 10.
    near = spark.createDataFrame([("chr1", 91, 120), ("chr1", 191, 192)], "chrom string, start long, end long")
    assert rows(annotations.with_tandem(df.limit(2), near), "start", "end", "repeat") == [(0, 100, "a"), (91, 120, "artificial"), (120, 200, "a"), (191, 192, "artificial")]


def slow_compact(rs, reach=25):
    out = []
    for r in sorted(rs, key=lambda r: (r[1], r[2], r[7], r[8], r[5], r[3], r[4], r[6])):
        p = out[-1] if out else None
        if p and p[7:] == list(r[7:]) and p[5] == r[5] and abs(r[1] - p[2]) <= reach and (r[6] or abs(r[3] - p[4] if r[5] else r[4] - p[3]) <= reach):
            p[2], p[3], p[4] = r[2], min(p[3], r[3]), max(p[4], r[4])
        else:
            out.append(list(r))
    return sorted(map(tuple, out))


def slow_tandem(rs, ts, overlap=10):
    merged = []
    for a, b in sorted(ts):
        if merged and a <= merged[-1][1] - overlap:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    every = [tuple(r) for r in rs] + [("c", a, b, -1, -1, True, True, "artificial", "") for a, b in merged]
    out = []
    for r in sorted(every, key=lambda r: (r[1], r[2], r[7], r[8], r[5], r[3], r[4], r[6])):
        p = out[-1] if out else None
        if p and "artificial" in (p[7], r[7]) and r[1] <= p[2] - overlap:
            p[6] |= r[6]
            if r[2] > p[2]:
                p[2], p[3], p[4] = r[2], -1, -1
                if p[7] != "artificial" and r[7] == "artificial":
                    p[5], p[7], p[8] = True, "artificial", ""
        else:
            out.append(list(r))
    return sorted(map(tuple, out))


def test_annotation_folds_by_brute_force(spark, monkeypatch):
    import random

    for module in (annotations, intervals):
        monkeypatch.setattr(module, "TILE", 64)
    r = random.Random(3)
    rs = []
    for _ in range(300):
        a, c = r.randrange(2000), r.randrange(60)
        rs.append(("c", a, a + r.randrange(60), c, c + r.randrange(40), r.random() < 0.6, r.random() < 0.4, r.choice("ab"), "f"))
    rs += rs[:20]
    ts = [(a, a + r.randrange(80)) for a in (r.randrange(2000) for _ in range(60))]
    df = spark.createDataFrame(rs, annotations._OUT)
    assert sorted(map(tuple, annotations.compact(df).collect())) == slow_compact(rs)
    t = spark.createDataFrame([("c", *x) for x in ts], "chrom string, start long, end long")
    assert sorted(map(tuple, annotations.with_tandem(df, t).collect())) == slow_tandem(rs, ts)


def test_one_chromosome_by_tiles_is_the_plain_window(spark):
    import random

    r = random.Random(5)
    spans = [(a, a + r.randrange(1, 90)) for a in (r.randrange(5000) for _ in range(400))]
    spans += spans[:30]
    df = spark.createDataFrame([("c", a, b, k % 2) for k, (a, b) in enumerate(spans)], "chrom string, s long, e long, kind int")
    for slack in (-25, 0, 25):
        cut = [x for x in intervals.merge(df.drop("kind"), ["chrom"], "s", "e", slack, tile=256).collect()]
        assert sorted(cut) == sorted(intervals.merge(df.drop("kind"), ["chrom"], "s", "e", slack, tile=None).collect())
    got = {x.from_pos: x for x in intervals.sweep(df, ["chrom"], "s", "e", "kind", [0, 1], tile=256).collect()}
    edges = sorted({a for a, _ in spans} | {b + 1 for _, b in spans})
    for a, b in zip(edges, edges[1:]):
        assert got[a].to_pos == b - 1 and [got[a].n_0, got[a].n_1] == [sum(k % 2 == j and x <= a <= y for k, (x, y) in enumerate(spans)) for j in (0, 1)]
    m = intervals.merge(df, ["chrom"], "s", "e", 0, tile=256)
    gaps = intervals.complement(m.select("chrom", "s", "e"), spark.createDataFrame([("c", 6000)], "chrom string, length long"), "chrom", "s", "e", tile=256)
    free = sorted(set(range(6000)).difference(*[range(a, b + 1) for a, b in spans]))
    assert sorted(p for x in gaps.collect() for p in range(x.from_pos, x.to_pos + 1)) == free
    reads = spark.createDataFrame([(k, r.randrange(100)) for k in range(500)], "read_id long, len long")
    for target in (0, 1, 999, 10**9):
        plain = sampling.take_until(reads, [F.col("read_id")], "len", target)
        assert rows(sampling.take_until(reads, [F.col("read_id")], "len", target, bucket=F.floor(F.col("read_id") / 64))) == rows(plain)


def test_insertions_of_just_that_length_come_first(spark):
    bank = spark.createDataFrame([(1, "A" * 11), (2, "C" * 13), (3, "C" * 13), (4, "G" * 17), (5, "T" * 45)], "seq_id long, seq string")
    want = spark.createDataFrame([(k * 100 + n, n) for n in (11, 13, 14, 19, 25, 70) for k in range(1, 40)], "variant_id long, len long")
    got = {}
    for x in sampling.insertion_choice(want, bank, 10).collect():
        got.setdefault(x.variant_id % 100, set()).add((x.seq_id, x.len))
    assert got == {11: {(1, 11)}, 13: {(2, 13), (3, 13)}, 14: {(4, 14)}, 19: {(1, 11), (2, 13), (3, 13), (4, 17)}, 25: {(5, 25)}, 70: {(5, 45)}}


def test_lengths_types_and_absent_sequences(spark):
    from pyspark.errors import SparkRuntimeException

    got = spark.createDataFrame([("INS", 10, None, 7), ("INS", 10, 20, 7), ("DEL", 10, None, -7), ("DEL", 10, 20, None), ("DUP", 10, None, None)], "t string, pos long, e long, n long")
    last, length = fn.end_and_length(F.col("t"), F.col("pos"), F.col("e"), F.col("n"))
    assert [tuple(x) for x in got.select(last, length).collect()] == [(10, None), (19, None), (16, 7), (19, 10), (None, None)]
    assert spark.createDataFrame([("DEL/INV", "N")], "a string, b string").select(fn.sv_type(F.col("a"), F.col("b"))).first()[0] == "DEL_INV"
    t = spark.createDataFrame([(1, "AC")], "seq_id long, seq string")
    assert rows(matching.lookup(t.select("seq_id"), t, "seq_id", "seq"), "seq") == [("AC",)]
    with pytest.raises(SparkRuntimeException):
        matching.lookup(spark.createDataFrame([(2,)], "seq_id long"), t, "seq_id", "seq").collect()


def test_records_and_headers(spark):
    v = spark.createDataFrame([("chr1", 10, 1, "DEL", 3), ("chr1", 10, 2, "INS", 2), ("chr1", 10, 3, "INV", 4)], "chrom string, pos long, variant_id long, svtype string, len long")
    got = [x[0] for x in v.orderBy("variant_id").select(sinks.vcf_record(F.lit("A"), F.lit("C"), F.lit("AGG"), F.lit("TT"), [("AF", F.lit(0.5)), ("NONE", F.lit(None))])).collect()]
    assert got == ["chr1\t10\t1\tCAGG\tC\t.\tPASS\tEND=13;SVLEN=-3;SVTYPE=DEL;AF=0.5", "chr1\t11\t2\tA\tATT\t.\tPASS\tEND=11;SVLEN=2;SVTYPE=INS;AF=0.5", "chr1\t11\t3\tA\t<INV>\t.\tPASS\tEND=14;SVTYPE=INV;AF=0.5"]
    assert spark.range(1).select(sinks.add_info(F.lit(got[0] + "\tGT\t0|1"), [("K", F.lit(4)), ("X", F.lit(None))])).first()[0] == got[0] + ";K=4\tGT\t0|1"
    h = sinks.vcf_header("S", {"chr1": 99}).split("\n")
    assert h[1] == "##contig=<ID=chr1,length=99>" and h[-1].endswith("INFO\tFORMAT\tS") and sum(x.startswith("##ALT=") for x in h) == 4
    more = sinks.with_filters("\n".join(h), ["PASS", "LowQual"]).split("\n")
    assert len(more) == len(h) + 1 and more[-2].startswith("##FILTER=<ID=LowQual,") and more[-1] == h[-1]


def test_unknown_letters_are_in_no_class(spark):
    chunks = spark.createDataFrame([("c", 0, "ACNNgtn"), ("c", 7, "acgt"), ("c", 11, "NNA")], "chrom string, offset long, seq string")
    u = intervals.unknown_runs(chunks)
    assert rows(u, "ustart", "uend") == [(2, 3), (6, 6), (11, 12)]
    r = spark.createDataFrame([], "chrom string, rstart long, rend long, is_sat int")
    s = spark.createDataFrame([], "chrom string, sstart long, send long")
    got = intervals.context_partition(r, s, spark.createDataFrame([("c", 14)], "chrom string, length long"), unknown=u)
    assert rows(got, "from_pos", "to_pos", "ctx") == [(0, 1, 4), (4, 5, 4), (7, 10, 4), (13, 13, 4)]


def test_population_is_written_whole(spark, tmp_path):
    c = spark.createDataFrame([(1, 5), (0, 7), (0, 5)], "haplotype_id long, variant_id long")
    v = spark.createDataFrame([(7, "DEL"), (5, "INS")], "variant_id long, svtype string")
    sinks.write_population(c, v, f"{tmp_path}/p")
    assert rows(spark.read.parquet(f"{tmp_path}/p/carriers")) == [(0, 5), (0, 7), (1, 5)] and rows(spark.read.parquet(f"{tmp_path}/p/variants")) == [(5, "INS"), (7, "DEL")]


def test_reads(spark):
    h = spark.createDataFrame([(0, "ACGT" * 500)], "haplotype_id long, sequence string")
    p = reads.ReadParameters(depth=2, length_mean=200, length_sd=50, length_min=100, length_max=400, error_free=True)
    got = reads.simulate(h, p).collect()
    assert len(got) == 20 and all(x.forward is False or "ACGT" * 500 == ("ACGT" * 500)[: x.start] + x.sequence + ("ACGT" * 500)[x.start + len(x.sequence) :] for x in got)
    noisy = reads.simulate(h, reads.ReadParameters(depth=2, length_mean=200, length_sd=50, length_min=100, length_max=400))
    assert rows(noisy) == rows(noisy) and all(len(x.sequence) == len(x.quality) for x in noisy.collect())


def test_reads_of_all_sequences(spark):
    from strandforge.plans import catalog_more

    dna = spark.range(3500).select(F.col("id").alias("seq_id"), F.lit("ACGTACGT").alias("seq"))
    got = catalog_more.sim10_to_16_reads(dna).select("haplotype_id", "contig", "read_id", "place").collect()
    # 4000 bases of a haplotype in each of three contigs, 2000 in the fourth; depth 5, mean 300.
    assert {(h, c): sum(x.haplotype_id == h and x.contig == c for x in got) for h in (0, 1) for c in range(4)} == {(h, c): 34 if c == 3 else 67 for h in (0, 1) for c in range(4)}
    assert sorted(x.place for x in got) == list(range(1, len(got) + 1))
    whole = catalog_more.sim12_template_reads(dna)
    assert whole.count() == whole.select("name").distinct().count() == 3500


def test_profile_counts_all_rows(spark):
    h = spark.createDataFrame([(0, 0, "ACGT" * 20000), (1, 0, "ACGT" * 10)], "haplotype_id long, contig long, sequence string")
    # 150,000 short rows, 50,000 long ones: shares of 3/4 and 1/4, mean length 125.
    profile = spark.range(200_000).select(F.when(F.col("id") % 4 < 3, 100).otherwise(200).alias("length"), (F.lit(0.9) + F.col("id") % 4 / 100 + F.floor(F.col("id") / 4) / 1e9).alias("accuracy"))
    p = reads.ReadParameters(depth=10, error_free=True)
    one = reads.simulate(h, p, block=100, profile=profile)
    got = [len(x.sequence) for x in one.where("haplotype_id = 0").collect()]
    assert len(got) == 6400 and set(got) == {100, 200} and abs(got.count(200) / 6400 - 0.25) < 0.03
    assert [len(x.sequence) for x in one.where("haplotype_id = 1").collect()] == [40] * 4
    # Every pair is reachable, by its share.
    slots = spark.range(80_000).withColumnRenamed("id", "i")
    few = spark.createDataFrame([(5, 0.5)] * 6 + [(900, 0.5), (900, 0.6)], "length long, accuracy double")
    share = {(x.length, x.accuracy): x["count"] / 80_000 for x in reads.drawn(slots, few, 3).groupBy("length", "accuracy").count().collect()}
    assert sum(share.values()) == 1 and all(abs(share[k] - v) < 0.01 for k, v in {(5, 0.5): 0.75, (900, 0.5): 0.125, (900, 0.6): 0.125}.items())


def _edited(ref, variants):
    """By positions from the last one back; variants of one haplotype do not overlap."""
    back = str.maketrans("ACGT", "TGCA")
    for pos, n, kind, seq in sorted(variants, reverse=True):
        part = ref[pos : pos + n]
        new = {"DEL": "", "DUP": part * 2, "INS": seq + part, "INV": part[::-1].translate(back)}[kind]
        ref = ref[:pos] + new + ref[pos + n :]
    return ref


def test_variants_of_all_contigs(spark):
    from strandforge.plans import catalog_more

    n = 150  # contigs of 60, 60 and 30
    dna = spark.range(n).select(F.col("id").alias("seq_id"), F.concat(F.lit("GATTACA"), F.col("id").cast("string")).alias("seq"))
    want = []
    for c in range(3):
        ref = ("ACGTTGCA"[c:] + "ACGTTGCA"[:c]) * 200
        for h in range(4):
            mine = [i for i in range(n) if i // 60 == c and i % 4 == h]
            want.append((c, h, _edited(ref, [(i % 60 * 15 + 15, 7, ("DEL", "DUP", "INS", "INV")[(i % 4 + i // 4 % 4) % 4], f"GATTACA{i}") for i in mine])))
    assert rows(catalog_more.sim6_apply_variants(dna), "contig", "haplotype_id", "sequence") == want


def test_contig_without_variants_is_the_reference(spark):
    contigs = spark.createDataFrame([(0, "ACGTACGT"), (1, "TTTTGGGG")], "contig long, reference string")
    v = spark.createDataFrame([(0, 0, 1, "DEL", 2, 2, None), (1, 1, 2, "DUP", 4, 1, None)], "contig long, haplotype_id long, variant_id long, svtype string, pos long, len long, sequence string")
    assert rows(sampling.apply_variants(contigs, v)) == [(0, 0, "ACACGT"), (0, 1, "ACGTACGT"), (1, 0, "TTTTGGGG"), (1, 1, "TTTTGGGGG")]


def _random_variants(n):
    import random

    r = random.Random(7)
    return [(i, r.choice(["chr1", "chr3", "chr7"]), r.randrange(6000), r.choice(["DEL", "DUP", "INS", "INV"]), r.randrange(50, 600)) for i in range(n)]


_VARIANTS = "variant_id long, chrom string, pos long, svtype string, len long"


def test_fractions_of_every_variant(spark):
    from strandforge.plans import catalog_more

    v = _random_variants(120)
    rep = [(c, s, s + 10 + s % 90, 0) for c in ("chr1", "chr3") for s in range(0, 6000, 137)] + [("chr1", 40, 2000, 1)]
    want = []
    for i, chrom, pos, kind, n in v:
        here = set() if kind == "INS" else {x for c, a, b, _ in rep if c == chrom for x in range(max(a, pos), min(b, pos + n - 1) + 1)}
        want.append((i, kind, len(here), round(len(here) / n, 4)))
    got = catalog_more.agg17_to_19_repeat_fraction(spark.createDataFrame(v, _VARIANTS), spark.createDataFrame(rep, "chrom string, rstart long, rend long, is_sat int"))
    assert rows(got, "variant_id", "svtype", "covered", "fraction") == want


def test_collisions_of_every_chromosome(spark):
    from strandforge.plans import catalog

    v = _random_variants(200)
    h = [(c, i % 16, i, p, p if k == "INS" else p + n - 1) for i, c, p, k, n in v]
    want = sorted((c, x, i, j) for c, x, i, f, e in h for d, y, j, g, _ in h if (c, x) == (d, y) and (f, i) < (g, j) and g <= e + 5)
    got = catalog.jn15_collisions(spark.createDataFrame(v, _VARIANTS))
    assert len({x[0] for x in want}) == 3 and rows(got, "chrom", "haplotype_id", "a", "b") == want


def test_versions_of_every_id(spark):
    from strandforge.plans import catalog_more

    v = _random_variants(300)
    seen, want = {}, []
    for i, chrom, pos, kind, _ in sorted(v, key=lambda x: (x[2], x[0])):
        k = seen[chrom, kind] = seen.get((chrom, kind), 0) + 1
        want.append((chrom, pos, kind if k == 1 else f"{kind}.{k}"))
    assert rows(catalog_more.win12_versioned_ids(spark.createDataFrame(v, _VARIANTS)), "chrom", "pos", "id") == sorted(want)


def test_readers(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(p)

    seq = "ACGT" * 30
    assert rows(formats.fasta(spark, put("a.fa", f">s1 x\n{seq[:50]}\n{seq[50:]}\n>s2\nAC\n"))) == [("s1", seq)]
    assert rows(reference.chunks(spark.createDataFrame([("s", "ACGTAC"), ("e", ""), ("n", None)], "name string, sequence string"), 4, 1)) == [("s", 0, "ACGTA"), ("s", 1, "AC")]
    assert rows(formats.fastq(spark, [put("a.fastq", "@r1\nACG\n+\nIII\n"), put("b.fastq.gz", "@r2\nAC\n+\nII\n@r3\nA\n+\nI\n")]), "header", "sequence", "quality") == [("@r1", "ACG", "III"), ("@r2", "AC", "II"), ("@r3", "A", "I")]
    v = formats.named_vcf(spark, put("pbsv_i12_l10000_c8.vcf", "##x\n#CHROM\nchr1\t5\ta\tN\t<DEL>\t.\tPASS\tEND=9\tGT\t0|1\n"))
    assert rows(v, "chrom", "pos", "info", "samples", "caller", "individual", "read_length", "coverage") == [("chr1", 5, "END=9", ["0|1"], "pbsv", "12", 10000, 8)]
    rm = formats.repeat_masker(spark, put("rm.csv", "0,0,0,0,chr1,11,20,0,+,AluY,SINE,1,10,(2)\n0,0,0,0,chr1,31,40,0,C,ALR,Satellite/centr,(3),9,2\n"))
    assert rows(rm, "start", "end", "rep_start", "rep_end", "fwd", "repeat", "is_satellite") == [(10, 19, 1, 10, True, "aluy", False), (30, 39, 2, 9, False, "alr", True)]
    assert rows(formats.tandem_repeats(spark, put("trf.csv", "chr1,1,5\n"))) == [("chr1", 0, 4)]
    assert rows(formats.segmental_duplications(spark, put("sd.tsv", "bin\tc\ts\te\n1\tchr1\t3\t9\n"))) == [("chr1", 3, 9)]
    fai = put("x.fai", "chr1\t100\t0\t1\t1\nchrUn\t7\t0\t1\t1\n")
    assert rows(formats.fai(spark, fai)) == [("chr1", 100)] and formats.genome_length(spark, fai).first()[0] == 107
    assert rows(formats.short_arms(spark, put("bands", "chr1\t0\t5\tp2\tg\nchr1\t5\t9\tp1\tg\nchr1\t9\t20\tq1\tg\n"))) == [("chr1", 9)]
    assert rows(formats.insertions(spark, put("ins", "AAAA\nC\nAA\nC\n"), 2)) == [(0, "C", 0), (1, "AA", 1), (2, "AAAA", 2)]
    t = formats.trios(spark, put("t.tsv", "Research_ID\tfamily_id\tdate_of_birth\tsex_at_birth\np1\tf\t1950-01-02\tMale\np2\tf\tunknown\tFemale\n"))
    assert rows(t) == [("f", "p1", "Male", 1950), ("f", "p2", "Female", 1800)]
    assert rows(formats.samples(spark, put("s.tsv", "HIFI_FQ\tresearch_id\na\tp1\nb\tp9\n"), t)) == [("p1", "a")]
    with pytest.raises(ValueError):
        formats.samples(spark, put("bad.tsv", "x\ty\n1\t2\n"))
    assert rows(formats.bed(spark, put("b.bed.gz", "#CHROM\tID\tX\nchr1\tNA\t\n")), "ID", "X") == [("NA", "")]
    assert rows(formats.hmm_model(spark, put("m", "85 IP 1 0.5 0.5\n"))) == [(85, "IP", 1, 0, 0.5), (85, "IP", 1, 1, 0.5)]
    assert rows(formats.graph_segments(spark, put("g.gfa", "S\tu1\tACGT\tx\nL\tu1\n"))) == [("u1", "ACGT")]


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    v = spark.createDataFrame([("chr1", 10, 1, "DEL", 5, 0)], "chrom string, pos long, variant_id long, svtype string, len long, individual long").withColumn("line", sinks.vcf_record(F.lit("A"), F.lit("C"), F.lit("AGGTC"), F.lit(""), genotype=F.lit("0|1")))
    sinks.write_vcf(v, f"{d}/v")
    assert formats.vcf(spark, f"{d}/v/records").first().samples == ["0|1"] and spark.read.text(f"{d}/v/header").count() == 2 + sum(map(len, sinks.VCF_FIELDS.values()))
    sinks.write_individuals(v, f"{d}/i")
    assert spark.read.text(f"{d}/i/individual=0").count() == 1
    sinks.write_fasta(spark.createDataFrame([("a", "ACNNNNNG"), ("b", "AC")], "name string, sequence string"), f"{d}/f")
    assert rows(formats.fasta(spark, f"{d}/f", least=1)) == [("b", "AC")]
    m = spark.createDataFrame([("x", 1), ("y", 2)], "caller string, n long")
    sinks.write_matrix(m, f"{d}/m", ["caller"])
    sinks.write_matrix(m.where("caller = 'x'").withColumn("n", F.lit(9).cast("long")), f"{d}/m", ["caller"])
    assert rows(spark.read.parquet(f"{d}/m"), "caller", "n") == [("x", 9), ("y", 2)]
    assert rows(formats.finished(spark, m.select("caller").union(spark.createDataFrame([("z",)], "caller string")), f"{d}/m", ["caller"])) == [("z",)]
    assert formats.finished(spark, m, f"{d}/none", ["caller"]).count() == 2
    assert rows(sinks.plain_vcf(spark.createDataFrame([("##h",), ("c\t1\ti\tN\tA\t.\tP\tX\tGT\t1",)], "value string"))) == [("##h",), ("c\t1\ti\tN\tA\t.\tP\tX\tGT\t.",)]


def test_population_importers(spark, tmp_path):
    h = tmp_path / "h2v"
    h.write_text("2\n1,0,1\n-1\n")
    assert rows(formats.carriers(spark, str(h))) == [(0, 0), (0, 1)]
    v = tmp_path / "variants"
    v.write_text("1\n0\n55\n0.5\n10\n2\n2\n4\n0\ntrue\nACGT\n")
    assert rows(formats.population(spark, str(v)), "variant_id", "length", "af", "sequence") == [(0, "55", "0.5", "ACGT")]
    i = tmp_path / "intervals"
    i.write_text("1\n2,5,9\n")
    assert rows(formats.intervals_text(spark, str(i))) == [(2, 5, 9)]


def test_context_partition(spark):
    r = spark.createDataFrame([("c", 100, 110, 0), ("c", 130, 140, 1)], "chrom string, rstart long, rend long, is_sat int")
    s = spark.createDataFrame([("c", 300, 310)], "chrom string, sstart long, send long")
    n = spark.createDataFrame([("c", 400)], "chrom string, length long")
    got = rows(intervals.context_partition(r, s, n, pad=10), "from_pos", "to_pos", "ctx")
    assert got == [(0, 89, 4), (90, 119, 0), (120, 120, 2), (121, 150, 1), (151, 289, 4), (290, 320, 3), (321, 399, 4)]


def test_every_query_is_registered_with_its_sql():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 110 and len(s) > 90
