"""Queries that have no SQL, on the smallest tables, against plain versions of what they say."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.operators import call_files, sampling, statistics
from strandforge.plans import catalog, studies
from strandforge.sources import formats, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lengths():
    return dict(duckdb.sql(f"SELECT doc_id, n_chars FROM '{SF}/documents.parquet'").fetchall())


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_shuffles_are_permutations(spark, lengths):
    got = run(spark, "ord3_shuffled")
    by = {}
    for x in got:
        by.setdefault(x.bin, []).append((x.rank, x.read_id))
    assert {i for v in by.values() for _, i in v} == set(lengths) and all(sorted(r for r, _ in v) == list(range(1, len(v) + 1)) for v in by.values())
    assert all(min(lengths[i] // 500, 69) == b for b, v in by.items() for _, i in v)
    largest = max(by.values(), key=len)
    assert [i for _, i in sorted(largest)] != sorted(i for _, i in largest)


def test_ranges_of_a_shuffle_grow_with_the_rows(spark):
    d = spark.range(3000).select(F.col("id").alias("read_id"), F.lit(0).alias("bin"))
    assert sorted(x.rank for x in sampling.shuffled(d, ["bin"], "read_id", 1).collect()) == list(range(1, 3001))


@pytest.mark.parametrize("keys", [[5] * 40, [0, 10**15, 3, 10**15 + 1, 7], list(range(999, -1, -1)), []])
def test_ordinals_of_any_keys(spark, keys):
    d = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    got = sampling.ordinals(d, "k").collect()
    assert [x.k for x in sorted(got, key=lambda x: x.ordinal)] == sorted(keys) and sorted(x.ordinal for x in got) == list(range(len(keys)))


def test_contigs_go_to_the_least_loaded_bin(spark):
    sums = duckdb.sql(f"SELECT source, sum(n_chars) FROM '{SF}/documents.parquet' GROUP BY 1").fetchall()
    loads, want = [0] * 8, {}
    for source, bp in sorted(sums, key=lambda x: (-x[1], x[0])):
        k = loads.index(min(loads))
        loads[k] += bp
        want[source] = k
    assert {x.flowcell: x.bin for x in run(spark, "ord8_contig_packing")} == want


def test_normal_mass(spark, lengths):
    n = np.array(list(lengths.values()), float)
    cdf = lambda x: 0.5 * (1 + math.erf((x - n.mean()) / (n.std() * math.sqrt(2))))
    got = {x.bin: x.p for x in run(spark, "fn15_normal_mass")}
    assert sorted(got) == list(range(70)) and all(abs(p - (cdf(500 * b + 500) - cdf(500 * b))) < 1e-9 for b, p in got.items())


def drawn_in_turn(got, lengths, target):
    cum = 0
    for x in sorted(got, key=lambda x: x.draw):
        assert cum < target and x.len == lengths[x.read_id] and x.bin == min(x.len // 500, 69)
        cum += x.len
        assert x.cum == cum
    assert cum >= target and len({x.read_id for x in got}) == len({x.draw for x in got}) == len(got)


def test_reads_until_the_target(spark, lengths):
    drawn_in_turn(run(spark, "sim7_bimodal_reads"), lengths, 300_000)


def test_draws_grow_until_the_target_and_say_when_it_is_missed(spark):
    reads = spark.createDataFrame([(i, 100 + 1000 * (i % 2)) for i in range(60)], "read_id long, len long")
    cdf = spark.createDataFrame([(0, 0.1), (1, 0.1), (2, 1.0)], "bin long, cum double")
    few = sampling.bimodal_reads(reads, cdf, 4, 20_000).collect()
    assert sum(x.len for x in few) >= 20_000 and sorted(x.draw for x in few) == sorted(x.draw for x in sampling.bimodal_reads(reads, cdf, 400, 20_000).collect())
    with pytest.raises(ValueError, match="36000 of 40000 bases"):
        sampling.bimodal_reads(reads, cdf, 4, 40_000)
    rare = spark.createDataFrame([(0, 1e-9), (2, 1.0)], "bin long, cum double")
    with pytest.raises(ValueError, match="draws took"):
        sampling.bimodal_reads(reads, rare, 4, 35_000)


def test_left_mode_is_capped_by_its_mirror(spark, lengths):
    bins = Counter(min(n // 500, 69) for n in lengths.values())
    got = Counter(x.bin for x in run(spark, "sim9_without_left_mode"))
    assert got == {b: n if b >= 20 else min(n, bins[40 - b]) for b, n in bins.items() if b >= 20 or bins[40 - b]}


def two_modes(spark):
    rows = [(i, int(3000 + 40 * (i % 25))) for i in range(600)] + [(1000 + i, int(15_000 + 40 * (i % 25))) for i in range(600)] + [(5000 + i, 500 * i + 1) for i in range(60)]
    return spark.createDataFrame(rows, "read_id long, len long"), dict(rows)


def test_mixture_of_modes(spark):
    reads, lengths = two_modes(spark)
    share = []
    for weight in (0.0, 0.5, 1.0):
        got = studies.read_length_study(reads, left_weight=weight, target=400_000).collect()
        drawn_in_turn(got, lengths, 400_000)
        share.append(sum(x.len < 9000 for x in got) / len(got))
    assert share[0] < share[1] < share[2]


def test_read_length_study_needs_two_modes(spark):
    with pytest.raises(ValueError, match="two modes"):
        studies.read_length_study(spark.createDataFrame([(1, 5000)], "read_id long, len long"))


def test_registered_study(spark, lengths):
    drawn_in_turn(run(spark, "sim20_one_mode"), lengths, 50_000)


def test_text_model_says_what_does_not_fit(spark, tmp_path):
    values = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "i long, j long, value double")
    bounds = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.2, 0.8)], "i long, low double, high double")
    three = spark.createDataFrame([(1, 0, 1, 7.0)], "i long, j long, k long, value double")
    one = spark.createDataFrame([(1, 3.0)], "i long, value double")
    sinks.write_text_model({"types": (one, (2,), None), "contexts": (values, (2, 3), None), "lengths": (three, (2, 1, 2), None), "frequencies": (values, (2, 3), bounds), "positions": (values, (2, 3), None)}, str(tmp_path), spark)
    assert (tmp_path / "frequencies.txt").read_text() == "2,3\n0.1,0.9,0.0,0.5,0.0\n0.2,0.8,0.0,0.0,0.25\n"
    got = formats.text_model(spark, str(tmp_path))
    assert [tuple(x) for x in got["lengths"].where("value > 0").collect()] == [(1, 0, 1, 7.0)] and got["lengths"].count() == 4
    assert sorted(tuple(x) for x in got["frequencies"].where("value > 0").collect()) == [(0, 1, 0.1, 0.9, 0.5), (1, 2, 0.2, 0.8, 0.25)]
    assert [tuple(x) for x in got["types"].sort("i").collect()] == [(0, 0.0), (1, 3.0)]
    (tmp_path / "contexts.txt").write_text("2,3\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="does not fit"):
        formats.text_model(spark, str(tmp_path))["contexts"].collect()


def test_profile_and_levels(spark):
    reads = spark.createDataFrame([("AC", "II"), ("ACGT", "!!!!"), ("A", "+")], "sequence string, quality string")
    p = statistics.read_profile(reads).first()
    assert (p.n, p.total, p.shortest, p.longest) == (3, 7, 1, 4) and abs(p.accuracy - (0.9999 + 0.0 + 0.9) / 3) < 1e-9 and p.accuracy_min == 0.0
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "i long, len long")
    got = sampling.prefix_levels(rows, [F.col("i")], "len", 12.5, 9).sort("level").collect()
    assert [(x.n, x.bp) for x in got] == [(n, 10 * n) for n in (2, 3, 4, 5, 7, 8, 9, 10, 10)]


def test_allele_length_records(spark):
    lines = ["c\t9\t.\tA\tACCCC\t1\tq\tX=1\tGT\t1/1\tmore", "c\t9\t.\tACCCCC\tA\t1\t.\t.\tGT\t0/1", "c\t9\t.\tA\tACCC\t1\t.\t.\tGT\t0/1", "c\t9\t.\tAC\tACCCCCC\t1\t.\t.\tGT\t0/1"]
    d = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [x[0] for x in d.select(sinks.allele_length_record(F.col("line"), 4)).collect()]
    assert got == ["c\t9\t.\tA\tACCCC\t1\tPASS\tSVTYPE=INS;SVLEN=4;END=10;X=1\tGT\t1/1", "c\t9\t.\tACCCCC\tA\t1\tPASS\tSVTYPE=DEL;SVLEN=-5;END=14;.\tGT\t0/1", None, None]


def test_facets_add_up(spark):
    got = catalog.queries()["ana2_set6_facets"](spark, SF).collect()
    whole = {x.callset: x for x in got if x.facet == "all"}
    assert set(whole) == {"pbsv", "sniffles2", "merged", "joint"} and len({x.callset for x in got if x.facet == "frequency" and x.frequency is None}) == 4
    for f in studies.FACETS:
        for k, t in whole.items():
            part = [x for x in got if x.callset == k and x.facet == f]
            assert all(x[o] is None for x in part for o in studies.FACETS if o != f)
            assert [sum(x[m] for x in part) for m in ("tp", "fp", "fn")] == [t.tp, t.fp, t.fn]


def test_split_is_written_by_size_and_type(spark, tmp_path):
    rows = [("sv", "del", "chr2", 5, 900, 1, "ACG"), ("sv", "del", "chr1", 7, 900, 2, "A"), ("indel", "ins", "chr1", 1, 60, 3, "TT")]
    sinks.write_split(spark.createDataFrame(rows, "size string, svtype string, chrom string, pos long, end long, id long, seq string"), str(tmp_path))
    text = lambda kind, where: "".join(p.read_text() for p in sorted((tmp_path / kind).glob(f"{where}/part-*")))
    assert text("fasta", "size=indel/svtype=ins") == ">3\nTT\n" and "ACG" not in text("bed", "size=sv/svtype=del") and "chr1\t7\t900\t2\n" in text("bed", "size=sv/svtype=del")


def test_a_share_is_of_merged_islands(spark):
    spans = spark.createDataFrame([(1, "chr1", 0, 99), (2, "chr1", 200, 210)], "variant_id long, chrom string, first long, last long")
    islands = spark.createDataFrame([("chr1", 10, 19), ("chr1", 50, 4999)], "chrom string, s long, e long")
    assert sorted(tuple(x) for x in call_files.covered_share(spans, islands, "variant_id").collect()) == [(1, 60), (2, 11)]
