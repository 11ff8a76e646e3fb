"""Steps whose work is bounded by rows and bases, not by pairs of what lies over each other."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

import pytest

from strandforge.operators import call_files, intervals, matching, sampling


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def deep(n, seed, most=9000, span=20_000):
    """n intervals that lie deep over each other."""
    r = random.Random(seed)
    return [("chr1", a, a + r.randrange(most), r.randrange(2)) for a in (r.randrange(span) for _ in range(n))]


def shuffled(spark, job):
    """What a job gives, and the bytes that its stages shuffle."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        every = store.stageList(None, False, False, none, None).iterator()
        out = {}
        while every.hasNext():
            x = every.next()
            out[x.stageId(), x.attemptId()] = x.shuffleWriteBytes()
        return out

    before = stages()
    got = job()
    return got, sum(n for k, n in stages().items() if k not in before)


def test_letters_of_spans_are_not_shuffled(spark):
    from strandforge.operators import reference

    r = random.Random(9)
    ref = "".join(r.choice("ACGT") for _ in range(20_000))
    parts = reference.chunks(spark.createDataFrame([("chr1", ref)], "name string, sequence string"), 256, 64)
    data = [(i, "chr1", r.randrange(18_000), r.choice(["DEL", "INV"]), r.randrange(300, 1900)) for i in range(3000)]
    v = spark.createDataFrame(data, "variant_id long, chrom string, pos long, svtype string, len long")
    spelled = reference.with_letters(v, parts, size=256, halo=64).select("variant_id", F.md5(F.col("letters").cast("binary")), "anchor")
    got, n = shuffled(spark, spelled.collect)
    assert {x[0]: tuple(x[1:]) for x in got} == {i: (hashlib.md5(ref[p : p + n].encode()).hexdigest(), ref[p - 1] if p else ref[n]) for i, _, p, _, n in data}
    assert n < 600_000, n  # the spans have 3.3 million letters


def test_lines_of_files_are_not_shuffled(spark, tmp_path):
    from strandforge.sources import sinks

    df = spark.range(6000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), (6000 - F.col("id")).alias("no"))
    line = F.concat(F.col("no").cast("string"), F.lit(":"), *[F.sha2(F.concat(F.lit(k), F.col("no").cast("string")), 512) for k in "abcd"])
    told, n = shuffled(spark, lambda: rows(sinks.write_files(df, str(tmp_path / "out"), ["no"], line), "file", "n_lines", "n_bytes"))
    for file, n_lines, n_bytes in told:
        text = (tmp_path / "out" / file).read_text()
        assert len(text) == n_bytes and n_lines == 2000
        assert [int(x.split(":")[0]) for x in text.splitlines()] == sorted(6000 - i for i in range(6000) if i % 3 == int(file[1]))
    assert len(told) == 3 and n < 300_000, n  # of 3 MB


def test_pieces_are_bounded_by_bases(spark):
    data = deep(600, 1) + [("chr1", 3, 64 * 4096 * 2, 0), ("chr2", -5000, -4000, 1), ("chr2", 9, 8, 1)]
    df = spark.createDataFrame(data, "chrom string, s long, e long, k int")
    got = rows(intervals.pieces(df, ["chrom"], "s", "e"), "chrom", "s", "e", "_bin")
    assert len(got) == 129 + 2  # bins that are covered whole, and one interval over two bins
    assert {(c, x) for c, a, z, _ in got for x in range(a, z + 1)} == {(c, x) for c, a, z, _ in data for x in range(a, z + 1)}
    assert all(a // 4096 == z // 4096 == b for _, a, z, b in got)


def test_annotate_over_deep_intervals(spark):
    r = random.Random(2)
    repeats = deep(40, 3, 300, 60_000) + [("chr2", 10_000, 10_100, 1)]
    segdups = [(c, a, z) for c, a, z, _ in deep(12, 4, 3000, 60_000)]
    points = [(i, "chr1", r.randrange(70_000), r.choice([25, 250, 1000])) for i in range(300)] + [(900, "chr2", 10_050, 25), (901, None, 5, 25), (902, "chr1", None, 25)]
    want = []
    for i, c, p, tol in points:
        kinds = {k for x, a, z, k in repeats if x == c and p is not None and a <= p + tol and z >= p - tol}
        near = any(x == c and p is not None and a <= p + 25 and z >= p - 25 for x, a, z in segdups)
        want.append((i, (min(kinds) if len(kinds) == 1 else 2) if kinds else 3 if near else 4))
    df = lambda d, s: spark.createDataFrame(d, s)
    got = intervals.annotate(df(points, "variant_id long, chrom string, pos long, tol int"), df(repeats, "chrom string, rstart long, rend long, is_sat int"), df(segdups, "chrom string, sstart long, send long"))
    assert rows(got) == want
    # What points meet are pieces: as many copies of the repeats as may be are one.
    many = df(repeats * 50, "chrom string, rstart long, rend long, is_sat int")
    assert call_files.covering(many).count() == call_files.covering(many.distinct()).count()


def test_clipped_intersections_are_not_shuffled(spark):
    from strandforge.plans import catalog

    r = random.Random(10)
    v = [(i, "chr1", r.randrange(4000), r.choice(["DEL", "INS"]), r.randrange(1, 900)) for i in range(1200)]
    v += v[:40] + [(i, "chr1", 17 * i, "DEL", 500) for i in range(30)] + [(i, "chr2", 10, "DEL", 50) for i in range(20)]
    rep = [(c, a, a + r.randrange(90), r.randrange(2)) for c, a in ((r.choice(["chr1", "chr1", "chr2"]), r.randrange(150) * 30) for _ in range(900))] + [("chr1", 5, 9000, 1)]
    seg = [("chr1", a, a + r.randrange(3000)) for a in (r.randrange(4000) for _ in range(60))]
    want = Counter()
    for c, a, z, k in rep + [(*x, 3) for x in seg]:
        for i, x, p, t, n in v:
            q = p if t == "INS" else p + n - 1
            if x == c and a <= q and z >= p:
                want[i, k, a, max(a, p), min(z, q)] += 1
    df = lambda d, s: spark.createDataFrame(d, s)
    given = df(v, "variant_id long, chrom string, pos long, svtype string, len long"), df(rep, "chrom string, rstart long, rend long, is_sat int"), df(seg, "chrom string, sstart long, send long")
    got, n = shuffled(spark, lambda: rows(catalog.jn4_clipped_overlap(*given), "variant_id", "kind", "a", "from_pos", "to_pos", "n"))
    assert got == sorted((*k, n) for k, n in want.items())
    assert n < 5 * len(got), (n, len(got))


def test_records_are_parsed_once(spark):
    lines = spark.createDataFrame([("f", 0, "c\t10\ta\tN\t<DEL>\t.\tPASS\tEND=30;SVTYPE=DEL;CIPOS=-5,5")], "file string, no long, line string")
    r = call_files.records(lines)
    assert [tuple(x) for x in r.select("pos", "last", "svtype", "length").collect()] == [(9, 29, "DEL", 21)]
    plan = r.select("pos", "last", "svtype", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2 * len(call_files.KEYS) and plan.count("split(") == 1, plan


def test_what_intersections_shuffle_grows_with_rows(spark):
    from strandforge.plans import catalog

    def job(n):
        r = random.Random(11)
        v = [(i, "chr1", r.randrange(60_000), "DEL", r.randrange(1, 5000)) for i in range(n)]
        rep = [("chr1", a, a + r.randrange(900), r.randrange(2)) for a in (r.randrange(66_000) for _ in range(n))]
        seg = [("chr1", 100, 3000), ("chr1", 0, 200_000), ("chr1", 65_530, 65_540)]
        df = lambda d, s: spark.createDataFrame(d, s)
        given = df(v, "variant_id long, chrom string, pos long, svtype string, len long"), df(rep, "chrom string, rstart long, rend long, is_sat int"), df(seg, "chrom string, sstart long, send long")
        got, moved = shuffled(spark, lambda: Counter(tuple(x) for x in catalog.jn4_clipped_overlap(*given).collect()))
        want = Counter()
        for a, z, k in [x[1:] for x in rep] + [(*x[1:], 3) for x in seg]:
            want.update((i, k, a, max(a, p), min(z, p + m - 1)) for i, _, p, _, m in v if a <= p + m - 1 and z >= p)
        assert got == Counter((*k, n) for k, n in want.items())
        return moved

    few, many = job(300), job(1200)
    assert many - few < 900 * 2 * 35, (few, many)  # bytes of each row of either side


def test_inside_keeps_few_others(spark):
    r = random.Random(5)
    others = [(c, a, z) for c, a, z, _ in deep(500, 6)]
    probes = [(i, "chr1", a, a + r.randrange(7000)) for i, a in enumerate(r.randrange(25_000) for _ in range(200))]
    got = intervals.inside(spark.createDataFrame(probes, "id long, chrom string, first long, last long"), spark.createDataFrame(others, "chrom string, s long, e long"), "chrom", ("first", "last"), ("s", "e"))
    assert rows(got, "id", "inside") == [(i, any(a <= f and z >= t for _, a, z in others)) for i, _, f, t in probes]


def greedy_pairs(truth, calls, distance):
    """One matching a caller, the sequential way."""
    out = []
    for caller in {c[-1] for c in calls}:
        pairs = sorted((abs(t[2] - c[2]), t[0], c[0]) for t in truth for c in calls if c[-1] == caller and t[1] == c[1] and abs(t[2] - c[2]) <= distance and min(t[3], c[3]) * 10 >= max(t[3], c[3]) * 7)
        seen_t, seen_c = set(), set()
        for d, t, c in pairs:
            if t not in seen_t and c not in seen_c:
                seen_t.add(t), seen_c.add(c)
                out.append((str(caller), t, c, d))
    return sorted(out)


def test_crowded_matching_goes_by_bands(spark, monkeypatch):
    from strandforge.operators import matching

    r = random.Random(7)
    truth = [(i, "chr1", r.randrange(3000), r.randrange(50, 400)) for i in range(260)] + [(900 + i, "chr2", 5000 * i, 100) for i in range(5)]
    calls = [(-i, "chr1", r.randrange(3000), r.randrange(50, 400), r.choice(["x", "y", None])) for i in range(1, 240)] + [(-900 - i, "chr2", 5000 * i + 400, 100, "x") for i in range(5)]
    t = spark.createDataFrame(truth, "variant_id long, chrom string, pos long, len long").withColumn("svtype", F.lit("DEL"))
    c = spark.createDataFrame(calls, "call_id long, chrom string, pos long, len long, caller string").withColumn("svtype", F.lit("DEL"))
    met, whole = [], matching.candidates

    def counted(*a, **k):
        met.append(whole(*a, **k).count())
        return whole(*a, **k)

    monkeypatch.setattr(matching, "candidates", counted)
    got = matching.matched(t, c, ["caller"])
    assert sorted((str(x), *y) for x, *y in got.select("caller", "variant_id", "call_id", "d").collect()) == greedy_pairs(truth, calls, 500)
    every = whole(t, c).count()
    assert len(met) > 1 and sum(met) < every / 2, (met, every)


def test_truth_is_not_repeated_for_every_set(spark, monkeypatch):
    from strandforge.operators import matching

    r = random.Random(12)
    truth = [(i, "chr1", r.randrange(3000), r.randrange(50, 400)) for i in range(260)]
    calls = [(-i, "chr1", r.randrange(3000), r.randrange(50, 400), r.choice(["u", "v", "w", "x", "y", None])) for i in range(1, 300)]
    t = spark.createDataFrame(truth, "variant_id long, chrom string, pos long, len long").withColumn("svtype", F.lit("DEL"))
    c = spark.createDataFrame(calls, "call_id long, chrom string, pos long, len long, caller string").withColumn("svtype", F.lit("DEL"))
    kept, write = [], matching.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "free" and "variant_id" in out.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(matching, "materialize", counted)
    got = matching.matched(t, c, ["caller"])
    assert sorted((str(x), *y) for x, *y in got.select("caller", "variant_id", "call_id", "d").collect()) == greedy_pairs(truth, calls, 500)
    assert len(kept) > 1 and max(kept) <= len(truth), kept


def test_greedy_choices_in_batches(spark, monkeypatch):
    from strandforge.operators import matching, rounds

    r = random.Random(8)
    data = [("chr1", i, a, a + n - 1, n) for i, (a, n) in enumerate((r.randrange(6000), r.randrange(5, 400)) for _ in range(220))]
    df = spark.createDataFrame(data, "chrom string, id long, first long, last long, len long")
    want = []
    for c, i, a, z, n in sorted(data, key=lambda x: (x[4], x[1])):
        if all(a > y or z < x for _, _, x, y, _ in want):
            want.append((c, i, a, z, n))
    calls = [(i, "chr1", "DEL", r.randrange(4000), r.randrange(100, 130), r.randrange(4)) for i in range(200)]
    met, whole, made = [], rounds.dropped, spark.createDataFrame(calls, "call_id long, chrom string, svtype string, pos long, len long, s long")
    monkeypatch.setattr(rounds, "dropped", lambda pairs, *a: met.append(pairs.count()) or whole(pairs, *a))
    every = []
    for batch in (1000, 20):
        monkeypatch.setattr(rounds, "BATCH", batch)
        met.clear()
        assert rows(intervals.greedy_disjoint(df, "id", ["len"]), "id") == sorted((x[1],) for x in want)
        every.append(sum(met))
        assert dict(rows(matching.collapse(made, "s", size=0.9), "call_id", "kept_id")) == greedy_folds(calls, 9)
    assert every[1] * 4 < every[0]


def test_edit_distances_are_many_tasks_work(spark):
    from strandforge.operators import matching

    r = random.Random(12)
    side = lambda n, sign: [(sign * i, "chr1", "INS", r.randrange(90_000), 60, "".join(r.choice("AC") for _ in range(40))) for i in range(1, n)]
    truth, calls = side(900, 1), side(900, -1)
    t, c = (spark.createDataFrame(d, f"{k} long, chrom string, svtype string, pos long, len long, {q} string") for d, k, q in ((truth, "variant_id", "t_seq"), (calls, "call_id", "c_seq")))
    pairs = matching.candidates(t, c, similarity=0.7)
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    every = matching.candidates(t, c).where(F.levenshtein("t_seq", "c_seq") <= 12)
    assert rows(pairs, "variant_id", "call_id", "d") == rows(every, "variant_id", "call_id", "d")
    assert len(tasks) >= 8, tasks


def greedy_folds(calls, tenths):
    folds, kept = {}, []
    for i, _, _, p, n, s in sorted(calls, key=lambda x: (-x[5], x[0])):
        near = [k for k, q, m in kept if abs(p - q) <= 500 and min(n, m) * 10 >= max(n, m) * tenths]
        folds[i] = near[0] if near else i
        if not near:
            kept.append((i, p, n))
    return folds


def test_call_sets_are_scored_once(spark):
    from strandforge.operators import families
    from strandforge.plans import catalog_more, studies

    r = random.Random(11)
    sex = lambda i: ("Female", "Male", "Other", "Male")[(i // 4 * 3 + i) % 4]
    people = [(i // 4, f"P{i}", sex(i), 1940 + r.randrange(70)) for i in range(4, 2400)]
    calls = [(-(i * 101 + r.choice([4, 5, 6, 7, 30, 31, 33])), "chr1", r.randrange(9000), r.choice(["DEL", "INS"]), r.randrange(100, 400), r.choice(["x", "y"])) for i in range(1, 300)]
    individuals = spark.createDataFrame(people, "family_id long, research_id string, sex string, birth_year int")
    given = spark.createDataFrame(calls, "call_id long, chrom string, pos long, svtype string, len long, caller string").cache()
    trios = families.children(individuals)
    every = given.withColumn("k", F.abs("call_id") % 101).join(individuals.select("research_id", (F.expr("substring(research_id, 2)").cast("long") % 101).alias("k")), "k").drop("k").cache()
    truth = studies.trio_truth(trios, every).select("child", "call_id", F.concat_ws("", F.transform("parents", lambda x: x.cast("string"))).alias("parents"), F.floor(F.col("len") / 500).alias("bin"))
    want = rows(truth)
    got, n = shuffled(spark, lambda: rows(catalog_more.study_trio_truth(individuals, given), "child", "call_id", "parents", "bin"))
    assert got == want and len(want) > 200
    own = every.join(trios.select(F.col("child").alias("research_id")), "research_id").withColumnRenamed("research_id", "child")
    own = own.withColumn("coverage", F.explode(F.filter(F.array(*map(F.lit, (4, 8, 16))), lambda v: F.abs("call_id") % 16 < v)))
    names = ["child", "caller", "coverage", "tp", "fp", "fn", "precision", "recall", "f1"]
    scores = rows(studies.trio_matrices(studies.trio_truth(trios, every), own, ["caller", "coverage"]), *names)
    assert rows(catalog_more.study_trio_matrices(individuals, given), *names) == scores
    # Ten times the children of the same sets: what is matched is the same.
    more = spark.createDataFrame([(f + 101_000 * k, f"P{int(p[1:]) + 404 * 1000 * k}", s, y) for k in range(10) for f, p, s, y in people], individuals.schema)
    got, many = shuffled(spark, lambda: catalog_more.study_trio_matrices(more, given).count())
    assert got == 10 * len(scores) and many < 12 * n, (many, n)


_ON_HAPLOTYPE = "chrom string, haplotype_id long, variant_id long, first long, last long"


def left_in_rounds(data):
    """What ``without_collisions`` leaves, by lists of pairs; a pair of ids counts as often as places of theirs collide."""
    data = sorted(set(data), key=str)
    near = {}
    for x in data:
        for y in data:
            if None not in (*x, *y) and x[:2] == y[:2] and x[2] != y[2] and y[3] <= x[4] + 5 and x[3] <= y[4] + 5:
                near.setdefault(x[:3], []).append(y[:3])
    live, gone = dict(near), set()
    while live:
        rank = {k: (len(v), k[2]) for k, v in live.items()}
        first = {k for k, v in live.items() if all(rank[k] < rank[o] for o in v)}
        off = {o for k in first for o in live[k]}
        gone |= off
        live = {k: [o for o in v if o not in off] for k, v in live.items() if k not in first | off}
    return sorted((x[:3] for x in data if x[:3] not in gone), key=str)


@pytest.mark.parametrize("tile,halo", [(1 << 19, 1 << 16), (256, 4), (1024, 300)])
def test_collisions_by_tiles_are_those_of_the_rounds(spark, monkeypatch, tile, halo):
    monkeypatch.setattr(sampling, "TILE", tile)
    monkeypatch.setattr(sampling, "HALO", halo)
    r = random.Random(tile)
    data = [(f"chr{i % 2}", i % 3, i, a, a + r.choice([0, 8, 60, 400])) for i, a in enumerate(r.choices(range(-300, 4000), k=420))]
    data += data[:9] + [("chr0", 0, 0, None, 5), (None, 0, 1, 3, 9), (None, 0, 2, 3, 9)]  # equal rows, nulls
    data += [("chr1", 7, i, 10 * i, 10 * i + 40) for i in range(40)] + [("chr1", 7, 3, 700, 900), ("chr1", 7, 900, 702, 703)]  # an id at two places
    data += [("chr1", 8, i, 10 * i, 10 * i + 40) for i in range(40)] + [("chr1", 8, 99, 200, 180)]  # a range that ends before it begins
    got = sampling.without_collisions(spark.createDataFrame(data, _ON_HAPLOTYPE))
    assert sorted((tuple(x) for x in got.collect()), key=str) == left_in_rounds(data)


def test_collisions_are_not_listed(spark):
    def sent(n):
        df = spark.createDataFrame([(c, 0, i, a, z) for i, (c, a, z, _) in enumerate(deep(n, n))], _ON_HAPLOTYPE)
        return shuffled(spark, lambda: sampling.without_collisions(df).collect())[1]

    assert sent(1600) < 8 * sent(400)


@pytest.mark.parametrize("tile,pairs", [(1 << 16, 1 << 17), (64, 7)])
def test_neighbours_by_sorted_starts(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(matching, "TILE", tile)
    monkeypatch.setattr(matching, "PAIRS", pairs)
    r = random.Random(tile)
    data = [(f"chr{i % 2}", i % 3, i, a, a + r.choice([0, 8, 60, 400])) for i, a in enumerate(r.choices(range(-300, 2000), k=300))]
    data += data[:9] + [("chr0", 0, 0, None, 5), (None, 0, 1, 3, 9), (None, 0, 2, 3, 9), ("chr0", 0, 901, 30, None), ("chr0", 0, 902, 40, 20)]
    data += [("chr0", 0, 6, 40, 90), ("chr0", 0, 6, 40, 95), ("chr0", 0, 6, 60, 61)]  # an id at several places
    want = Counter((*x[:3], y[2]) for x in set(data) for y in set(data) if None not in (*x, *y[:4]) and x[:2] == y[:2] and (x[3], x[2]) < (y[3], y[2]) and y[3] <= x[4] + 5)
    assert Counter(tuple(x) for x in matching.neighbours(spark.createDataFrame(data, _ON_HAPLOTYPE)).collect()) == want


def test_neighbours_compare_no_more_than_they_return(spark):
    """Ranges that lie in one bin but do not meet: the rows that any step gives grow with the rows and the pairs, not with the rows of a bin squared."""
    n = 2000
    df = spark.createDataFrame([("chr1", 0, i, 8 * (i % 500), 8 * (i % 500) - (i % 2)) for i in range(n)], _ON_HAPLOTYPE)
    got = matching.neighbours(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and got.count() == 500 * 6
