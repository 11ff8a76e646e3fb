"""Greedy matching, independent sets, folds and cascades in rounds against the plain sequential methods."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandforge.operators import cascade, intervals, matching, rounds, sampling


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_greedy(spark, seed):
    r = random.Random(seed)
    pairs = {(g, r.randrange(40), r.randrange(40)): r.randrange(12) for g in "ab" for _ in range(300)}
    # A chain: each pair is ruled out by the one before, so that rounds follow each other.
    pairs |= {("c", k // 2, (k + 1) // 2): k for k in range(14)}
    df = spark.createDataFrame([(*k, d) for k, d in pairs.items()] + [("a", *next(iter(pairs))[1:], pairs[next(iter(pairs))])], "g string, variant_id long, call_id long, d long")
    want, used = [], set()
    for (g, a, b), d in sorted(pairs.items(), key=lambda x: (x[1], x[0][1], x[0][2])):
        if ("l", g, a) not in used and ("r", g, b) not in used:
            used |= {("l", g, a), ("r", g, b)}
            want.append((g, a, b, d))
    assert rows(matching.one_to_one(df, ["g"])) == sorted(want)
    assert matching.one_to_one(df.where("false"), ["g"]).count() == 0


def calls(spark, n, seed, span=4000):
    r = random.Random(seed)
    out = [(i, f"chr{r.randint(1, 2)}", r.randrange(span), r.choice(["DEL", "INS"]), r.choice([30, 50, 100, 104, 110, 60_000]), r.randrange(4)) for i in range(n)]
    return out, spark.createDataFrame(out, "call_id long, chrom string, pos long, svtype string, len long, support long")


def test_folds_are_closed(spark):
    listed, df = calls(spark, 220, 3)
    fits = [c for c in listed if 40 <= c[4] <= 50_000]
    near = lambda a, b: a[1] == b[1] and a[3] == b[3] and abs(a[2] - b[2]) <= 100 and min(a[4], b[4]) * 10 >= max(a[4], b[4]) * 9
    kept, into = [], {}
    for c in sorted(fits, key=lambda c: (-c[5], c[0])):
        into[c[0]] = next((k[0] for k in kept if near(k, c)), c[0])
        if into[c[0]] == c[0]:
            kept.append(c)
    got = dict(rows(matching.collapse(df, "support", distance=100, size=0.9)))
    assert got == into and all(got[k] == k for k in got.values()) and len(kept) < len(fits)


def test_parents_are_matched_for_themselves(spark):
    of = lambda data: spark.createDataFrame([(i, "chr1", p, "DEL", 100) for i, p in data], "call_id long, chrom string, pos long, svtype string, len long")
    child, first, second = of([(1, 1000), (2, 1010), (3, 9000)]), of([(11, 1002)]), of([(21, 1009), (22, 1100)])
    # One call of the first parent is one child's call only; the second parent has one for each.
    assert rows(matching.trio_truth(child, first, second)) == [(1, [0, 1]), (2, [1])]


def greedy_intervals(data):
    taken = []
    for x in sorted(data, key=lambda x: (x[4], x[2], x[1])):
        if all(t[0] != x[0] or t[2] > x[3] or t[3] < x[2] for t in taken):
            taken.append(x)
    return sorted((x[0], x[1]) for x in taken)


@pytest.mark.parametrize("chroms,n,span", [(3, 150, 3000), (1, 300, 2000)])
def test_disjoint_intervals_are_those_of_the_sequential_choice(spark, chroms, n, span):
    r = random.Random(n)
    data = []
    for i in range(n):
        size, at = r.choice([1, 5, 30, 200]), r.randrange(span)
        data.append((f"chr{r.randrange(chroms)}", i, at, at + size - 1, size))
    df = spark.createDataFrame(data, "chrom string, variant_id long, first long, last long, len long")
    assert rows(intervals.greedy_disjoint(df, "variant_id", ["len", "first"]), "chrom", "variant_id") == greedy_intervals(data)


def test_one_long_island_is_many_tasks(spark):
    """A chromosome whose intervals all hang together: pairs go by their ends, no group is larger than a row's neighbours."""
    data = [("chr1", i, 10 * i, 10 * i + 14, 15 + i % 7) for i in range(400)]
    df = spark.createDataFrame(data, "chrom string, variant_id long, first long, last long, len long")
    assert rows(intervals.greedy_disjoint(df, "variant_id", ["len"]), "chrom", "variant_id") == greedy_intervals([(c, i, a, z, n) for c, i, a, z, n in data])
    side = df.select("chrom", F.col("variant_id").alias("a"), "first", "last")
    met = intervals.range_join(side, df.select("chrom", F.col("variant_id").alias("b"), F.col("first").alias("f"), F.col("last").alias("l")), ["chrom"], ("first", "last"), ("f", "l")).where("a <> b").select("chrom", "a", "b").repartition(8, "chrom", "a")
    groups = [n for (n,) in met.groupBy("a").count().select("count").collect()]
    assert max(groups) <= 2 and len({p for (p,) in met.select(F.spark_partition_id()).distinct().collect()}) > 1


def test_fewest_neighbours_stay(spark):
    r = random.Random(5)
    data = [(h, i, a, a + r.choice([0, 3, 40])) for h in (1, 2) for i, a in enumerate(r.choices(range(600), k=90))]
    df = spark.createDataFrame(data, "haplotype_id long, variant_id long, first long, last long")
    left = set(rows(sampling.without_collisions(df)))
    collide = lambda x, y: x[0] == y[0] and x[1] != y[1] and y[2] <= x[3] + 5 and x[2] <= y[3] + 5
    near = {(x[0], x[1]): {(y[0], y[1]) for y in data if collide(x, y)} for x in data}
    assert all(not (near[k] & left) for k in left) and all(k in left or near[k] & left for k in near)
    # The same rounds, one by one.
    live, stay = dict(near), set()
    while live:
        rank = {k: (len(v), k[1]) for k, v in live.items()}
        first = {k for k, v in live.items() if all(rank[k] < rank[o] for o in v)}
        gone = first | {o for k in first for o in live[k]}
        stay |= first
        live = {k: v - gone for k, v in live.items() if k not in gone}
    assert left == stay


def test_dropped_with_ranks(spark):
    pairs = spark.createDataFrame([("x", 1, 2, 5, 5), ("x", 2, 3, 5, 4), ("y", 1, 2, 1, 0)], "k string, a long, b long, a_n long, b_n long")
    both = rounds.both_ways(pairs, ["k"], ["n"])
    assert rows(rounds.dropped(both, ["k"], ["n"])) == [("x", 2), ("y", 1)]


def plain_cascade(data, black, same):
    out, walls = {}, []
    over = lambda a, z, b, y: a <= y and b <= z
    for step in cascade.STEPS:
        left = []
        for c in sorted((x for x in data if x[1] == step.name), key=lambda x: (x[5], x[3], x[0])):
            i, _, chrom, a, z, n, tig, ca, cz = c
            if any(t == tig and over(ca, cz, s, e) for t, s, e in black):
                out[i] = "contig region"
            elif step.least and n < step.least:
                out[i] = f"shorter than {step.least}"
            elif step.most and n > step.most:
                out[i] = f"longer than {step.most}"
            elif any(w[0] == chrom and over(a, z, w[1], w[2]) and (not same or w[3] == tig) for w in walls):
                out[i] = "inside a larger call"
            elif step.greedy and any(x[2] == chrom and over(a, z, x[3], x[4]) for x in left):
                out[i] = "overlaps a shorter call"
            else:
                out[i] = None
                left.append(c)
        if step.blocks:
            walls += [(x[2], x[3], x[4], x[6]) for x in left]
    return out


@pytest.mark.parametrize("same", [False, True])
def test_cascade(spark, same):
    r = random.Random(8)
    data = []
    for i in range(260):
        step = r.choice([s.name for s in cascade.STEPS])
        n, at = r.choice([100, 300, 700, 1500, 2500]), r.randrange(30_000)
        data.append((i, step, f"chr{r.randint(1, 2)}", at, at + (0 if "insertion" in step else n - 1), n, f"t{r.randrange(3)}", 7 * i, 7 * i + 20))
    black = [("t1", 100, 300), ("t2", 0, 50)]
    df = spark.createDataFrame(data, "call_id long, step string, chrom string, first long, last long, len long, contig string, c_first long, c_last long")
    listed = spark.createDataFrame(black, "b_chrom string, b_first long, b_last long")
    got = {x.call_id: x.reason for x in cascade.cascade(df, blacklist=listed, same_contig=same).collect()}
    want = plain_cascade(data, black, same)
    assert got == want and {None, "contig region", "inside a larger call", "overlaps a shorter call", "shorter than 300", "longer than 2000"} == set(want.values())
    with pytest.raises(Exception, match="no step"):
        cascade.cascade(df.withColumn("step", F.lit("other"))).collect()
    assert cascade.cascade(df.where("false")).count() == 0


def test_counts_of_the_sweep(spark):
    t = spark.createDataFrame([(i, "chr1", 1000 * i, "DEL", 100, i % 2) for i in range(8)], "variant_id long, chrom string, pos long, svtype string, len long, t_gt long")
    c = spark.createDataFrame([(i, "chr1", 1000 * i + 3, "DEL", 100, 0, "x", n) for i in range(6) for n in ((1, 2) if i < 3 else (2,))], "call_id long, chrom string, pos long, svtype string, len long, gt long, caller string, level int")
    by = defaultdict(tuple)
    for x in matching.genotype_concordance(matching.genotype_matches(t, c, ["svtype"], ["caller", "level"]), ["svtype", "caller"], "level").collect():
        by[x.level] = (x.tp, x.n_true, x.recall, x.concordance, x.exact_recall)
    assert by == {1: (3, 8.0, 3 / 8, 2 / 3, 2 / 8), 2: (6, 8.0, 6 / 8, 3 / 6, 3 / 8)}


def test_pairs_share_what_they_have_to(spark):
    t = spark.createDataFrame([(i, k, "chr1", 1000, "DEL", 100) for i, k in ((1, "a"), (2, "b"))], "variant_id long, child string, chrom string, pos long, svtype string, len long")
    c = spark.createDataFrame([(7, "b", "chr1", 1400, "DEL", 90)], "call_id long, child string, chrom string, pos long, svtype string, len long")
    assert rows(matching.candidates(t, c, on=("child",)), "child", "variant_id", "call_id", "d") == [("b", 2, 7, 400)]
    assert matching.candidates(t, c.drop("child")).count() == 2


def test_trio_studies(spark):
    from strandforge.plans import studies

    trios = spark.createDataFrame([("c", "p", "q"), ("d", "p", "q")], "child string, p1 string, p2 string")
    data = [("c", 1, 1000), ("c", 2, 5000), ("c", 3, 9000), ("d", 4, 9001), ("p", 11, 1010), ("q", 21, 1005), ("q", 22, 5600), ("q", 23, 9100)]
    calls = spark.createDataFrame([(who, i, "chr1", at, "DEL", 100) for who, i, at in data], "research_id string, call_id long, chrom string, pos long, svtype string, len long")
    truth = studies.trio_truth(trios, calls)
    assert rows(truth, "child", "call_id", "parents") == [("c", 1, [0, 1]), ("c", 3, [1]), ("d", 4, [1])]
    seen = spark.createDataFrame([("c", 1, "chr1", 1000, "DEL", 100, "x"), ("c", 2, "chr1", 5000, "DEL", 100, "x"), ("d", 9, "chr1", 70_000, "DEL", 100, "x")], "child string, call_id long, chrom string, pos long, svtype string, len long, caller string")
    got = {x.child: (x.tp, x.fp, x.fn, x.precision, x.recall) for x in studies.trio_matrices(truth, seen, ["caller"]).collect()}
    assert got == {"c": (1, 1, 1, 0.5, 0.5), "d": (0, 1, 1, 0.0, 0.0)}
