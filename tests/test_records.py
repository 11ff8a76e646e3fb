"""Ranges of files, references in chunks, call files one by one."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandforge.operators import call_files, matching, reference
from strandforge.sources import formats, indexed, records, sinks


def block(data):
    """A gzip block that states its length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 12 + 6 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data, size=700):
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


def reads(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.choice([1, 20, 90, 400])
        # Qualities that begin like a header or a plus line are what borders have to be told from.
        out.append((f"@r{i}", "".join(r.choices("ACGT", k=k)), r.choice("@+I") + "".join(r.choices("@+I!", k=k - 1))))
    return out


def text_of(data, end="\n"):
    return "".join(f"{h}{end}{s}{end}+{h[1:] if len(s) % 2 else ''}{end}{q}{end}" for h, s, q in data).encode()


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
@pytest.mark.parametrize("kind", ["plain", "blocks", "gzip", "crlf", "no end"])
def test_ranges_give_the_records_of_the_file(tmp_path, kind, size):
    data = reads(60 if size == 1 else 300)
    raw = text_of(data, "\r\n" if kind == "crlf" else "\n")
    stored = {"blocks": blocks(raw), "gzip": gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]), "no end": raw[:-1]}.get(kind, raw)
    path = tmp_path / "a.fq"
    path.write_bytes(stored)
    reader = records._Reader("fastq", [str(path)], size)
    parts = reader.partitions()
    got = [tuple(x.values()) for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert [x[1:] for x in got] == data and len(parts) == -(-len(stored) // size)
    if size == 1000 and kind in ("plain", "blocks"):
        assert sum(any(b.num_rows for b in reader.read(p)) for p in parts) > len(parts) // 2


@pytest.mark.parametrize("bad", [b"@a\nAC\n+\n", b"@a\nAC\nII\n@b\n", b"a\nAC\n+\nII\n"])
def test_broken_records_are_errors(tmp_path, bad):
    (tmp_path / "a.fq").write_bytes(bad)
    reader = records._Reader("fastq", [str(tmp_path)], 1 << 20)
    with pytest.raises(ValueError):
        [list(reader.read(p)) for p in reader.partitions()]


def test_fastq_of_many_files(spark, tmp_path):
    data = reads()
    for i in range(3):
        (tmp_path / f"{i}.fq").write_bytes(text_of(data[i::3]))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    whole, split = formats.fastq(spark, str(tmp_path)), formats.fastq(spark, f"file://{tmp_path}", 2000)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 3
    same = lambda d: sorted(tuple(r) for r in d.select("header", "sequence", "quality").collect())
    assert same(whole) == same(split) == sorted(data)
    with pytest.raises(Exception, match="nowhere"):
        formats.fastq(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_lines_are_numbered_over_ranges(spark, tmp_path, size):
    r = random.Random(2)
    files = {f"f{i}": ["".join(r.choices("ab #\t", k=r.choice([0, 1, 9, 40]))) for _ in range(r.choice([1, 30]))] for i in range(4)}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = {}
    for x in records.numbered(spark, str(tmp_path), size).collect():
        got.setdefault(x.file.rsplit("/", 1)[1], {})[x.no] = x.line
    assert got == {k: dict(enumerate(v)) for k, v in files.items()}


def test_ranges_of_numbered_lines_are_not_very_many(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)] + ["y" * 40_000, "", "é"]
    (tmp_path / "big").write_text("\n".join(lines))  # the last line has no end
    got = records.numbered(spark, str(tmp_path / "big"), 64)
    assert [tuple(x) for x in got.sort("no").select("no", "line").collect()] == list(enumerate(lines))
    assert got.rdd.getNumPartitions() <= 2 * records.RANGES


def test_population_in_ranges(spark, tmp_path):
    lines = ["3"] + [f"v{i}_{n}" if n != "length" else str(i) for i in range(3) for n in formats.VARIANT_LINES]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    got = formats.population(spark, str(tmp_path / "p.txt")).sort("variant_id").collect()
    assert [(x.variant_id, x.length, x.sequence) for x in got] == [(i, str(i), f"v{i}_sequence") for i in range(3)]


@pytest.mark.parametrize("size,halo", [(4, 0), (4, 3), (16, 8), (4096, 512)])
def test_spans_from_chunks(spark, size, halo):
    r = random.Random(3)
    contigs = {f"c{i}": "".join(r.choices("ACGTn", k=n)) for i, n in enumerate([0, 1, 7, 50, 203])}
    parts = reference.chunks(spark.createDataFrame(list(contigs.items()), "name string, sequence string"), size, halo)
    wanted = [(i, r.choice([*contigs, "none"]), a, a + r.choice([0, 1, 2, 5, 17, 120])) for i, a in enumerate(r.choices(range(-2, 60), k=200))]
    got = dict(tuple(x) for x in reference.spans(spark.createDataFrame(wanted, "id long, chrom string, from_pos long, to_pos long"), parts, "id", size, halo).collect())
    assert got == {i: contigs.get(c, "")[max(a, 0) : max(z, 0)] for i, c, a, z in wanted}


def test_alleles_of_every_place(spark):
    r = random.Random(4)
    ref = "".join(r.choices("ACGT", k=90))
    parts = reference.chunks(spark.createDataFrame([("chr1", ref)], "name string, sequence string"), 16, 8)
    data = [(100 * k + p, "chr1", p, sv, n) for k, (sv, n) in enumerate([("DEL", 1), ("DEL", 30), ("INV", 12), ("INS", 5), ("DUP", 40)]) for p in (0, 1, 15, 16, 31, 60)]
    d = reference.with_letters(spark.createDataFrame(data, "variant_id long, chrom string, pos long, svtype string, len long"), parts, size=16, halo=8)
    a, b = reference.alleles(F.col("pos"), F.col("svtype"), F.col("anchor"), F.col("letters"), F.lit("TTT"))
    turn = str.maketrans("ACGT", "TGCA")
    for x in d.withColumn("ref", a).withColumn("alt", b).collect():
        seq, p = ref[x.pos : x.pos + x.len], x.pos
        base = ref[p] if x.svtype == "INS" else (ref[p + x.len] if x.svtype in ("DEL", "INV") else ref[0]) if p == 0 else ref[p - 1]
        around = lambda s: s + base if p == 0 else base + s
        want = {"DEL": (around(seq), base), "INV": (around(seq), around(seq[::-1].translate(turn))), "INS": (base, around("TTT")), "DUP": (base, "<DUP>")}[x.svtype]
        assert (x.ref, x.alt) == want, x


def test_truth_records(spark):
    ref = "ACGTTGCAAC"
    parts = reference.chunks(spark.createDataFrame([("chr1", ref)], "name string, sequence string"))
    data = [(1, "chr1", 0, "DEL", 3, 0.25, 4, 0, 1), (2, "chr1", 4, "DEL", 2, 0.5, 1, 1, 2), (3, "chr1", 5, "INS", 4, 1.0, 2, None, 0), (4, "chr1", 2, "INV", 3, 0.1, 3, 4, 0)]
    v = spark.createDataFrame(data, "variant_id long, chrom string, pos long, svtype string, len long, af double, ctx int, ctx_end int, covered long")
    got = [x.line for x in reference.truth_records(v, parts, F.lit("TTTT"), F.lit("0|1")).sort("variant_id").collect()]
    assert got == [
        "chr1\t1\t1\tACGT\tT\t.\tPASS\tEND=3;SVLEN=-3;SVTYPE=DEL;AF=0.25;REPEATS_START=4;REPEATS_END=0;REPEATS_FRACTION=0.3333\tGT\t0|1",
        "chr1\t4\t2\tTTG\tT\t.\tPASS\tEND=6;SVLEN=-2;SVTYPE=DEL;AF=0.5;REPEATS_START=1;REPEATS_END=1;REPEATS_FRACTION=1.0000\tGT\t0|1",
        "chr1\t6\t3\tG\tGTTTT\t.\tPASS\tEND=6;SVLEN=4;SVTYPE=INS;AF=1.0;REPEATS_START=2;REPEATS_END=2;REPEATS_FRACTION=0.0000\tGT\t0|1",
        "chr1\t3\t4\tG\t<INV>\t.\tPASS\tEND=5;SVTYPE=INV;AF=0.1;REPEATS_START=3;REPEATS_END=4;REPEATS_FRACTION=0.0000\tGT\t0|1",
    ]


def test_one_file_an_input(spark, tmp_path):
    r = random.Random(6)
    files = {f"s{i}": [f"{i} {k}" for k in range(r.choice([1, 2, 5]))] for i in range(120)} | {"big": [f"line {k} " + "x" * (k % 50) for k in range(6000)]}
    data = [(n, k, line) for n, lines in files.items() for k, line in enumerate(lines)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "file string, no long, line string").repartition(7)
    told = {x.file: (x.n_lines, x.n_bytes) for x in sinks.write_files(df, str(tmp_path / "out"), ["no"]).collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(files)
    sinks.write_files(df, str(tmp_path / "out"), ["no"]).count()  # again, onto what is there
    for n, lines in files.items():
        raw = (tmp_path / "out" / n).read_bytes()
        assert raw == ("\n".join(lines) + "\n").encode() and told[n] == (len(lines), len(raw))


def test_annotation_leaves_the_rest_as_it_is(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description=\"x\">\n##INFO=<ID=REPEATS_START,Number=1,Type=Integer,Description=\"mine\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    body = ["chr1\t101\ta\tN\t<DEL>\t.\tPASS\tEND=300;SVTYPE=DEL;CIPOS=-50,50", "chr1\t5001\tb\tN\t<INS>\t9\tq1;q2\tSVTYPE=INS\tGT\t0|1", "", "chr9\t1\tc\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-20"]
    (tmp_path / "x.vcf").write_text(head + "\n".join(body) + "\n")
    lines = records.numbered(spark, str(tmp_path / "x.vcf"), 64)
    repeats = spark.createDataFrame([("chr1", 40, 51, 0), ("chr1", 200, 249, 1), ("chr1", 230, 259, 0)], "chrom string, rstart long, rend long, is_sat int")
    segdups = spark.createDataFrame([("chr1", 4990, 5009)], "chrom string, sstart long, send long")
    out = call_files.with_header_lines(call_files.annotate(lines, repeats, segdups), call_files.info_lines(lines).unionByName(call_files.filter_lines(lines)))
    got = [x.line for x in out.sort("no", "sub").collect()]
    h = head.rstrip("\n").split("\n")
    added = sorted(['##FILTER=<ID=q1,Description="Set by a caller">', '##FILTER=<ID=q2,Description="Set by a caller">', call_files.info_header("REPEATS_END"), call_files.info_header("REPEATS_FRACTION")])
    assert got == [*h[:-1], *added, h[-1], body[0] + ";REPEATS_START=0;REPEATS_END=4;REPEATS_FRACTION=0.3000", "chr1\t5001\tb\tN\t<INS>\t9\tq1;q2\tSVTYPE=INS;REPEATS_START=3;REPEATS_FRACTION=0.0000\tGT\t0|1", "", body[3] + ";REPEATS_START=4;REPEATS_END=4;REPEATS_FRACTION=0.0000"]


def test_regions_open_only_their_blocks(spark, tmp_path):
    r = random.Random(9)
    data = []
    for i in range(4000):
        pos = r.randrange(1_000_000)
        last = pos + r.choice([0, 10, 5000])
        note = "x" * (200_000 if i == 7 else r.randrange(60))
        data.append((f"chr{r.choice([1, 2, 10])}", pos, last, f"N={note};END={last + 1}"))
    df = spark.createDataFrame(data, "chrom string, pos long, last long, info string").repartition(5)
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), F.lit("N"), F.lit("<DEL>"), F.lit("."), F.lit("PASS"), "info")
    path = str(tmp_path / "calls")
    (tmp_path / "calls" / "blocks").mkdir(parents=True)
    (tmp_path / "calls" / "blocks" / "part-00000000-left.vcf.gz").write_bytes(b"of an attempt that failed")
    index = indexed.write_indexed(df.withColumn("line", line), path, "##fileformat=VCFv4.2", room=1500)
    asked = [("a", "chr1", 0, 999), ("b", "chr10", 500_000, 500_000), ("c", "chr2", 0, 2_000_000), ("d", "chr3", 0, 10**9), ("e", "chr1", 990, 1500)]
    regions = spark.createDataFrame(asked, "region string, chrom string, lo long, hi long")
    got = sorted((x.region, x.line.split("\t")[0], int(x.line.split("\t")[1]) - 1) for x in indexed.read_regions(spark, path, regions).collect())
    assert got == sorted((k, c, p) for k, chrom, lo, hi in asked for c, p, z, _ in data if c == chrom and p <= hi and z >= lo)
    total, opened = index.count(), indexed.blocks_of(index, regions.where("region <> 'c'")).select("file", "offset").distinct().count()
    assert total > 150 and 0 < opened <= total // 8
    assert opened == sum(any(x.chrom == c and x.low <= hi and x.high >= lo for k, c, lo, hi in asked if k != "c") for x in index.collect())
    # The files are gzip for any reader, in order.
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((tmp_path / "calls" / "blocks").iterdir()) if not p.name.startswith("."))
    lines = text.rstrip("\n").split("\n")
    places = [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[1:]]
    assert lines[0] == "##fileformat=VCFv4.2" and places == sorted(places) and len(places) == len(data)


def test_alike_is_the_edit_distance(spark):
    r = random.Random(10)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    data = []
    for i in range(200):
        a = "".join(r.choices("ACGT", k=r.choice([0, 1, 10, 40])))
        b = "".join(c for c in a if r.random() > 0.1) + "".join(r.choices("ACGT", k=r.choice([0, 0, 3])))
        data.append((i, a, b if r.random() < 0.8 else "".join(r.choices("ACGT", k=r.choice([5, 40])))))
    df = spark.createDataFrame([*data, (900, None, "A"), (901, "A", None)], "i long, a string, b string")
    got = {x.i for x in df.where(matching.alike("a", "b", 0.7)).collect()}
    assert got == {i for i, a, b in data if distance(a, b) * 100 <= max(len(a), len(b)) * 30}
