"""Call files as numbered lines: annotation and header changes that leave everything else as it is.

Lines are rows (file, no, line). Headers go past the annotator; what is added stands before the
line of column names. ``sinks.write_files`` writes one file an input, in the order of (no, sub).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as fn
from ..session import materialize
from ..sources.sinks import VCF_FIELDS, add_info
from . import intervals

REPEAT_KEYS = ("REPEATS_START", "REPEATS_END", "REPEATS_FRACTION")


#: INFO keys that a record is read for.
KEYS = ("SVTYPE", "END", "SVLEN", *[k for pairs, deviations in fn.CONFIDENCE.values() for k in (*pairs, *deviations)])


def _once(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """``keep`` and columns, each worked out once a row, however often it is used after: Spark does not put steps together over an explode."""
    return df.select(*keep, F.explode(F.array(F.struct(*columns))).alias("_x")).select(*keep, "_x.*")


def records(lines: DataFrame) -> DataFrame:
    """file, no and the 0-based first and last base, type, INFO, length and the values of ``KEYS`` of every record; header and empty lines are none."""
    p = F.split("line", "\t")
    d = _once(lines.where(~F.col("line").startswith("#") & (F.col("line") != "")), ["file", "no"], [p.alias("_p")])
    p = F.col("_p")
    d = d.select("file", "no", p[0].alias("chrom"), (p[1].cast("long") - 1).alias("pos"), p[4].alias("alt"), p[7].alias("info"))
    # Few keys are there, and to look for one is less than to match it.
    value = lambda k: F.when(F.col("info").contains(f"{k}="), F.regexp_extract("info", rf"(^|;){k}=([^;]*)", 2))
    d = _once(d, ["file", "no", "chrom", "pos", "alt", "info"], [value(k).alias(k) for k in KEYS])
    d = d.withColumns({k: F.nullif(k, F.lit("")) for k in KEYS})
    last, length = fn.end_and_length(F.col("svtype"), F.col("pos"), F.col("END").cast("long"), F.col("SVLEN").cast("long"))
    d = _once(d, ["file", "no", "chrom", "pos", "alt", "info", *KEYS[1:]], [fn.sv_type(F.col("SVTYPE"), F.col("alt")).alias("svtype")])
    return d.withColumn("last", last).withColumn("length", length)


def covered_share(spans: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """key, covered: bases of each span (key, chrom, first, last) under ``intervals.pieces`` (chrom, s, e, _bin), or under disjoint intervals (chrom, s, e), which are cut first; spans that meet none are left out."""
    if "_bin" not in parts.columns:
        parts = intervals.cut(parts, "s", "e")
    w = spans.select(key, "chrom", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / intervals.PIECE), F.floor(F.col("last") / intervals.PIECE))).alias("_bin"))
    met = w.join(parts.select("chrom", "_bin", "s", "e"), ["chrom", "_bin"]).where("s <= last and e >= first")
    return met.groupBy(key).agg(F.sum(F.least("last", "e") - F.greatest("first", "s") + 1).alias("covered"))


def covering(repeats: DataFrame) -> DataFrame:
    """Bases under repeats (chrom, rstart, rend) as disjoint pieces: chrom, s, e, _bin."""
    return materialize(intervals.pieces(repeats.select("chrom", F.col("rstart").alias("s"), F.col("rend").alias("e")), ["chrom"], "s", "e"), "pieces")


def repeat_keys(lines: DataFrame, repeats: DataFrame, segdups: DataFrame) -> DataFrame:
    """file, no, and the three keys of every record: context of each breakpoint in its confidence window, and the share of its bases under repeats (0 of an insertion)."""
    r, given = records(lines), []
    for at, end in (("pos", False), ("last", True)):
        values = [[F.col(k) for k in keys] for keys in fn.CONFIDENCE[end]]
        given += [w.alias(f"_{at}_{x}") for x, w in zip(("lo", "hi"), fn.clamp_window(F.col(at), *fn.offsets(*values)))]
    # Written once, with short numbers as keys: it is read for each window, for the spans and for the result.
    r = materialize(r.select("file", "no", "chrom", "pos", "last", "svtype", "length", *given, F.monotonically_increasing_id().alias("_k")), "records")
    windows = []
    for at, points in (("pos", r), ("last", r.where((F.col("svtype") != "INS") & F.col("last").isNotNull()))):
        w = points.select("_k", "chrom", "pos", F.col(f"_{at}_lo").alias("lo"), F.col(f"_{at}_hi").alias("hi"))
        windows.append(intervals.annotate(w, repeats, segdups, key="_k", lo=F.col("lo"), hi=F.col("hi"), segdup_tolerance=None))
    parts = covering(repeats)
    spans = r.where("svtype <> 'INS' and last >= pos").withColumnRenamed("pos", "first")
    out = r.join(windows[0].withColumnRenamed("ctx", "_start"), "_k").join(windows[1].withColumnRenamed("ctx", "_end"), "_k", "left").join(covered_share(spans, parts, "_k"), "_k", "left")
    share = F.bround(F.coalesce("covered", F.lit(0)) / F.coalesce("length", F.lit(1)), 4)
    return out.select("file", "no", F.col("_start").alias(REPEAT_KEYS[0]), F.col("_end").alias(REPEAT_KEYS[1]), F.format_string("%.4f", share).alias(REPEAT_KEYS[2]))


def annotate(lines: DataFrame, repeats: DataFrame, segdups: DataFrame) -> DataFrame:
    """Lines with the three keys at the end of each record's INFO. Other lines are not touched."""
    keys = repeat_keys(lines, repeats, segdups).withColumn("_r", F.lit(True))
    d = lines.join(keys, ["file", "no"], "left")
    return d.select("file", "no", F.when(F.col("_r"), add_info(F.col("line"), [(k, F.col(k)) for k in REPEAT_KEYS])).otherwise(F.col("line")).alias("line"))


def info_header(key: str) -> str:
    number, kind, text = VCF_FIELDS["INFO"][key]
    return f'##INFO=<ID={key},Number={number},Type={kind},Description="{text}">'


def with_header_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, no, sub, line: lines of ``wanted`` (file, head, text) come before the line of column names of their file, in the order of text, unless a header line begins with ``head``. Both are few a file."""
    heads = lines.where(F.col("line").startswith("##")).select("file", F.regexp_extract("line", "^##[A-Za-z]+=<ID=[^,>]*", 0).alias("head")).distinct()
    new = wanted.distinct().join(heads, ["file", "head"], "left_anti").groupBy("file").agg(F.array_sort(F.collect_set("text")).alias("_new"))
    names = F.col("line").startswith("#") & ~F.col("line").startswith("##")
    at = lines.where(names).join(new, "file", "left")
    more = at.select("file", "no", F.posexplode(F.concat(F.coalesce("_new", F.array().cast("array<string>")), F.array("line"))).alias("sub", "line"))
    return lines.where(~names).select("file", "no", F.lit(0).alias("sub"), "line").unionByName(more)


def filter_lines(lines: DataFrame) -> DataFrame:
    """file, head, text of a FILTER line for every filter that a file's records have."""
    used = lines.where(~F.col("line").startswith("#") & (F.col("line") != "")).select("file", F.explode(F.split(F.split("line", "\t")[6], ";")).alias("f")).where("f <> '.'").distinct()
    head = F.concat(F.lit("##FILTER=<ID="), "f")
    return used.select("file", head.alias("head"), F.concat(head, F.lit(',Description="Set by a caller">')).alias("text"))


def info_lines(lines: DataFrame, keys: tuple[str, ...] = REPEAT_KEYS) -> DataFrame:
    """file, head, text of the INFO lines of ``keys``, for every file."""
    texts: Column = F.array(*[F.struct(F.lit(f"##INFO=<ID={k}").alias("head"), F.lit(info_header(k)).alias("text")) for k in keys])
    return lines.select("file").distinct().select("file", F.explode(texts).alias("x")).select("file", "x.head", "x.text")
