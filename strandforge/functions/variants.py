"""Scalar functions on VCF text and variants, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of variant types in INFO and ALT fields, and the type each stands for.
TYPE_LABELS = {"DEL": "DEL", "DEL:ME": "DEL", "DEL/INV": "DEL_INV", "INS": "INS", "INS:ME": "INS", "INS:NOVEL": "INS", "DUP": "DUP", "DUP:TANDEM": "DUP", "DUP:INT": "DUP", "INV": "INV", "INVDUP": "INVDUP", "CNV": "CNV", "BND": "BND", "TRA": "TRA"}


def info_field(info: Column, key: str) -> Column:
    """Value of a key; END is not found in CIEND. Null if absent."""
    return F.nullif(F.regexp_extract(info, rf"(^|;){key}=([^;]*)", 2), F.lit(""))


def sv_type(info_type: Column, alt: Column) -> Column:
    """SVTYPE if it is known, else the symbolic allele, case-insensitive; else null."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(table[F.upper(info_type)], table[F.upper(F.regexp_extract(alt, "^<(.*)>$", 1))])


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5).cast("long")


def confidence(info: Column, end: bool = False, sigmas: int = 3) -> tuple[Column, Column]:
    """(low, high) offsets: the CI pair, else plus and minus ``sigmas`` standard deviations, else 0."""
    pairs, deviations = CONFIDENCE[end]
    return offsets([info_field(info, k) for k in pairs], [info_field(info, k) for k in deviations], sigmas)


#: INFO keys of the confidence of a first and of a last breakpoint: pairs, and standard deviations.
CONFIDENCE = {False: (("CIPOS",), ("STD_quant_start", "STD_POS1")), True: (("CIEND", "CILEN"), ("STD_quant_stop", "STD_POS2"))}


def offsets(pairs: list[Column], deviations: list[Column], sigmas: int = 3) -> tuple[Column, Column]:
    """``confidence`` from the values of its keys."""
    spread = half_up(F.coalesce(*deviations).cast("double") * sigmas)
    parts = F.split(F.coalesce(*pairs), ",")
    zero = F.lit(0).cast("long")
    return F.coalesce(parts[0].cast("long"), -spread, zero), F.coalesce(parts[1].cast("long"), spread, zero)


def clamp_window(pos: Column, lo: Column, hi: Column, least: int = 10, most: int = 100) -> tuple[Column, Column]:
    """A CI around pos, at least ``least`` and at most ``most`` bases to each side."""
    return pos - F.greatest(F.lit(least), F.least(F.lit(most), -lo)), pos + F.greatest(F.lit(least), F.least(F.lit(most), hi))


def end_and_length(svtype: Column, pos: Column, end: Column, svlen: Column) -> tuple[Column, Column]:
    """Last base and length: from END if given, else from SVLEN, else null. An insertion has no length, and without END its last base is ``pos``."""
    ins = svtype == "INS"
    last = F.when(end.isNotNull(), end - 1).when(ins, pos).when(svlen.isNotNull(), pos + F.abs(svlen) - 1)
    return last, F.when(~ins, F.coalesce(end - pos, F.abs(svlen)))


def chromosome_id(chrom: Column) -> Column:
    """chr1..chr22 are 0..21, X 22, Y 23."""
    c = F.regexp_replace(chrom, "^chr", "")
    return F.when(c == "X", 22).when(c == "Y", 23).otherwise(c.cast("int") - 1)


def birth_year(date: Column) -> Column:
    return F.when(F.instr(date, "-") > 0, F.substring_index(date, "-", 1).cast("int")).otherwise(1800)


def reverse_complement(seq: Column) -> Column:
    """Case is kept; other letters become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^acgtACGT]", "N"), "acgtACGT", "tgcaTGCA"))


def reverse_complement_any(seq: Column) -> Column:
    """Letters other than acgt stay."""
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def substring0(seq: Column, start: Column, end: Column) -> Column:
    """0-based, half-open."""
    return seq.substr(start + 1, end - start)


def accuracy(quality: Column) -> Column:
    """1 minus the mean error of a Phred+33 string."""
    codes = F.transform(F.split(quality, ""), lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0))
    return F.lit(1.0) - F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / F.length(quality)


def collides(a_start: Column, a_end: Column, b_start: Column, b_end: Column, distance: int = 5) -> Column:
    return (b_start <= a_end + distance) & (a_start <= b_end + distance)


def coverages_below(listed: Column, most: Column) -> Column:
    """'4-8-12' and 10 to [4, 8, 10]: the listed values below, then the value."""
    kept = F.filter(F.transform(F.split(listed, "-"), lambda x: x.cast("long")), lambda x: x < most)
    return F.concat(kept, F.array(most.cast("long")))


def info_text(fields: list[tuple[str, Column]]) -> Column:
    """key=value pairs joined by semicolons, nulls left out, semicolons in values turned to commas."""
    return F.concat_ws(";", *[F.concat(F.lit(k + "="), F.translate(v.cast("string"), ";", ",")) for k, v in fields])


def alleles(sv: Column, before: Column, seq: Column) -> tuple[Column, Column]:
    """REF and ALT from the base before and the sequence: insertions grow, deletions shrink, inversions are symbolic."""
    ref = F.when(sv == "INS", before).when(sv == "DEL", F.concat(before, seq)).otherwise(before)
    return ref, F.when(sv == "INS", F.concat(before, seq)).when(sv == "DEL", before).when(sv == "INV", F.lit("<INV>"))
