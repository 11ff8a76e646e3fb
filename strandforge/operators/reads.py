"""Read simulation, partition by partition, with numpy generators seeded by (seed, read block)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import ranks, uniform

_BACK = bytes.maketrans(b"acgtACGT", b"tgcaTGCA")
_BASES = np.frombuffer(b"ACGT", np.uint8)


@dataclass(frozen=True)
class ReadParameters:
    """Defaults of the model mode; ``ccs`` are those of the study."""

    depth: float = 20.0
    length_mean: float = 9000.0
    length_sd: float = 7000.0
    length_min: int = 100
    length_max: int = 1_000_000
    accuracy_mean: float = 0.85
    accuracy_min: float = 0.75
    accuracy_max: float = 1.0
    substitution: int = 6
    insertion: int = 54
    deletion: int = 40
    error_free: bool = False
    log_normal: bool = False
    seed: int = 1

    @classmethod
    def ccs(cls, **more) -> ReadParameters:
        return cls(**({"length_mean": 15000.0, "length_sd": 4000.0, "length_min": 5000, "length_max": 30000, "accuracy_mean": 0.995, "accuracy_min": 0.99, "substitution": 6, "insertion": 50, "deletion": 54} | more))


def lengths(r: np.random.Generator, n: int, p: ReadParameters) -> np.ndarray:
    """Gamma (or log-normal) of the given mean and deviation, redrawn outside the range."""
    if p.log_normal:
        s2 = np.log1p((p.length_sd / p.length_mean) ** 2)
        draw = lambda k: r.lognormal(np.log(p.length_mean) - s2 / 2, s2**0.5, k)
    else:
        shape = (p.length_mean / p.length_sd) ** 2
        draw = lambda k: r.gamma(shape, p.length_mean / shape, k)
    out = draw(n)
    for _ in range(100):
        bad = (out < p.length_min) | (out > p.length_max)
        if not bad.any():
            break
        out[bad] = draw(int(bad.sum()))
    return np.clip(out, p.length_min, p.length_max).astype(np.int64)


def accuracies(r: np.random.Generator, n: int, p: ReadParameters) -> np.ndarray:
    """Whole percents in the range with weight exp(0.22 a), shifted to the mean."""
    a = np.arange(round(p.accuracy_min * 100), round(p.accuracy_max * 100) + 1)
    w = np.exp(0.22 * (a - a.max()))
    got = r.choice(a, n, p=w / w.sum()) / 100
    return np.clip(got + p.accuracy_mean - float((a * w).sum() / w.sum()) / 100, p.accuracy_min, p.accuracy_max)


def mutate(r: np.random.Generator, seq: bytes, accuracy: float, p: ReadParameters) -> tuple[bytes, bytes]:
    """Sequence with errors at rate 1 - accuracy, shared by the ratios, and its Phred+33 qualities."""
    rate = 1 - accuracy
    q = bytes([33 + int(min(93, round(-10 * np.log10(max(rate, 1e-9)))))])
    if p.error_free or rate <= 0:
        return seq, q * len(seq)
    total = p.substitution + p.insertion + p.deletion
    a = np.frombuffer(seq, np.uint8)
    u = r.random(len(a))
    s, i, d = (rate * x / total for x in (p.substitution, p.insertion, p.deletion))
    sub = u < s
    out = a.copy()
    out[sub] = _BASES[(np.searchsorted(_BASES, out[sub]) + r.integers(1, 4, int(sub.sum()))) % 4]
    times = np.ones(len(a), np.int64)
    times[(u >= s) & (u < s + i)] = 2
    times[(u >= s + i) & (u < s + i + d)] = 0
    res = np.repeat(out, times)
    first = np.r_[True, np.repeat(np.arange(len(a)), times)[1:] != np.repeat(np.arange(len(a)), times)[:-1]] if len(res) else np.empty(0, bool)
    res[~first] = _BASES[r.integers(0, 4, int((~first).sum()))]
    return res.tobytes(), q * len(res)


def drawn(slots: DataFrame, profile: DataFrame, pairs: int, seed: int = 1) -> DataFrame:
    """A (length, accuracy) of the profile for each slot (key columns and i), drawn by how many rows have it.

    Each pair owns a piece of [0, 1) as long as its share; the pieces are dealt over
    at least as many cells as there are pairs, so no table is broadcast and no cell is hot.
    """
    cells = 1 << max(12, (pairs - 1).bit_length())
    n = profile.groupBy("length", "accuracy").agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", F.floor(F.col("length") / 256))
    run = Window.orderBy("length", "accuracy").partitionBy("_w").rowsBetween(Window.unboundedPreceding, 0)
    totals = n.groupBy("_w").agg(F.sum("_n").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_w"))
    totals = totals.select("_w", (upto - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy(F.lit(0))).alias("_all"))
    n = n.withColumn("_to", F.sum("_n").over(run)).join(totals, "_w").withColumn("_to", F.col("_before") + F.col("_to"))
    n = n.select("length", "accuracy", ((F.col("_to") - F.col("_n")) / F.col("_all")).alias("_lo"), (F.col("_to") / F.col("_all")).alias("_hi"))
    n = n.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.floor(F.col("_hi") * cells))))
    d = slots.withColumn("_u", uniform(seed, 11, *slots.columns)).withColumn("_cell", F.floor(F.col("_u") * cells))
    return d.join(n, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_cell", "_u", "_lo", "_hi")


def simulate(haplotypes: DataFrame, p: ReadParameters = ReadParameters(), block: int = 1000, profile: DataFrame | None = None) -> DataFrame:
    """Reads of every haplotype (haplotype_id, sequence, and contig if it has many) to ``depth``: read_id, haplotype_id, contig if given, start, forward, sequence, quality.

    Blocks of reads are dealt out, so a long sequence is many tasks' work. With a
    ``profile`` (length, accuracy) these are drawn by the counts of all its rows, and
    depth is by its mean length. Strands alternate; a read that holds NNNNN is left out.
    read_id counts within a sequence.
    """
    keys = [c for c in ("haplotype_id", "contig") if c in haplotypes.columns]
    mean = p.length_mean
    if profile is not None:
        known = profile.select("length", "accuracy").where("length is not null and accuracy is not null")
        pairs, mean = known.groupBy("length", "accuracy").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum(F.col("length") * F.col("n")) / F.sum("n")).first()
        if not pairs:
            raise ValueError("the profile has no rows")
    n = F.ceil(F.length("sequence") * p.depth / mean).cast("long")
    blocks = haplotypes.select(*keys, "sequence", n.alias("n")).where("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    if profile is not None:
        slots = blocks.select(*keys, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block), F.col("n") - F.col("block") * block) - 1)).alias("i"))
        lists = drawn(slots, known, pairs, p.seed).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("i", "length", "accuracy"))).alias("x"))  # a block's rows
        blocks = blocks.join(lists.select(*keys, "block", F.col("x.length").alias("lengths"), F.col("x.accuracy").alias("accuracies")), [*keys, "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                at, seq, k = [row[c] for c in keys], row["sequence"], row["block"]
                r, raw, out = np.random.default_rng([p.seed, *map(int, at), int(k)]), seq.encode(), []
                size = int(min(block, row["n"] - k * block))
                if "lengths" in row:
                    ls, accs = np.asarray(row["lengths"], np.int64), row["accuracies"]
                else:
                    ls, accs = lengths(r, size, p), accuracies(r, size, p)
                for i, (length, acc) in enumerate(zip(np.minimum(ls, len(raw)), accs)):
                    start = int(r.integers(0, len(raw) - length + 1))
                    piece = raw[start : start + length]
                    forward = i % 2 == 0
                    got, q = mutate(r, piece if forward else piece[::-1].translate(_BACK), float(acc), p)
                    if b"NNNNN" not in got:
                        out.append((int(k * block + i), *at, start, forward, got.decode(), q.decode()))
                yield pd.DataFrame(out, columns=["read_id", *keys, "start", "forward", "sequence", "quality"])

    return blocks.repartition(*map(F.col, [*keys, "block"])).mapInPandas(run, f"read_id long, {', '.join(f'{c} long' for c in keys)}, start long, forward boolean, sequence string, quality string")


def from_templates(templates: DataFrame, p: ReadParameters = ReadParameters()) -> DataFrame:
    """One read of each template (name, sequence), errors added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for b in batches:
            rows = []
            for name, seq in zip(b["name"], b["sequence"]):
                r = np.random.default_rng([p.seed, zlib.crc32(name.encode())])
                got, q = mutate(r, seq.encode(), float(accuracies(r, 1, p)[0]), p)
                rows.append((name, got.decode(), q.decode()))
            yield pd.DataFrame(rows, columns=["name", "sequence", "quality"])

    return templates.select("name", "sequence").mapInPandas(run, "name string, sequence string, quality string")


def diploid(reads: DataFrame, seed: int = 1) -> DataFrame:
    """Reads of both haplotypes of an individual in one hashed order, ranked by ranges of the hash."""
    keys = [c for c in ("haplotype_id", "contig") if c in reads.columns]
    d = reads.withColumn("individual", F.floor(F.col("haplotype_id") / 2)).withColumn("_h", F.xxhash64(F.lit(seed), *keys, "read_id"))
    return ranks(d, ["individual"], F.shiftright("_h", 52), ["_h", *keys, "read_id"], "place").drop("_h")
