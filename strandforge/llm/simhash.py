"""SimHash near-dedup: fingerprints, segment popcounts, a grid range-join, exact check.

A fingerprint's 32 segments of two bits are embedded as their bit counts. The
Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints. Bit counts are written in unary, two bits a segment, so that the
Manhattan distance is the popcount of an XOR. The segments form five blocks; within
distance 2 at least three blocks agree in every count, so the cells of the grid are
the counts of each three blocks (ten tables), and a pair within reach shares a cell.
Pairs of a cell pass the Manhattan bound, then the exact check.

Only distinct fingerprints are joined. A cell with more than ``cap`` of them is not
paired off: all its fingerprints go another exact way. Two fingerprints differ in at
most two bits just when some 64-bit value differs from each in at most one; every
fingerprint is sent to its 65 such values, and those that meet are joined in a star.
A value meets 65 at most, so no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from .common import keep_rows, row_hash
from .components import components

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of text hashed at once.
CHUNK = 4 << 20


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start:end], for all spans of one length at once."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    w64 = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,)).copy()
    lens = ends - starts
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lens, kind="stable")
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for idx in np.split(order, cuts) if len(order) else []:
            n, at = int(lens[idx[0]]), starts[idx]
            left = n
            if n >= 32:
                v = [np.full(len(idx), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while left >= 32:
                    for k in range(4):
                        v[k] = _round(v[k], w64[at + 8 * k])
                    at, left = at + 32, left - 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.uint64(0), x)) * P1 + P4
            else:
                h = np.full(len(idx), s + P5, np.uint64)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), w64[at]), 27) * P1 + P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ ((w64[at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
                at, left = at + 4, left - 4
            while left:
                h = _rotl(h ^ (raw[at].astype(np.uint64) * P5), 11) * P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[idx] = h ^ (h >> np.uint64(32))
    return out


def _shingles(lines: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and line of every shingle; lines of words joined by one space, one text a line."""
    a = np.frombuffer(lines, np.uint8)
    gaps = np.flatnonzero((a == 32) | (a == 10))
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(a)]
    line = np.r_[0, np.cumsum(a[gaps] == 10)]
    n = np.bincount(line)
    first = np.r_[0, np.cumsum(n)[:-1]]
    at = np.flatnonzero(line[: len(line) - width + 1] == line[width - 1 :]) if len(line) >= width else np.empty(0, int)
    short = np.flatnonzero((n < width) & (ends[first] > starts[first]))
    s, e, k = np.r_[starts[at], starts[first[short]]], np.r_[ends[at + width - 1], ends[first[short] + n[short] - 1]], np.r_[line[at], short]
    o = np.argsort(k, kind="stable")
    return s[o], e[o], k[o]


def _pieces(text: bytes, width: int) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes that share width - 1 words, so each shingle is in one piece."""
    while len(text) > 2 * CHUNK and (cut := text.find(b" ", CHUNK)) >= 0:
        back = cut
        for _ in range(width - 1):
            back = text.rfind(b" ", 0, back)
            if back < 0:
                break
        if back < 0:
            break
        yield text[:cut]
        text = text[back + 1 :]
    yield text


def bit_counts(texts: list[bytes], width: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many of its shingles' hashes set each bit (highest first), and the number of shingles."""
    bits, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)

    def add(group: list[tuple[int, bytes]]) -> None:
        lines = b"\n".join(t for _, t in group)
        s, e, k = _shingles(lines, width)
        if not len(s):
            return
        h = np.unpackbits(xxh64_spans(lines, s, e, seed).astype(">u8").view(np.uint8)).reshape(-1, 64)
        edges = np.r_[0, np.flatnonzero(np.diff(k)) + 1, len(k)]
        for i, j in zip(edges[:-1], edges[1:]):
            at = group[k[i]][0]
            bits[at] += h[i:j].sum(0, dtype=np.int64)
            total[at] += j - i

    group, held = [], 0
    for i, t in enumerate(texts):
        words = b" ".join(t.lower().split())
        for piece in _pieces(words, width):
            group.append((i, piece))
            held += len(piece) + 1
            if held >= CHUNK:
                add(group)
                group, held = [], 0
    if group:
        add(group)
    return bits, total


def fingerprint(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    bits, total = bit_counts(texts, width, seed)
    return np.packbits(bits * 2 > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3, seed: int = 42) -> DataFrame:
    """(_id, _tie, _fp) per row."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_tie", T.LongType()), T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprint(texts, width, seed).view(np.int64))], ["_id", "_tie", "_fp"])

    rows = docs.select(docs[id_col].alias("_id"), row_hash(docs).alias("_tie"), docs[text_col].cast("string").alias("_text"))
    return rows.mapInArrow(run, schema)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def unary_counts(fp: Column) -> Column:
    """Per segment of two bits its bit count in unary: 00, 01 or 11."""
    even = 0x5555555555555555
    a, b = fp.bitwiseAND(_long(even)), F.shiftrightunsigned(fp, 1).bitwiseAND(_long(even))
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _masks() -> list[int]:
    sizes, at, blocks = (7, 7, 6, 6, 6), 0, []
    for n in sizes:
        blocks.append(((1 << (2 * n)) - 1) << (2 * at))
        at += n
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def links(fps: DataFrame, cap: int = 64) -> DataFrame:
    """fps: distinct ``_fp``. Edges (a, b) that connect what is within two bits, directly or by way of others within two bits."""
    grid = F.array(*[F.struct(F.lit(i).alias("t"), F.col("_u").bitwiseAND(_long(m)).alias("cell")) for i, m in enumerate(_masks())])
    cells = fps.select("_fp", unary_counts(F.col("_fp")).alias("_u")).select("_fp", "_u", F.explode(grid).alias("g")).select("_fp", "_u", "g.t", "g.cell")
    counts = cells.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = materialize(cells.join(counts, ["t", "cell"]), "simhash-cells")
    few = busy.where(F.col("n") <= cap)
    a, b = few.select("t", "cell", F.col("_fp").alias("a"), F.col("_u").alias("ua")), few.select("t", "cell", F.col("_fp").alias("b"), F.col("_u").alias("ub"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    pairs = a.join(b, ["t", "cell"]).where(near).select("a", "b")
    ball = F.array(F.col("_fp"), *[F.col("_fp").bitwiseXOR(_long(1 << i)) for i in range(64)])
    points = busy.where(F.col("n") > cap).select("_fp").distinct().select("_fp", F.explode(ball).alias("p"))
    met = points.groupBy("p").agg(F.collect_list("_fp").alias("all")).where(F.size("all") > 1)  # at most 65
    stars = met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b")
    return pairs.union(stars)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _tie, _fp) per row, and (node, root) of linked fingerprints."""
    rows = materialize(fingerprints(docs, id_col, text_col, width, seed), "simhash-rows")
    return rows, components(links(rows.select("_fp").distinct(), cap), "simhash-components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, cap: int = 64) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id reachable).

    Words are runs outside ASCII white space, A-Z lower-cased; shingles of ``width``
    words count as often as they occur; a text of fewer words is one shingle; a null
    or wordless text has fingerprint zero. Fingerprints link at two or fewer differing
    bits. Null ids are passed over for component_id unless all are null. Repeated rows
    give repeated rows; an empty table gives none.
    """
    rows, comp = _classes(docs, id_col, text_col, width, seed, cap)
    rep = rows.groupBy("_fp").agg(F.min("_id").alias("_rep"))
    named = rep.join(comp, rep["_fp"] == comp["node"], "left").select("_fp", "_rep", F.coalesce("root", "_fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_rep").alias("_least"))
    named = named.join(least, "_root").select("_fp", "_least")
    return rows.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, cap: int = 64) -> DataFrame:
    """One row of each component of ``near_groups``: that of the least id (null ids last)."""
    rows, comp = _classes(docs, id_col, text_col, width, seed, cap)
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_tie").alias("tie")))
    best = rows.groupBy("_fp").agg(first.alias("_best"))
    named = best.join(comp, best["_fp"] == comp["node"], "left").select(F.coalesce("root", "_fp").alias("_root"), "_best")
    kept = named.groupBy("_root").agg(F.min("_best").alias("_best"))
    return keep_rows(docs, kept.select(F.xxhash64("_best.id").alias("_a"), F.col("_best.tie").alias("_b")), id_col)
