"""Ranked lexical search over a bit-sliced impact index.

Documents are cut into blocks where they are read. In a block each term has the sorted
places of its documents and their impacts as bit slices: bit b of all impacts is one
bitmap. An impact is what a term's weight is multiplied with, so the index does not depend
on other documents but by the mean length; weights are made when a search knows
how many documents hold a term.

A search spreads a term's slices over the documents of the block and adds them into
the slices of every item that has the term, a bit at a time with carries (XOR for the sum,
majority for the carry); a slice is one long integer, so a step is one operation on all documents. The best k come from the sums'
slices, most significant first: documents with the bit set go before those without, and
a slice that would leave fewer than k settles its documents. A block gives at most
k documents an item, and the k best of all blocks are a window with a limit.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize, scratch, ship
from .common import ascii_lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in UTF-8: every byte of a character beyond ASCII belongs to a term.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Impacts are below 1000000.
BITS = 20


@dataclass
class Index:
    """Written blocks, the number of documents with a term, and of all their terms. Rows without a term hold the ids of a block's documents by place."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def terms_of(raw: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a piece at a time; a piece ends where a term does."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + piece)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw[at:end].lower())
        at = end


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * n_docs) div n_terms."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 75 + 25 * n.astype(np.int64) * n_docs // max(n_terms, 1)
    return 10**9 * tf // (1000 * tf + 12 * m)


def sliced(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit slices of the values of each term (from ``starts`` on), whole bytes a slice, the slices of a byte side by side: the bytes of all terms as rows of ``BITS``, and where each term's rows begin."""
    sizes = np.diff(np.append(starts, len(values)))
    rows = -(-sizes // 8)
    first = np.concatenate([[0], np.cumsum(rows)])
    slot = np.arange(len(values)) - np.repeat(starts - first[:-1] * 8, sizes)
    spread = np.zeros(int(first[-1]) * 8, np.uint32)
    spread[slot] = values
    out = np.empty((int(first[-1]), BITS), np.uint8)
    for b in range(BITS):
        out[:, b] = np.packbits((spread >> b & 1).astype(np.uint8), bitorder="little")
    return out, first


def unsliced(raw: bytes, n: int) -> np.ndarray:
    """The values of one term from its slices."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS), axis=0, count=n, bitorder="little")
    return bits.astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))


class _Block:
    """Postings of the documents of a block so far."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key, raw: bytes) -> None:
        held: Counter[bytes] = Counter()
        for part in terms_of(raw):
            held.update(part)
        self.ids.append(key)
        self.lengths.append(sum(held.values()))
        self.terms.append(np.fromiter((self.numbers[t] for t in held), np.int64, len(held)))
        self.counts.append(np.fromiter(held.values(), np.int64, len(held)))
        self.bytes += len(raw)

    def batches(self, block: int, n_docs: int, n_terms: int, schema: pa.Schema, rows: int = 16384) -> Iterator[pa.RecordBatch]:
        # By id, null last, so that the first of equals is the least.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = [len(x) for x in self.terms]
        docs, terms, tf = np.repeat(place, sizes), np.concatenate(self.terms), np.concatenate(self.counts)
        values = impacts(tf, np.repeat(np.array(self.lengths, np.int64), sizes), n_docs, n_terms)
        by = np.argsort(terms << 32 | docs)
        docs, terms, values = docs[by], terms[by], values[by]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        slices, first = sliced(values, starts)
        df = np.diff(np.append(starts, len(terms)))
        names = pa.array(list(self.numbers), pa.binary())
        at = np.append(starts, len(terms))
        where = docs.astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], pa.string()), pa.array([len(order)], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([[self.ids[i] for i in order]], schema.field("ids").type)], schema=schema)
        for a in range(0, len(df), rows):
            z = min(a + rows, len(df))
            blob = lambda data, edges: pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((edges - edges[0]).astype(np.int32).tobytes()), pa.py_buffer(data[edges[0] : edges[-1]].tobytes())])
            columns = [pa.array(np.full(z - a, block)), names[a:z].cast(pa.string()), pa.array(df[a:z]), blob(where.view(np.uint8), at[a : z + 1] * 4), blob(slices.reshape(-1), first[a : z + 1] * BITS), pa.nulls(z - a, schema.field("ids").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 32768, block_bytes: int = 16 << 20) -> Index:
    """Index every row and all its terms. A block ends with ``block_docs`` documents or ``block_bytes`` of text; a longer text is a block.

    Null and empty texts hold no term and are found by none; repeated rows and null ids
    are documents of their own; an empty table is an index without rows; other columns are
    not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(docs[f"`{id_col}`"].alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"))
    # One pass of JVM code over the texts: the mean length has to be known before the first impact.
    n, total = d.select(n_terms(F.col("_text")).alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    id_type = docs.schema[id_col].dataType
    kinds = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("slices", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, block, no = to_arrow_schema(kinds), _Block(), TaskContext.get().partitionId() << 32
        for b in batches:
            for key, t in zip(b.column(0), b.column(1).cast(pa.binary())):
                raw = t.as_py()
                if not raw:
                    continue
                if block.ids and (len(block.ids) >= block_docs or block.bytes + len(raw) > block_bytes):
                    yield from block.batches(no, n, total, schema)
                    block, no = _Block(), no + 1
                block.add(key.as_py(), raw)
        if block.ids:
            yield from block.batches(no, n, total, schema)

    folder = scratch(spark, "lexical-index")
    d.mapInArrow(run, kinds).write.parquet(folder)
    return Index(spark.read.schema(kinds).parquet(folder), n, total)


def add_into(sums: list[int], addend: list[int]) -> None:
    """Add one number a document to another, in place, bit by bit with carries. Both are slices, least first; a slice is a bitmap of documents, held as one integer."""
    sums += [0] * (len(addend) - len(sums))
    carry = 0
    for b, y in enumerate(addend):
        x = sums[b]
        half = x ^ y
        sums[b] = half ^ carry
        carry = x & y | carry & half
    b = len(addend)
    while carry:
        if b == len(sums):
            sums.append(0)
        x = sums[b]
        sums[b] = x ^ carry
        carry &= x
        b += 1


def best(sums: list[int], k: int) -> list[int]:
    """The documents of the k greatest sums above 0, of equal ones the first; from slices, most significant first."""
    sure, maybe, n = 0, 0, 0
    for x in sums:
        maybe |= x
    for x in reversed(sums):
        ones = maybe & x
        found = n + ones.bit_count()
        if found > k:
            maybe = ones
            continue
        sure, n = sure | ones, found
        maybe &= ~x
        if n == k:
            break
    return _places(sure, n) + _places(maybe, k - n)


def _places(bitmap: int, most: int) -> list[int]:
    """The first set bits of a bitmap."""
    out = []
    while bitmap and len(out) < most:
        low = bitmap & -bitmap
        out.append(low.bit_length() - 1)
        bitmap ^= low
    return out


def score(sums: list[int], place: int) -> int:
    return sum((x >> place & 1) << b for b, x in enumerate(sums))


def spread(places: np.ndarray, values: np.ndarray, n: int) -> list[int]:
    """Slices of the values over a block of n documents, by place."""
    bits = int(values.max()).bit_length()
    if len(places) < 16:
        out = [0] * bits
        for p, v in zip(places.tolist(), values.tolist()):
            one, b = 1 << p, 0
            while v:
                if v & 1:
                    out[b] |= one
                v >>= 1
                b += 1
        return out
    flat = np.zeros((bits, n), bool)
    flat[:, places] = values >> np.arange(bits)[:, None] & 1
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(flat, axis=1, bitorder="little")]


def _small(df: DataFrame, weight: Column, limit: int = 1_000_000) -> DataFrame:
    """To be broadcast if the weights of its rows (a few dozen bytes each) are at most ``limit`` together; else Spark joins by a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= limit else df


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", at_once: int = 128) -> DataFrame:
    """Per item its k documents of highest score above 0, equal scores by ascending id (null last): item, rank, doc_id, score.

    Items of null or termless text give no rows; of items equal in id and text one is
    answered; of an id with several texts each is, with ranks of its own. Items go in groups of about ``at_once``
    that a task holds together, and terms in as many rows as there are groups.
    """
    spark = items.sparkSession
    ship(spark)
    q = items.select(items[f"`{item_col}`"].alias("_item"), items[f"`{text_col}`"].cast("string").alias("_text")).distinct().where("_text is not null")
    groups = max(1, math.ceil(q.count() / at_once))
    q = q.withColumn("_group", F.pmod(F.xxhash64("_item", "_text"), F.lit(groups)))
    q = materialize(q.withColumn("_slot", F.row_number().over(Window.partitionBy("_group").orderBy("_item", "_text")) - 1), "items")
    held = q.select("_group", "_slot", F.explode(F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(TERM), F.lit(0))).alias("term")).groupBy("_group", "_slot", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = held.groupBy("_group", "term").agg(F.collect_list(F.struct("_slot", "tf")).alias("slots"))  # a group's items at most

    postings = index.rows.where("term is not null")
    asked = materialize(asked, "asked")
    df = postings.select("term", "df").join(_small(asked.select("term").distinct(), F.lit(1)), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    asked = materialize(asked.join(df.select("term", weight.alias("weight")), "term").where("weight > 0"), "weighted")

    nothing = F.lit(None)
    met = postings.join(_small(asked, F.size("slots") + 1), "term").select("block", "_group", "weight", "slots", "df", "places", "slices", nothing.cast(index.rows.schema["ids"].dataType).alias("ids"))
    every = index.rows.where("term is null").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    every = every.select("block", "_group", nothing.cast("long").alias("weight"), nothing.cast(asked.schema["slots"].dataType).alias("slots"), "df", "places", "slices", "ids")
    kinds = T.StructType([T.StructField("_group", T.LongType()), T.StructField("_slot", T.IntegerType()), T.StructField("doc_id", index.rows.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        head = g["ids"].notna()
        ids, n = g.loc[head, "ids"].iloc[0], int(g.loc[head, "df"].iloc[0])
        rows = g[~head]
        if rows.empty:
            return pd.DataFrame(columns=kinds.names)
        sums: dict[int, list[int]] = defaultdict(list)
        for w, x, df, where, raw in zip(rows["weight"], rows["slots"], rows["df"], rows["places"], rows["slices"]):
            values = unsliced(raw, int(df)) * int(w)
            places = np.frombuffer(where, "<u4").astype(np.int64)
            if not values.any():
                continue
            slices: dict[int, list[int]] = {}
            for s in x:
                tf = int(s["tf"])
                if tf not in slices:
                    slices[tf] = spread(places, values * tf, n)
                add_into(sums[s["_slot"]], slices[tf])
        group = int(g["_group"].iloc[0])
        return pd.DataFrame([(group, s, ids[p], score(item, p)) for s, item in sums.items() for p in best(item, k)], columns=kinds.names)

    top = met.unionByName(every).groupBy("block", "_group").applyInPandas(run, kinds)
    rank = F.row_number().over(Window.partitionBy("_group", "_slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = top.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(q.select("_group", "_slot", F.col("_item").alias(item_col)), ["_group", "_slot"]).select(item_col, "rank", "doc_id", "score")
