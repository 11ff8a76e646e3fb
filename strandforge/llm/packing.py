"""Best-fit packing with a fixed number of open bins.

Pieces arrive in partitions, in runs of up to 512 documents, the longest of a run first;
each task keeps at most ``open_bins`` sequences open.
Open bins sit in stacks by free space, and a bitset over free space finds the
tightest that fits in one shift and one lowest-bit step. When all bins are taken,
the fullest closes. What is still open when a task ends goes, piece by piece, to a
second round with a fraction of the tasks, and so on until one task is left, so that
half-empty sequences do not grow with the number of input partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from .encoding import encoder, runs


class BestFit:
    """Bins of one capacity, at most ``open_bins`` open. add() returns the bins that close."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free
        self.bins: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def _pop(self, free: int) -> list:
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n -= 1
        return b

    def add(self, item, length: int) -> list[list]:
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            if self.n >= self.most:
                low = (self.bits & -self.bits).bit_length() - 1
                closed.append(self._pop(low))
            free, b = self.capacity, []
        b.append((item, self.capacity - free))
        free -= length
        if free == 0:
            closed.append(b)
        else:
            self.bins[free].append(b)
            self.bits |= 1 << free
            self.n += 1
        return closed

    def rest(self) -> list[list]:
        return [b for free in self.bins for b in free]


def _emit(schema: pa.Schema, closed: list[list], first: int, final: bool) -> pa.RecordBatch:
    """Rows of (id, piece, start, length, crc) with sequence and offset."""
    cols = [[], [], [], [], [], [], [], []]
    for i, b in enumerate(closed):
        for item, at in b:
            for c, v in zip(cols, (*item, first + i, at, final)):
                c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


NAMES = ["_id", "_piece", "_start", "_length", "_crc", "_sequence", "_offset", "_final"]


def _packed(batches: Iterator[tuple[list, ...]], schema: pa.Schema, capacity: int, open_bins: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack items (id, piece, start, length, crc) of each batch, longest first."""
    first = (level << 56) | (TaskContext.get().partitionId() << 36)
    fit, n = BestFit(capacity, open_bins), 0
    for items in batches:
        closed = []
        for item in sorted(items, key=lambda x: -x[3]):
            closed += fit.add(item, item[3])
        if closed:
            yield _emit(schema, closed, first + n, True)
            n += len(closed)
    # Fuller than 31/32 is final; the others meet in the next round.
    rest = fit.rest()
    full = [b for b in rest if last or b[-1][1] + b[-1][0][3] >= capacity - capacity // 32]
    done = set(map(id, full))
    yield _emit(schema, full, first + n, True)
    yield _emit(schema, [b for b in rest if id(b) not in done], 0, False)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 512, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and ``end_id`` (a null or empty text:
    ``end_id`` alone). Longer ones than ``capacity`` are cut into pieces of it, the last
    one shorter. Null and repeated ids are kept as they are; an empty table gives none.
    Columns of other names are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    types = [docs.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(NAMES, types)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)

        def pieces():
            for b in batches:
                for i, texts in runs(b.column(1)):
                    items = []
                    for d, x in zip(b.column(0).slice(i, len(texts)).to_pylist(), enc.encode(texts)):
                        raw = np.r_[np.frombuffer(x, enc.dtype).astype("<u4"), np.array([end_id], "<u4")].tobytes()
                        n = len(raw) // 4
                        for k, at in enumerate(range(0, n, capacity)):
                            to = min(n, at + capacity)
                            items.append((d, k, at, to - at, zlib.crc32(memoryview(raw)[4 * at : 4 * to])))
                    yield items

        yield from _packed(pieces(), arrow, capacity, open_bins, 0, False)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = (list(zip(*(b.column(i).to_pylist() for i in range(5)))) for b in batches)
            yield from _packed(items, arrow, capacity, open_bins, level, last)

        return run

    step = materialize(docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(first, schema), "pack-0")
    out, level = step.where("_final"), 0
    # Not the input's plan, which may still have shuffles to run: the first step's files.
    tasks = max(1, len(step.inputFiles()))
    while True:
        tasks, level = -(-tasks // fan_in), level + 1
        last = tasks == 1
        # A task's left-over pieces are at most what its open bins hold.
        left = step.where("not _final").select("_id", "_piece", "_start", "_length", "_crc").repartition(tasks)
        step = materialize(left.mapInArrow(again(level, last), schema), f"pack-{level}")
        out = out.unionByName(step.where("_final"))
        if last:
            break
    return out.select(F.col("_id").alias(id_col), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_crc").alias("ids_crc32"), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))
