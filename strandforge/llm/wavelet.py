"""Token ids in wavelet-matrix shards: write, read back, count, locate.

A shard holds the ids of a run of documents in ascending id order as bit planes,
highest bit first. In each plane the ids whose bit is 0 come first in the next one.
With the number of ones up to every 512th bit, rank and select cost a few popcounts:
access, counting and occurrence lookup need no decoding.

Texts are encoded where they are read; only packed ids are shuffled. Documents are cut
into buckets by (id, packed ids), at bounds taken from a sample, so many rows of one id
spread too. A bucket is sorted and cut into shards of about ``shard_ids`` ids, so memory
is bounded by a shard, not by a bucket.

File: magic ``WVM2``, then little-endian longs: ids, documents, planes; per document
its number of ids; per plane the number of zeros (long), the bits (64-bit words) and the
ranks (32 bits).
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize, scratch, ship
from .encoding import encoder, runs
from .files import filesystem
from .hashing import mix

MAGIC = b"WVM2\0\0\0\0"
BLOCK = 512


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks, x = [], [], [], ids
        for b in range(bits - 1, -1, -1):
            on = (x >> x.dtype.type(b)) & x.dtype.type(1) != 0
            words = np.zeros((len(x) // 512 + 1) * 64, np.uint8)
            packed = np.packbits(on, bitorder="little")
            words[: len(packed)] = packed
            words = words.view("<u8")
            planes.append(words)
            ranks.append(np.r_[0, np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.int64))].astype("<u4"))
            zeros.append(len(x) - int(ranks[-1][-1]))
            # By places, not masks: bits are as good as random, and masks branch on each.
            x = np.concatenate([x[np.flatnonzero(~on)], x[np.flatnonzero(on)]])
        return cls(len(ids), zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        return b"".join(x for z, p, r in zip(self.zeros, self.planes, self.ranks) for x in (np.int64(z).tobytes(), p.tobytes(), r.tobytes()))

    @classmethod
    def from_bytes(cls, data: memoryview, n: int, bits: int) -> WaveletMatrix:
        zeros, planes, ranks, at, blocks = [], [], [], 0, n // 512 + 1
        for _ in range(bits):
            zeros.append(int(np.frombuffer(data, "<i8", 1, at)[0]))
            planes.append(np.frombuffer(data, "<u8", blocks * 8, at + 8))
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at + 8 + blocks * 64))
            at += 8 + blocks * 64 + (blocks + 1) * 4
        return cls(n, zeros, planes, ranks)

    def _ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        words, block = self.planes[plane], i >> 9
        out, word = self.ranks[plane][block].astype(np.int64), i >> 6
        for k in range(7):
            at = block * 8 + k
            out = out + np.where(at < word, np.bitwise_count(words[np.minimum(at, len(words) - 1)]), 0)
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[np.minimum(word, len(words) - 1)] & mask)

    def access(self, i) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64)).copy()
        out = np.zeros(len(i), np.int64)
        for p in range(len(self.planes)):
            on = (self.planes[p][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._ones(p, i)
            out = out * 2 + on
            i = np.where(on, self.zeros[p] + ones, i - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        b = len(self.planes)
        for p in range(b):
            r = self._ones(p, np.array([lo, hi]))
            lo, hi = (self.zeros[p] + int(r[0]), self.zeros[p] + int(r[1])) if token >> (b - 1 - p) & 1 else (lo - int(r[0]), hi - int(r[1]))
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of a plane: block by its rank, word by popcounts, then the bit."""
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = np.searchsorted(before, k, side="right") - 1
        words = self.planes[plane].reshape(-1, 8)[block]
        words = words if bit else ~words
        until = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = k - before[block]
        word = (until <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, until[row, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(1)

    def locate(self, token: int, at_once: int = 1 << 16) -> np.ndarray:
        """All positions of a token, ascending: back up the planes by select."""
        if token >> len(self.planes):
            return np.empty(0, np.int64)
        a, b = self._range(token, 0, self.n)
        out = []
        for i in range(a, b, at_once):
            at = np.arange(i, min(b, i + at_once))
            for p in range(len(self.planes) - 1, -1, -1):
                bit = token >> (len(self.planes) - 1 - p) & 1
                at = self._select(p, bit, at - self.zeros[p] * bit)
            out.append(at)
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: two copies by places a plane."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k, p in enumerate(range(len(self.planes) - 1, -1, -1)):
            on = np.unpackbits(self.planes[p].view(np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~on)], y[np.flatnonzero(on)] = x[: self.zeros[p]], x[self.zeros[p] :] | kind(1 << k)
            x = y
        return x


def shard_bytes(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    return MAGIC + np.array([len(ids), len(lengths), bits], "<i8").tobytes() + lengths.astype("<i8").tobytes() + WaveletMatrix.build(ids, bits).to_bytes()


def read_shard(data: bytes) -> tuple[np.ndarray, WaveletMatrix]:
    """Ids per document, and the matrix."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    n, docs, bits = (int(x) for x in np.frombuffer(data, "<i8", 3, 8))
    return np.frombuffer(data, "<i8", docs, 32), WaveletMatrix.from_bytes(memoryview(data)[32 + 8 * docs :], n, bits)


def _key(id, ids: bytes, u: int) -> tuple:
    """Null ids first, then by id, then by packed ids; ``u`` spreads rows that are equal in both."""
    return (id is not None, id if id is not None else 0, ids, u)


def _bounds(rows: DataFrame, encoded, schema: T.StructType, n: int, buckets: int) -> list[tuple]:
    """At most ``buckets`` - 1 keys that cut the documents about evenly, from a sample of 64 rows a bucket, 262144 rows at most: ids and the heads of their packed ids."""
    most = min(64 * buckets, 1 << 18)
    part = rows if n <= most else rows.sample(most / n, seed=7)
    got = part.mapInArrow(encoded, schema).select("_id", F.substring("_ids", 1, 64).alias("_ids"), "_u", F.length("_ids").alias("_n")).collect()
    keys = sorted((_key(d, bytes(x), u), size) for d, x, u, size in got)
    until = np.cumsum([size + 64 for _, size in keys])
    return sorted({keys[k][0] for k in np.searchsorted(until, until[-1] / buckets * np.arange(1, buckets))}) if keys else []


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 4_000_000, bucket_mb: int = 32, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts; one row per shard: path, order (a struct), ids (list of document ids), n_ids.

    Documents go in ascending id order, null ids first, ties by their ids as bytes. A
    null text counts as empty. ``end_id`` ends each document. Buckets hold about
    ``bucket_mb`` of text, and are 65536 at most, beyond which they grow; what a task holds is a shard. A retried task writes files of other
    names, and only those of the attempt that ended are listed.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "wavelet")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            for i, texts in runs(b.column(1)):
                u = (mix(np.arange(row, row + len(texts)).astype(np.uint64)) >> np.uint64(33)).astype(np.int32)
                row += len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), pa.array(enc.encode(texts), pa.binary()), pa.array(u)], ["_id", "_ids", "_u"])

    packed = [T.StructField("_id", id_type), T.StructField("_ids", T.BinaryType())]
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    buckets = int(min(65536, max(spark.sparkContext.defaultParallelism, total // (bucket_mb << 20) + 1)))
    bounds = _bounds(rows, encoded, T.StructType([*packed, T.StructField("_u", T.IntegerType())]), n, buckets)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encoded(batches):
            to = [bisect_right(bounds, _key(*k)) for k in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *b.columns[:2]], ["_bucket", "_id", "_ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs = encoder(tokenizer), filesystem(folder)
        bits = max(1, max(enc.size - 1, end_id or 0).bit_length())
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        mark, held, ids, bucket, no, size, kind = uuid.uuid4().hex[:12], [], [], None, 0, 0, None

        def flush():
            nonlocal held, ids, no, size
            lengths = np.array([len(x) // enc.dtype.itemsize for x in held], np.int64)
            name = f"part-{bucket:06d}-{mark}-{no:05d}.wvm"
            fs.write(name, shard_bytes(np.frombuffer(b"".join(held), enc.dtype), lengths, bits))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bucket], pa.int32()), pa.array([no], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([int(lengths.sum())])], ["path", "part", "no", "ids", "n_ids"])
            held, ids, no, size = [], [], no + 1, 0
            return row

        for b in batches:
            kind = b.schema.field(1).type
            for k, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != bucket:
                    if held:
                        yield flush()
                    bucket, no = k, 0
                held.append(x.as_py() + end)
                ids.append(d)
                size += len(held[-1]) // enc.dtype.itemsize
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    to = rows.mapInArrow(dealt, T.StructType([T.StructField("_bucket", T.IntegerType()), *packed])).repartitionById(buckets, "_bucket")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_ids", T.LongType())])
    out = materialize(to.sortWithinPartitions("_bucket", "_id", "_ids").mapInArrow(write, schema), "wavelet-index")
    return out.withColumn("path", F.concat(F.lit(folder + "/"), F.col("path")))


def read_shards(index: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = index.sparkSession
    ship(spark)
    # One row per shard: their running sum is small whatever the corpus.
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = index.select("path", "part", "no", "n_ids").withColumn("before", before).select("path", "before")
    rows = index.select("path", "ids").join(starts, "path")
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_name, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ids, before in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                folder, _, name = path.rpartition("/")
                lengths, matrix = read_shard(filesystem(folder).read(name))
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                at = np.r_[0, np.cumsum(lengths)]
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.values if hasattr(ids, "values") else pa.array(ids), pa.array(at[:-1] + before), pa.array(lengths), pa.array(crc, pa.int64())], [id_name, "start", "n_tokens", "ids_crc32"])

    # A number of its own, or the few bytes of the paths would be read by one task.
    return rows.repartition(max(1, min(65536, index.count())), "path").mapInArrow(run, schema)
