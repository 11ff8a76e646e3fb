"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with spaces to rows of 192, are the samples of an 8-bit
grey PNG image. Each task writes the images it has not yet written to tar shards, the
member's name being the payload's SHA-256. Rows carry digest, shard, offset and
length. Equal payloads of different tasks agree on one place by an aggregate over
digests; no payload is shuffled. Width and height come from a read of the header
bytes alone; features come from the stored samples read back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch, ship
from .files import filesystem

WIDTH = 192
#: Signature, IHDR with its length, name and checksum.
HEADER = 33


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter byte 0
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits from a PNG's first bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    w, h, depth = struct.unpack(">IIB", head[16:25])
    return w, h, depth


def decode_png(data: bytes) -> bytes:
    w, h, depth = header_of(data)
    if depth != 8:
        raise ValueError("8-bit samples only")
    at, parts = 8, []
    while at < len(data):
        n, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if name == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w + 1)
    if lines[:, 0].any():
        raise ValueError("unfiltered rows only")
    return lines[:, 1:].tobytes()


def features_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and entropy of the samples, and the mean of each quarter of the rows' length."""
    a = np.frombuffer(payload, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    mean = float(p @ np.arange(256))
    sd = float(p @ np.square(np.arange(256) - mean)) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    quarters = a.reshape(height, 4, width // 4).mean(axis=(0, 2), dtype=np.float64)
    return f"{width}x{height};mean={mean:.4f};sd={sd:.4f};entropy={entropy:.4f};quarters=" + ",".join(f"{x:.3f}" for x in quarters)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_mb: int = 64, folder: str | None = None) -> DataFrame:
    """Write payloads; per row of ``docs``: _id, n_bytes, digest (binary), and where this task put it: shard, offset, length.

    Null texts are empty; an empty payload is one row of spaces.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "media")
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, mark = filesystem(folder), uuid.uuid4().hex[:12]
        seen: dict[bytes, tuple[str, int, int]] = {}
        no, buf, tar, name = 0, None, None, ""

        def close():
            nonlocal buf, tar
            if tar:
                tar.close()
                fs.write(name, buf.getvalue())
                buf = tar = None

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out: list[list] = [[], [], [], [], []]
            for t in texts:
                t = t.as_py() or b""
                p = payload_of(t)
                d = hashlib.sha256(p).digest()
                if d not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    if tar is None:
                        buf, name, no = io.BytesIO(), f"media-{TaskContext.get().partitionId():06d}-{mark}-{no:04d}.tar", no + 1
                        tar = tarfile.open(fileobj=buf, mode="w", format=tarfile.USTAR_FORMAT)
                    m = encode_png(p)
                    info = tarfile.TarInfo(d.hex() + ".png")
                    info.size = len(m)
                    seen[d] = (name, buf.tell() + tarfile.BLOCKSIZE, len(m))
                    tar.addfile(info, io.BytesIO(m))
                    if buf.tell() >= shard_mb << 20:
                        close()
                for c, v in zip(out, (len(t), d, *seen[d])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())))], ["_id", "n_bytes", "digest", "shard", "offset", "length"])
        close()

    out = materialize(docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema), "media-rows")
    return out.withColumn("shard", F.concat(F.lit(folder + "/"), "shard"))


def places(rows: DataFrame) -> DataFrame:
    """One place per digest: the first by (shard, offset)."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def read_headers(at: DataFrame) -> DataFrame:
    """Per place: width, height, depth from the first bytes alone."""
    ship(at.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, offsets = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for s, group in _by_shard(shards, offsets):
                with _open(s) as f:
                    for i in group:
                        f.seek(offsets[i])
                        out.append((i, *header_of(f.read(HEADER))))
            out.sort()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.int32()) for k in (1, 2, 3))], ["digest", "width", "height", "depth"])

    return at.select("digest", "shard", "offset").mapInArrow(run, "digest binary, width int, height int, depth int")


def _by_shard(shards: list[str], offsets: list[int]) -> list[tuple[str, list[int]]]:
    groups: dict[str, list[int]] = {}
    for i in sorted(range(len(shards)), key=lambda i: (shards[i], offsets[i])):
        groups.setdefault(shards[i], []).append(i)
    return list(groups.items())


def _open(path: str):
    folder, _, name = path.rpartition("/")
    return filesystem(folder).open(name)


def read_media(at: DataFrame) -> DataFrame:
    """Per place, from the stored bytes: payload and media sizes and digests, tail checksum, feature."""
    ship(at.sparkSession)
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, shards, offsets, lengths = (b.column(i).to_pylist() for i in range(4))
            out = []
            for s, group in _by_shard(shards, offsets):
                with _open(s) as f:
                    for i in group:
                        f.seek(offsets[i])
                        media = f.read(lengths[i])
                        p = decode_png(media)
                        w, h, _ = header_of(media)
                        sha = hashlib.sha256(p)
                        if sha.digest() != digests[i]:
                            raise ValueError(f"{s} at {offsets[i]}: not the payload of its name")
                        out.append((digests[i], len(p), sha.hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), features_of(p, w, h)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return at.select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_mb: int = 64) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, what ``read_media`` finds, and shard, offset, length, width, height.

    Equal texts share one stored image and all values but the id. Null or repeated
    ids stay as they are; an empty table gives none.
    """
    rows = write_media(docs, id_col, text_col, shard_mb)
    at = materialize(places(rows), "media-places")
    back = read_media(at).join(read_headers(at).drop("depth"), "digest").join(at, "digest")
    out = rows.select("_id", "n_bytes", "digest").join(back, "digest")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.regexp_extract("shard", "[^/]*$", 0).alias("shard"), "offset", "length", "width", "height")
