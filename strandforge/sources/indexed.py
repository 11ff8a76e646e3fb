"""Sorted call files with an index: records in position order, in blocks that are compressed one by one.

A block is a gzip member that states its length, so the files are block-wise gzip, which any
reader of VCF opens. The index has a row a block: file, offset, length, chromosome, first and
last base that its records touch. A query for regions joins them with the index and opens
only the blocks that they meet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import range_join
from ..session import ship
from .records import store_of

#: Bytes of text in a block; a stated length has 16 bits, so a block is smaller than 64 kB when compressed.
BLOCK = 60_000
#: The empty block at the end of a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    """A gzip member with its length in the header. Data that does not get smaller is stored."""
    body = b""
    for level in (6, 0):
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        if len(body) + 25 < 1 << 16:
            break
    else:
        raise ValueError("a block is too large")
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_indexed(records: DataFrame, path: str, header: str | None = None, room: int = BLOCK) -> DataFrame:
    """Write records (chrom, pos, last: 0-based and closed; line) in order of (chrom, pos, line); returns the index.

    Rows are range-sorted, each task writes one file, and a block is of one chromosome. A line
    longer than a block takes several, which are one row of the index. ``header`` opens the first file.
    """
    spark = records.sparkSession
    ship(spark)
    order = ["chrom", "pos", "line"]
    d = records.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("last").cast("long").alias("last"), "line").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        name, out = f"part-{at:08d}-{uuid.uuid4().hex[:12]}.vcf.gz", None
        store, base = store_of(path)
        store.create_dir(f"{base}/blocks", recursive=True)
        held, size, chrom, low, high, place = [], 0, None, 0, 0, 0

        def close() -> tuple:
            nonlocal held, size, place
            data, start, n = b"".join(held), place, len(held)
            for i in range(0, len(data), room):
                b = block(data[i : i + room])
                out.write(b)
                place += len(b)
            held, size = [], 0
            return name, at, start, place - start, chrom, low, high, n

        columns = ["file", "part", "offset", "length", "chrom", "low", "high", "n"]
        for b in batches:
            done = []
            for c, p, z, line in zip(b["chrom"], b["pos"], b["last"], b["line"]):
                raw = line.encode() + b"\n"
                if out is None:
                    out = store.open_output_stream(f"{base}/blocks/{name}", compression=None)
                    if header is not None and at == 0:
                        first = block((header.rstrip("\n") + "\n").encode())
                        out.write(first)
                        place = len(first)
                if held and (c != chrom or size + len(raw) > room):
                    done.append(close())
                if not held:
                    chrom, low, high = c, p, z
                high = max(high, z)
                held.append(raw)
                size += len(raw)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if held:
            yield pd.DataFrame([close()], columns=columns)
        if out is not None:
            out.write(END)
            out.close()

    index = d.mapInPandas(run, "file string, part int, offset long, length long, chrom string, low long, high long, n long")
    index.write.mode("overwrite").parquet(f"{path}/index")
    index = read_index(spark, path)
    # What failed attempts or an earlier run left is in no row of the index: a file a task.
    store, base = store_of(path)
    named = {r[0] for r in index.select("file").distinct().collect()}
    for x in store.get_file_info(pafs.FileSelector(f"{base}/blocks", allow_not_found=True)):
        if x.base_name not in named:
            store.delete_file(x.path)
    return index


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def blocks_of(index: DataFrame, regions: DataFrame) -> DataFrame:
    """region, lo, hi, and the blocks that each region (region, chrom, lo, hi: closed) meets."""
    r = regions.select("region", "chrom", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return range_join(r, index, ["chrom"], ("lo", "hi"), ("low", "high"))


def read_regions(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """region, line: the records that touch each region. A block is opened once for all regions that meet it, and others not at all."""
    ship(spark)
    met = blocks_of(read_index(spark, path), regions)
    jobs = met.groupBy("file", "offset", "length", "chrom").agg(F.collect_list(F.struct("region", "lo", "hi")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_of(path)
        for b in batches:
            for file, offset, length, asked in zip(b["file"], b["offset"], b["length"], b["asked"]):
                with store.open_input_file(f"{base}/blocks/{file}") as f:
                    f.seek(offset)
                    raw, text = f.read(length), b""
                while raw:
                    d = zlib.decompressobj(31)
                    text += d.decompress(raw)
                    raw = d.unused_data
                yield pd.DataFrame([(r["region"], r["lo"], r["hi"], line) for line in text.decode().split("\n")[:-1] for r in asked], columns=["region", "lo", "hi", "line"])

    kind = regions.schema["region"].dataType.simpleString()
    found = jobs.select("file", "offset", "length", "asked").mapInPandas(run, f"region {kind}, lo long, hi long, line string")
    p = F.split("line", "\t")
    pos = p[1].cast("long") - 1
    end = F.coalesce(F.nullif(F.regexp_extract(p[7], "(^|;)END=([0-9]+)", 2), F.lit("")).cast("long") - 1, pos)
    return found.where((pos <= F.col("hi")) & (F.greatest(end, pos) >= F.col("lo"))).select("region", "line")
