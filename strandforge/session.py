"""Session helpers: the local session, the shared folder, and shipping the package to executors."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only where that is unset (one machine, as in tests)."""
    conf = spark.sparkContext.getConf()
    if given := conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="strandforge-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one. The driver's file system deletes it, with all that failed attempts left in it, when the driver ends; ``clean`` does so before."""
    context = spark.sparkContext
    if not getattr(context, "_strandforge_run", None):
        path = f"{shared_dir(spark)}/strandforge/{context.applicationId}-{uuid.uuid4().hex[:8]}"
        fs, at = _file_system(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        context._strandforge_run = path
    return context._strandforge_run


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. DataFrames that read it can't be used any more; the next one starts a new folder."""
    context = spark.sparkContext
    if path := getattr(context, "_strandforge_run", None):
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        context._strandforge_run = None


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``run_dir``, for what a plan writes and reads again. Results that are to stay need a path of their own."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to Python, where the context sets none: rows may hold long texts, and a worker holds several batches.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a context, so that they need no copy on their path, and bound the session's batches by bytes."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH[0]):
        spark.conf.set(BATCH[0], str(BATCH[1]))
    if getattr(context, "_strandforge_shipped", False):
        return
    files = sorted(PACKAGE.rglob("*.py"))
    mark = hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    folder = tempfile.mkdtemp(prefix="strandforge-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, f"strandforge_{mark}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in files:
            z.write(p, f"strandforge/{p.relative_to(PACKAGE)}")
    context.addPyFile(out)
    context._strandforge_shipped = True
