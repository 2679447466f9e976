"""Session settings and durable cuts of long lineages."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package is tuned for.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A block of a few kilobytes of symbols unfolds to many n-grams: do not merge small
    # shuffle partitions while cores are free.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Rows up to which a side that is already stored may be broadcast.
BROADCAST_ROWS = 200_000

# Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 32 << 20


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracemill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tracemill-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Used where rows must not change between two reads (row ids), for tables that are read
    several times, and to keep the plans of driver loops short. The stored table has its true
    size, so the planner's own broadcast limit applies to it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``durable`` has stored and that nothing reads any more; others are left alone."""
    for table in tables:
        where = getattr(table, "stored_at", None)
        if where:
            sc = table.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI, for single files that workers read; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that go to Python: a few thousand rows with long arrays are gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a *stored* table for broadcast when it has at most ``limit`` rows.

    Above the limit the table is returned as it is and the join shuffles.
    """
    within = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if within else df
