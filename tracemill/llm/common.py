"""Helpers shared by the corpus operators: folds, batches of rows, files in the shared folder."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.session import durable, shared_folder

# Rows that a worker unpacks at a time end at this many bytes of text.
BLOCK_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; NULL for a NULL key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def in_fold(key: str | Column, folds: int, which: int) -> Column:
    """Whether the key is in a fold; false for a NULL key."""
    return F.coalesce(fold(key, folds) == which, F.lit(False))


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together; one row at least each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def map_blocks(
    df: DataFrame,
    keys: list[str],
    text: str,
    schema: T.StructType,
    start: Callable[[], Callable[[list], dict]],
    limit: int = BLOCK_BYTES,
    end: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Adds columns that a Python function computes from a text column.

    ``start`` runs once per task and returns a function from a list of texts (None for NULL) to a
    dict of columns. Only ``keys`` and the text travel; ``keys`` are returned beside the new columns. ``end``
    runs when the task is done.
    """
    source = df.select(*keys, F.col(text).cast("string").alias("__text"))
    full = T.StructType([source.schema[k] for k in keys] + list(schema))

    def run(batches):
        work = start()
        try:
            for batch in batches:
                for block in text_blocks(batch, "__text", limit):
                    found = work(block.column("__text").to_pylist())
                    columns = [block.column(k) for k in keys]
                    columns += [
                        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c)
                        for c in (found[f.name] for f in schema)
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[f.name for f in schema]])
        finally:
            del work
            end()

    return source.mapInArrow(run, full)


def release_memory() -> None:
    """Gives what a task has freed back to the system: Python workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:  # glibc only
        trim(0)


def text_function(
    schema: T.StructType, start: Callable[[], Callable[..., dict]], end: Callable[[], None] = lambda: None, limit: int = BLOCK_BYTES
) -> Callable[..., Column]:
    """A function of columns, the first a text, whose result is a struct of ``schema``.

    ``start`` runs once per task and returns a function from lists of values (None for NULL) to a dict of
    columns. Only these columns go to Python and only the result comes back; all others stay in Spark.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = start()
        try:
            for columns in batches:
                columns = [columns] if isinstance(columns, pa.Array) else list(columns)  # a single column comes bare
                batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
                parts = []
                for block in text_blocks(batch, "0", limit):
                    found = work(*[c.to_pylist() for c in block.columns])
                    parts.append(pa.StructArray.from_arrays([pa.array(found[f.name], to_arrow_type(f.dataType)) for f in schema], names=schema.names))
                yield pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(schema))
        finally:
            end()
            release_memory()

    # The type hints are read by Spark; written out, since annotations are strings in this module.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # Not to be evaluated again where the result is filtered.
    return arrow_udf(schema)(run).asNondeterministic()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores in front as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Adds a struct that tells every row from every other one, the same whenever the table is read.

    It is the row's file and place. Rows that do not come straight from files are stored first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(name, place)
    except AnalysisException:
        return durable(df).withColumn(name, place)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pyarrow.fs.FileSystem.from_uri(uri)
