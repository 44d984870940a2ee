"""What the operators share: the cluster's shared folder, Arrow batching and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at once; scratch arrays are some ten times as large.
PIECE_BYTES = 1 << 21
#: Bytes of an Arrow batch between the JVM and Python; rows are long texts, so the row count alone is no bound.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tallygraph-"))
        return context._jsc.sc().getCheckpointDir().get()
    return folder


_temporary: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str, *, lasting: bool = False) -> str:
    """A new path in the shared folder. Within temporary_tables what is written there goes with the other tables unless it is lasting."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _temporary and not lasting:
        _temporary[-1].append(path)
    return path


def written(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them again.

    The table outlives lost executors. Within temporary_tables it goes with the others unless it is lasting; else the folder's owner clears it, as with checkpoints.
    """
    path = fresh_path(df.sparkSession, name, lasting=lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end: what is built on them must have been written as lasting by then."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_held: list = [None, None]


def machine(key: tuple, make: Callable[[], object] = lambda: None) -> object:
    """What a Python worker keeps between tasks: the latest operator's tables only, so that operators in turn don't add up."""
    if _held[0] != key:
        _held[:] = None, None
        _held[:] = key, make()
    return _held[1]


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already asks for less.

    The setting holds until the session is told otherwise, since rows are computed when the caller asks for them. It may
    be any size that Spark reads, such as 64m.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(lengths: list[int], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Split consecutive rows into ranges of about limit bytes; a longer row gets a range of its own."""
    first, held = 0, 0
    for at, n in enumerate(lengths):
        if held and held + n > limit:
            yield first, at
            first, held = at, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the schema's types from lists, arrays or numpy arrays."""
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))
