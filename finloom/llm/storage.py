"""Folders in the shared checkpoint place, tables written there to cut lineage, and what Python workers hold."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, else under the context's checkpoint folder.

    Where neither is set, a session whose executors are threads of this process (tests) gets a folder of this machine;
    on a cluster that would be another folder on each executor, so ValueError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it survives lost executors, and later reads don't compute df again.

    For this one write, Spark is told to drop the shuffle files that led to the table once it is there.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    held = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which users size to their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_column(carry: bool) -> list[Column]:
    """All columns of a row in one, row, if they are to be carried through an operator."""
    return [F.struct("*").alias("row")] if carry else []


def with_row(schema: str, docs: DataFrame, carry: bool) -> StructType:
    """The schema of an operator's result, with row if that is carried."""
    out = StructType.fromDDL(schema)
    return out.add("row", docs.schema) if carry else out


_HELD: dict[Hashable, object] = {}


def worker_held(key: Hashable, make: Callable[[], object]):
    """What make() gives for key: made once in a Python worker and kept until something else is asked for, or until the
    worker runs another function of of_batches(), of_group() or of_groups(). So a worker that Spark uses for one operator
    after the other holds the tables of one at most."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: Rows of text that Spark hands to a Python worker at once. Its default, 10,000 rows or 64 MB, is held several times in
#: buffers outside the heap, which executors with little memory beside it can't spare.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """For the queries and the pipeline, not for operators: bounds the session's Arrow batches to BATCH_ROWS rows. Spark
    reads this setting when a result is written, so it can't be given back before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_RUNS: list[str] = []


def _begun(f: Callable) -> None:
    """Forgets what another function than f has left in this worker, and gives its memory back to the machine."""
    name = f"{f.__module__}.{f.__qualname__}"
    if _RUNS != [name]:
        _RUNS[:] = [name]
        _HELD.clear()
        _given_back(None)


def _given_back(result):
    """result, after what this worker has freed went back to the machine: a worker waits for its next task, maybe of another
    operator, with little memory."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    return result


def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one: freed Python objects and numpy arrays stay with the worker without it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


_TRIM = _trim()


def of_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f, for applyInArrow, giving memory back after each group."""

    def group_of(table: pa.Table) -> pa.Table:
        _begun(f)
        return _given_back(f(table))

    return group_of


def of_groups(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """f, for applyInArrow on two groups, giving memory back after each pair."""

    def groups_of(table: pa.Table, other: pa.Table) -> pa.Table:
        _begun(f)
        return _given_back(f(table, other))

    return groups_of


def of_batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, giving memory back after a task's batches."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begun(f)
        yield from f(batches)
        _given_back(None)

    return batches_of
