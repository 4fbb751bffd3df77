"""Intermediate tables in the folder that all executors share, and who deletes them."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Where the shared folder is when a local session names none; local masters only.
LOCAL = "file:///tmp/checkpoints/recscan"


class _Paths(threading.local):
    """Scratch tables that this thread wrote and that are not deleted yet, in that order."""

    def __init__(self) -> None:
        self.written: list[str] = []


_paths = _Paths()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder for local masters; a cluster session must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one table below the shared folder."""
    return f"{shared_dir(spark)}/recscan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, it is computed once, and survives lost executors.

    It is deleted at the end of the :func:`scratch` it was written within, or by :func:`drop`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _paths.written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input files, compressed, for which a task of :func:`dealt` is planned: some 200,000 to 400,000 narrow rows.
TASK_BYTES = 4_000_000
#: What Spark plans with where a source does not tell its size is far more than this.
UNKNOWN_BYTES = 1 << 60
#: At most so many tasks; a larger share than planned spills.
MAX_TASKS = 20_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by keys to tasks whose number grows with its input files, so that what one task sorts stays the same.

    Where sources do not tell their size the session's number of shuffle partitions holds.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        return df.repartition(*keys)
    return df.repartition(min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))), *keys)


def last_written() -> str:
    """Path of the table that :func:`written` wrote last."""
    return _paths.written[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _paths.written:
        _paths.written.remove(path)


def drop(table: DataFrame) -> None:
    """Delete what :func:`written` wrote; nothing may read it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        mine = [p for p in _paths.written if p.rsplit("/", 1)[-1] == parent.rsplit("/", 1)[-1]]
        drop_path(table.sparkSession, mine[0] if mine else parent)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the scratch tables this thread wrote within, but for those whose paths are put into the list.

    What is lazy and reads them must be written, or done with, before the end.
    """
    mark, kept = len(_paths.written), []
    yield kept
    for path in [p for p in _paths.written[mark:] if p not in kept]:
        drop_path(spark, path)
