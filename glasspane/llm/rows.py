"""Row-wise Arrow stages that keep a table's own columns, and tables written on the way to a result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_columns(
    df: DataFrame, new: T.StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """Adds the columns ``new``, computed from each Arrow batch, to every row.

    Rows keep their number and order inside a partition, so repeated rows and
    repeated ids stay apart and no join is needed. A column of ``df`` with the
    name of a new one is replaced.
    """
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, *new])
    kept_names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = [batch.schema.names.index(n) for n in kept_names]
                columns = [batch.column(i) for i in at] + compute(batch)
                yield pa.RecordBatch.from_arrays(columns, names=kept_names + [f.name for f in new])

    return df.mapInArrow(run, schema)


_OWN: dict[str, str] = {}  # application: folder of this process, for local sessions alone


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A session with a local master that names none gets a folder of this
    process; anywhere else a missing setting is an error, since executors would
    write to folders that others cannot read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="glasspane-")
    return _OWN[sc.applicationId]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the session ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``saved`` or ``Scratch`` wrote."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it again: cuts lineage, survives lost executors.

    The table is there until the session ends or ``discard`` is called.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that ``saved`` returned; others are left alone."""
    path = getattr(df, "_saved_at", None)
    if path:
        delete(df.sparkSession, path)


class Scratch:
    """Tables written on the way to a result, which are deleted when they or the whole are done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        files, where = _file_system(spark, self.folder)
        files.mkdirs(where)
        files.deleteOnExit(where)  # also where a run fails before its end

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        return out

    def finish(self, result: DataFrame, name: str) -> DataFrame:
        """Writes the result outside the scratch folder and deletes that."""
        out = saved(result, name)
        self.close()
        return out

    def close(self) -> None:
        delete(self.spark, self.folder)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Bounds the bytes of the Arrow batches that jobs started inside hand to Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
