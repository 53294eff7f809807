"""Artifacts from files, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.functions import magic

#: Largest input in bytes; a BINARY cell holds less than 2 GiB.
MOST = (1 << 31) - (1 << 20)


def artifacts(spark: SparkSession, path: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Files under a path as (path, length, content), and the ones over the limit as (path, length).

    The limit is a filter on the file listing, so larger files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select("path", "length", "content"), files.where(F.col("length") > most).select("path", "length")


def stream(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """New files under a path as a stream of (path, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).where(F.col("length") <= most).select("path", "length", "content")


def detected(files: DataFrame) -> DataFrame:
    """Adds format, hint and whether the format is understood."""
    f = magic.detect(F.col("content"))
    return files.withColumns({"format": f, "hint": magic.hint(F.col("content")), "understood": magic.understood(f)})


def report(rows: DataFrame, record: str) -> DataFrame:
    """Adds the record as a line of JSON."""
    return rows.withColumn("line", F.to_json(record))


def write_report(rows: DataFrame, path: str, replace: bool = False) -> None:
    """JSON lines; an existing report is kept unless it shall be replaced (Spark's committer makes either atomic)."""
    rows.write.mode("overwrite" if replace else "errorifexists").json(path)
