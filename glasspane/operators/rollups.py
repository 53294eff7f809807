"""Roll-ups of verdicts, listings and outcomes; longest-prefix mounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def batch_rollup(verdicts: DataFrame, batch: str) -> DataFrame:
    """Of each batch: files, clean ones, conspicuous ones; a decision is needed if any is conspicuous."""
    got = verdicts.groupBy(batch).agg(F.count("*").alias("files"), F.count_if(F.col("verdict") == "confirmed").alias("complete"), F.count_if(F.col("verdict") != "confirmed").alias("conspicuous"))
    return got.withColumn("decide", F.col("conspicuous") > 0)


def conspicuous(verdicts: DataFrame) -> DataFrame:
    """The files of every batch that need a look, each in a row of its own however many they are."""
    return verdicts.where(~F.coalesce(F.col("verdict") == "confirmed", F.lit(False)))


def tree_preview(entries: DataFrame) -> DataFrame:
    """Files, their bytes, directories and skipped links below every directory, at any depth, from (path, kind, bytes).

    Entries are summed by their own directory first, so what is copied to the
    directories above is one row for each directory.
    """
    count = lambda kind: F.count_if(F.col("kind") == kind)
    sizes = F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("bytes"))), F.lit(0))
    inside = entries.where(F.contains("path", F.lit("/"))).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"))
    own = inside.agg(count("file").alias("files"), sizes.alias("bytes"), count("dir").alias("dirs"), count("link").alias("links"))
    parts = F.split("parent", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = own.withColumn("directory", F.explode(above))
    return spread.groupBy("directory").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "dirs", "links")])


def directory_preview(files: DataFrame, path: str, size: str) -> DataFrame:
    """Files and bytes of each directory."""
    return files.groupBy(F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def outcomes(results: DataFrame, batch: str) -> DataFrame:
    """Successes, failures and the distinct warnings in first-seen order, from (batch, ord, ok, warning)."""
    first = results.where("warning is not null").groupBy(batch, "warning").agg(F.min("ord").alias("ord"))
    said = first.groupBy(batch).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda x: x["warning"]), ",").alias("warnings"))
    counts = results.groupBy(batch).agg(F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return counts.join(said, batch, "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def longest_mount(paths: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """For each distinct path the mount that is its longest plain prefix (no path boundary), by equality of prefixes.

    The lengths that occur among the mounts are few and come to the driver; a
    path is joined once for each of them instead of being compared with every mount.
    """
    lengths = [r["n"] for r in mounts.select(F.length("mount").alias("n")).distinct().limit(4097).collect()]
    if len(lengths) > 4096:
        raise ValueError("mounts of more than 4096 different lengths")
    fits = F.filter(F.lit(sorted(lengths) or [0]), lambda n: n <= F.length(path))
    keyed = paths.select(path).distinct().withColumn("_n", F.explode_outer(fits)).withColumn("mount", F.left(F.col(path), F.col("_n")))
    got = keyed.join(mounts, "mount", "left").withColumn("_n", F.when(F.col("fstype").isNotNull(), F.col("_n")))
    best = got.groupBy(path).agg(F.max_by(F.struct("mount", "fstype"), "_n").alias("m"))
    return best.select(path, F.col("m.mount").alias("mount"), F.col("m.fstype").alias("fstype"))


def free_names(names: DataFrame, name: str = "name", order: str = "ord", directory: str = "directory") -> DataFrame:
    """Repeated names of a directory get " (2)", " (3)" … before the extension, in order."""
    k = F.row_number().over(W.partitionBy(directory, name).orderBy(order))
    stem, tail = F.regexp_extract(name, r"^(.+?)(\.[^.]+)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]+)?$", 2)
    return names.withColumn("_k", k).withColumn("free_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), tail))).drop("_k")
