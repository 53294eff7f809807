"""Deletes later copies of repeated runs of lines, by DataFrame functions alone.

The corpus is one sequence of line ids, document after document (by doc_id).
Its suffix array is made by prefix doubling: each position has a rank by the h
lines from there, an order-preserving number from a range-partitioned sort of the
distinct pairs (rank of the first h lines, rank of the next h). Positions of one
rank are an interval of the suffix array whose longest common prefix is h lines
or more. An interval of one position repeats nothing and is dropped, so only
positions that are still shared go on to length 2h.

A run is a repeat if it has ``MIN_WORDS`` words or more. A line lies in a
repeated run exactly if it lies in a shortest window of that many words, from
its first or its last line, that repeats; such a window of m lines is known by
the ranks of its first and its last h lines (h <= m < 2h), and the least position
with the same ranks is the copy that stays. Windows have at most ``MIN_WORDS``
lines, so six doublings reach them, and overlapping windows make up the maximal
runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glasspane.llm.rows import Scratch, discard

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(words: Column, size: int) -> Column:
    """Of each line of a run: lines of the shortest window from it with ``size`` words (null: the run ends before)."""

    def shortest(_, i: Column) -> Column:
        def add(s: Column, w: Column) -> Column:
            return F.when(s["sum"] >= size, s).otherwise(F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n")))

        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
        return F.aggregate(F.slice(words, i + 1, size), start, add, lambda s: F.when(s["sum"] >= size, s["n"]))

    return F.transform(words, shortest)


def _ranked(classes: DataFrame, keys: list[str], n: int, scratch: Scratch) -> DataFrame:
    """``classes`` with ``rank``, a number in the order of ``keys``; written first, since a range sort reads its input twice."""
    ordered = scratch.save(classes, "classes").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return scratch.save(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, version, cut``: for documents that lose lines, the numbers (from 0) of these lines.

    ``version`` is a hash of the text: rows equal in id and text are one document.
    """
    scratch = Scratch(docs.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    line = F.transform(
        _lines(content),
        lambda x, i: F.struct(
            i.alias("line"), F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit("line"), F.trim(x)).alias("b"), F.regexp_count(x, F.lit(r"\S+")).cast("long").alias("words")
        ),
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("version"), F.filter(line, lambda x: x["words"] > 0).alias("lines"))
    rows = scratch.save(rows.where(F.size("lines") > 0), "line-ids")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.dropDuplicates(["doc_id", "version"]).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "version").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "version")
    lines = ordered.select("doc_id", "version", F.posexplode("lines").alias("k", "x")).select("doc_id", "version", "k", "x.line", "x.a", "x.b", "x.words")
    # within a document positions are consecutive: its lines are numbered in one task, in order
    lines = scratch.save(lines.withColumn("pos", F.monotonically_increasing_id()), "lines")
    classes = lines.groupBy("a", "b").agg(F.min("pos").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = _ranked(classes, ["a", "b"], n, scratch)
    live = scratch.save(lines.join(classes.hint("merge"), ["a", "b"]).select("pos", (F.col("pos") - F.col("k")).alias("doc"), "words", "rank", "least"), "names")
    # runs of consecutive lines that each repeat somewhere, long enough together
    place = W.partitionBy("doc").orderBy("pos")
    runs = live.withColumn("run", F.col("pos") - F.row_number().over(place)).groupBy("doc", "run").agg(
        F.sum("words").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("x")
    )
    runs = runs.where(F.col("total") >= min_words)
    first = F.get(F.col("x"), F.lit(0))["pos"]
    words = F.transform("x", lambda x: x["words"])
    forward = F.transform(_windows(words, min_words), lambda m, i: F.struct((first + i).alias("start"), m.alias("m")))
    back = F.transform(_windows(F.reverse(words), min_words), lambda m, i: F.struct((first + F.size("x") - i - m).alias("start"), m.alias("m")))
    windows = runs.select("doc", "run", F.explode(F.filter(F.array_union(forward, back), lambda s: s["m"].isNotNull())).alias("s"))
    windows = scratch.save(windows.select("doc", "run", "s.start", "s.m"), "windows")
    longest = windows.agg(F.max("m").alias("m")).first()["m"]
    if longest is None:
        return scratch.finish(rows.select("doc_id", "version", F.array().cast("array<int>").alias("cut")).limit(0), "cuts")
    names = live.join(windows.where("m > 1").select("doc").distinct().hint("merge"), "doc", "left_semi").select("pos", "doc", "rank")
    # the windows of each length are written by themselves: one plan of all lengths would take much of the driver's memory
    single = windows.where("m = 1").join(live.where("least < pos").select(F.col("pos").alias("start")), "start", "left_semi")
    hit = [scratch.save(single.select("start", "m"), "hits")]
    h = 1
    while longest > 1:
        # windows of h to 2h - 1 lines, by the ranks of their first and last h lines
        now = windows.where((F.col("m") >= F.lit(max(h, 2))) & (F.col("m") < 2 * h))
        head = names.select(F.col("pos").alias("start"), F.col("rank").alias("head"))
        tail = names.select(F.col("pos").alias("last"), F.col("rank").alias("tail"))
        keyed = now.withColumn("last", F.col("start") + F.col("m") - h).join(head, "start").join(tail, "last").select("start", "m", "head", "tail")
        keyed = scratch.save(keyed, "keyed")
        least = keyed.groupBy("m", "head", "tail").agg(F.min("start").alias("least"))
        hit.append(scratch.save(keyed.join(least, ["m", "head", "tail"]).where("least < start").select("start", "m"), "hits"))
        discard(keyed)
        if 2 * h > longest:
            break
        ahead = names.select((F.col("pos") - h).alias("pos"), "doc", F.col("rank").alias("next"))
        pairs = scratch.save(names.withColumnRenamed("rank", "own").join(ahead.hint("merge"), ["pos", "doc"]), "pairs")
        shared = _ranked(pairs.groupBy("own", "next").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["own", "next"], n, scratch)
        names = scratch.save(pairs.join(shared.hint("merge"), ["own", "next"]).select("pos", "doc", "rank"), "names")
        h *= 2
    found = hit[0]
    for more in hit[1:]:
        found = found.unionByName(more)
    cut = found.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("pos")).distinct()
    return scratch.finish(lines.join(cut, "pos").groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("line")).alias("cut")), "cuts")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted from ``text``, and ``n_cut`` lines.

    The first copy, by doc_id (nulls first), stays. Lines are compared without
    white space around them; lines without words are not part of runs and
    stay. Null and empty texts stay as they are; rows equal in id and text are
    one document and get the same result; an own column ``n_cut`` is replaced;
    an empty table gives an empty one.
    """
    cuts = repeated_lines(docs, text, doc_id, min_words)
    kept = [c for c in docs.columns if c.lower() != "n_cut"]
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_version"))
    # one plan at every size: texts and cut lists meet by id and version
    joined = mine.join(cuts.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_version") == F.col("version")), "left")
    whole = F.col("row").getField(text)
    rest = F.array_join(F.filter(_lines(whole), lambda x, i: ~F.array_contains("cut", i)), "\n")
    left = F.when(F.col("cut").isNull(), whole).otherwise(rest)
    count = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).cast("long")
    return joined.select(*[left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], count.alias("n_cut"))
