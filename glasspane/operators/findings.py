"""Tables of findings: (artifact, ord, kind, location, value, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collapse(findings: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """Equal (kind, location) of an artifact become one finding at the first one's place, with their number."""
    first = F.min_by(F.struct("value", "severity"), "ord")
    got = findings.groupBy(artifact, "kind", "location").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), first.alias("f"))
    counted = F.concat(F.col("n").cast("string"), F.lit(" segments"), F.coalesce(F.concat(F.lit(", each "), F.col("f.value")), F.lit("")))
    return got.select(artifact, "ord", "kind", "location", F.when(F.col("n") > 1, counted).otherwise(F.col("f.value")).alias("value"), F.col("f.severity").alias("severity"), "n")


def worst_first(findings: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """Adds each finding's place in its artifact, the most severe first, file order among equals."""
    place = W.partitionBy(artifact).orderBy(F.desc("severity"), "ord")
    return findings.withColumn("place", F.row_number().over(place))


def critical_summary(findings: DataFrame, artifact: str = "artifact_id", most: int = 3) -> DataFrame:
    """Of each artifact: whether any finding is critical, and the first distinct critical kinds."""
    # one row for each kind first: an artifact's list is never longer than there are kinds
    first = findings.groupBy(artifact, "kind").agg(F.min(F.when(F.col("severity") == 2, F.col("ord"))).alias("ord"))
    kinds = F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "kind")))), lambda x: x["kind"])
    got = first.groupBy(artifact).agg(F.max(F.col("ord").isNotNull()).alias("critical"), kinds.alias("kinds"))
    return got.select(artifact, "critical", F.array_join(F.slice("kinds", 1, most), ",").alias("kinds"), (F.size("kinds") > most).alias("more"))


def classified(entries: DataFrame, rules: DataFrame, key: Column, fallback: tuple[str, int]) -> DataFrame:
    """Adds kind and severity of each entry by its upper-cased key; ``rules`` (key, kind, severity) is a fixed short table."""
    named = entries.withColumn("_key", key).join(F.broadcast(rules.withColumnRenamed("key", "_key")), "_key", "left").drop("_key")
    return named.withColumns({"kind": F.coalesce("kind", F.lit(fallback[0])), "severity": F.coalesce("severity", F.lit(fallback[1]))})


def tracked_changes(changes: DataFrame, artifact: str) -> DataFrame:
    """Insertions, deletions and the distinct authors in order, from (artifact, kind, author)."""
    authors = F.array_join(F.array_sort(F.collect_set("author")), ", ")
    return changes.groupBy(artifact).agg(F.count_if(F.col("kind") == "ins").alias("insertions"), F.count_if(F.col("kind") == "del").alias("deletions"), authors.alias("authors"))


def only_in_older(older: Column, current: Column) -> Column:
    """Trimmed non-empty lines of an older revision that the current one lacks; order and repeats stay."""
    lines = lambda t: F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    now = lines(current)
    return F.filter(lines(older), lambda x: ~F.array_contains(now, x))


#: Keys of Vorbis comments and what they tell (0 minor, 1 notable, 2 critical).
VORBIS = {
    ("author", 2): ("ARTIST", "ALBUMARTIST", "PERFORMER", "COMPOSER", "AUTHOR", "CONDUCTOR", "ENSEMBLE", "ARRANGER", "LYRICIST", "WRITER"),
    ("comment", 2): ("COMMENT", "COMMENTS", "DESCRIPTION", "SYNOPSIS", "LYRICS"),
    ("embedded preview", 2): ("METADATA_BLOCK_PICTURE", "COVERART"),
    ("software", 1): ("ENCODER", "ENCODED_BY", "ENCODING", "VENDOR"),
    ("timestamp", 1): ("DATE", "YEAR", "ORIGINALDATE", "ENCODING_TIME"),
    ("organization", 1): ("ORGANIZATION", "LABEL", "PUBLISHER", "COPYRIGHT", "LICENSE", "CONTACT"),
    ("device", 1): ("MUSICBRAINZ_TRACKID", "MUSICBRAINZ_ALBUMID", "ACOUSTID_ID", "ISRC"),
}
#: RIFF INFO fields.
RIFF_INFO = {
    ("author", 2): ("IART", "IENG", "ITCH"),
    ("comment", 2): ("ICMT",),
    ("comment", 1): ("ISBJ", "INAM", "IKEY", "IPRD", "IGNR"),
    ("software", 1): ("ISFT",),
    ("timestamp", 1): ("ICRD", "IDIT"),
    ("organization", 2): ("ICMS",),
    ("organization", 1): ("ICOP", "ISRC"),
    ("device", 1): ("IMED", "ISRF"),
}
#: Fields of a PDF's document information.
PDF_INFO = {
    ("author", 2): ("Author",),
    ("software", 1): ("Creator", "Producer"),
    ("comment", 1): ("Title", "Subject", "Keywords"),
    ("timestamp", 1): ("CreationDate", "ModDate"),
}


def named(entries: Column, tag: str, place: str, table: dict) -> Column:
    """Findings of (tag, value) entries by a fixed table of kinds; other entries are comments."""

    def one(e: Column, i: Column) -> Column:
        upper = F.upper(e[tag])
        kind, severity = F.lit("comment"), F.lit(1)
        for (k, s), names in table.items():
            kind, severity = F.when(upper.isin(*names), k).otherwise(kind), F.when(upper.isin(*names), s).otherwise(severity)
        return F.struct(i.alias("ord"), kind.alias("kind"), F.concat(F.lit(f"{place}:"), e[tag]).alias("location"), e["value"].alias("value"), severity.alias("severity"))

    return F.transform(entries, one)


def rule_table(spark, table: dict) -> DataFrame:
    rows = ", ".join(f"('{k}', '{kind}', {severity})" for (kind, severity), keys in table.items() for k in keys)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(key, kind, severity)")
