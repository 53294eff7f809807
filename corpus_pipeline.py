"""A training-corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.llm import decontaminate, jaccard, linededup, mixing, toxicity
from glasspane.llm.rows import discard, saved

#: Share of the tokens wanted from documents that labels call good (1) and poor (0).
TARGETS = {"1": 0.95, "0": 0.05}


def _beside(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column of the row can clash with a new one."""
    return docs.select(F.struct("*").alias("row"), "text")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_beside(docs), model).where("predicted = 0").select("row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which nothing else is left."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    left = linededup.deduplicated(rows)
    left = left.where((F.col("n_cut") == 0) | F.rlike("text", F.lit(r"\S")))
    count = F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = F.col("row").withField("text", F.col("text")).withField("n_chars", count)
    return left.select(changed.alias("row")).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id stay."""
    gone = jaccard.similar(docs).where("component_id != doc_id").select(F.struct(F.col("doc_id").alias("id")).alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(gone, F.col("id") == F.col("_gone.id"), "left_anti").select("row.*")


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    found = decontaminate.contamination(_beside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select("row.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate for each document, so that the tokens of good and poor documents come to the targets."""
    found = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    good, poor = (F.coalesce(F.try_element_at("posterior", F.lit(k)), F.lit(0.0)) for k in ("1", "0"))
    return found.select("doc_id", "n_tokens", good.alias("p_good"), poor.alias("p_poor"), "rate")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", reject_contaminated),
    ("mixing", mix_to_targets),
]

#: SQL cannot express the trained stages; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
