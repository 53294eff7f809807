"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.llm import decontaminate, fingerprints, jaccard, langid, licences, linededup, merkle, mixing, pseudonyms, quality, search, secretscan, toxicity
from glasspane.llm.rows import own_folder


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: The key of the registered query; a deployment passes its own.
DEMO_KEY = b"a key for tests"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymize(docs, DEMO_KEY)
    spans = F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select("doc_id", "text", F.size("pii").alias("n_pii"), F.array_join(spans, ",").alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicated(docs).select("doc_id", "n_cut", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.withColumn("items", F.array_sort(F.array_distinct("items"))).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secretscan.Ledger(spark, own_folder(spark, "secret-ledger"))  # a deployment names a lasting folder
    secretscan.update(docs, ledger)
    return secretscan.by_path(docs, ledger)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", spans.alias("spans"))


#: Share of the tokens wanted from documents that labels call good (1) and poor (0).
MIX = {"1": 0.95, "0": 0.05}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), MIX)
    good, poor = (F.coalesce(F.try_element_at("posterior", F.lit(k)), F.lit(0.0)) for k in ("1", "0"))
    return found.select("doc_id", "n_tokens", good.alias("p_good"), poor.alias("p_poor"), "rate")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.digest(F.concat(*[merkle.field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]))
    tampered = F.when(fold("doc_id", 3) == 0, leaf(F.translate("text", UPPER, LOWER))).otherwise(F.col("leaf"))
    rows = docs.withColumn("leaf", leaf(F.col("text"))).select("lang", "doc_id", "leaf", F.struct("doc_id", tampered.alias("given")).alias("more"))
    found = merkle.manifest(rows, "lang", ["doc_id"], "leaf")
    out = found.select(
        "more.doc_id",
        *[merkle.shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.proof_text(F.col("steps")).cast("binary"), 256).alias("proof_sha256"),
        merkle.folded(F.col("more.given"), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_licence_scan": op9_licence_scan,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_ranked_search": op13_ranked_search,
}
