"""Secret scans with an incremental blob ledger, by DataFrame functions alone.

Every text version is a blob named by its SHA-256. The ledger is a folder with
two tables: which blob has been scanned with which version of which rule, and
what was found. Only unseen pairs of blob and rule version are scanned, each blob
once however many paths hold it; the ledger's findings are joined back to all
paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glasspane.llm.rows import Scratch, exists


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group below which a match is dropped
    base: bool = True


#: The base rules in their order, then the ones added here.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),  # as AKIA[A-Z0-9]+ of 20 characters or more: the run is taken whole
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # as [0-9a-f]+ of 24 characters or more
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", base=False),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)

class Ledger:
    """Scanned blobs and findings in a folder that all machines can reach; an absent folder is an empty ledger."""

    SCANNED = "blob binary, rules array<string>"  # rules as kind:version
    FINDINGS = "blob binary, rule string, start int, end int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """``blob, rules`` of every scan; a blob scanned again with newer rules has several rows."""
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        """``blob, rule, start, end`` of every rule version that was ever run."""
        return self._read("findings", self.FINDINGS)

    def append(self, scanned: DataFrame, findings: DataFrame) -> None:
        """Findings go first: a run that dies between the two is repeated, and findings are read as a set."""
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def _lengths(text: Column, rule: Rule) -> Column:
    """Lengths between, of and kept of each match, in order, as an array; null where nothing matches."""
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    found = F.arrays_zip(sizes(F.split(text, rule.pattern, -1)).alias("gap"), sizes(matches).alias("n"), sizes(kept).alias("kept"))
    found = F.struct(F.lit(_name(rule)).alias("rule"), F.lit(rule.least).alias("least"), found.alias("matches"))
    return F.when(F.array_contains("todo", _name(rule)) & F.rlike(text, F.lit(rule.pattern)), found)


def update(docs: DataFrame, ledger: Ledger, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger has not seen, adds it to the ledger, and returns the new ``blob, rules``.

    A null text is the empty blob; repeated rows and copies are one blob; an
    empty table adds nothing. Other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.select(_blob(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    seen = ledger.scanned().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    unseen = F.array_except(F.lit([_name(r) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    new = known.select("blob").distinct().join(seen, "blob", "left").select("blob", unseen.alias("todo"))
    new = scratch.save(new.where(F.size("todo") > 0), "unseen")
    # copies are one before they are dealt; a short list of new blobs is sent to the scan and filters it there
    texts = known.groupBy("blob").agg(F.first("text").alias("text")).join(new.select("blob"), "blob", "left_semi").join(new, "blob")
    found = texts.select("blob", F.explode_outer(F.array_compact(F.array(*[_lengths(F.col("text"), r) for r in rules]))).alias("r")).where("r is not null")
    found = found.select("blob", "r.rule", "r.least", F.posexplode("r.matches").alias("i", "m")).select("blob", "rule", "least", "i", "m.gap", "m.n", "m.kept").where("n is not null")
    # a match ends after all gaps and matches up to it
    upto = W.partitionBy("blob", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")).where("kept >= least")
    ledger.append(new.select("blob", F.col("todo").alias("rules")), found.select("blob", "rule", (F.col("end") - F.col("n")).alias("start"), "end"))
    return scratch.finish(new.select("blob", F.col("todo").alias("rules")), "scanned")


def by_path(docs: DataFrame, ledger: Ledger, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings of the current rule versions at every path: counts of the base rules, digest of the base spans, and all spans.

    Every row of ``docs`` gives one row, repeated rows and null paths included;
    texts without findings have zero counts and empty lists. A text that was
    never scanned has none.
    """
    number = F.array_position(F.lit([_name(r) for r in rules]), F.col("rule")).cast("int") - 1
    mine = ledger.findings().where(F.col("rule").isin([_name(r) for r in rules]))
    found = mine.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", number.alias("number"), "end"))).alias("spans"))
    at = docs.select(F.col(path).alias("_path"), _blob(text).alias("blob")).join(found, "blob", "left")
    at = at.withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
    kinds = F.lit([r.kind for r in rules])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["number"].isin([i for i, r in enumerate(rules) if r.base]))
    count = lambda i: F.size(F.filter("spans", lambda s: s["number"] == i)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return at.select(F.col("_path").alias(path), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
