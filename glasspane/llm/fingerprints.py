"""Document fingerprints: one-permutation MinHash of word shingles.

Each shingle is hashed once; the top bits of the hash choose one of ``BINS``
bins and the smallest hash of a bin stays. Empty bins are filled by optimal
densification: an empty bin tries other bins in an order that depends on its
number alone until one is filled, so two documents make the same choices where
they have the same filled bins. Of each bin ``BITS`` low-order bits are packed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspane.llm import tokens
from glasspane.llm.rows import append_columns

WORDS = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4


_OF_BIN = tokens.mix(np.arange(1, BINS + 1, dtype=np.uint64))


def _filled(first: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Optimal densification of ``first`` (rows x bins), where ``have`` says which bins have a value."""
    sizes = have.sum(axis=1)
    only = np.flatnonzero(sizes == 1)
    if len(only):
        first[only] = first[only, have[only].argmax(axis=1)][:, None]
    row, at = np.nonzero(~have & (sizes > 1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        seed = at.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(attempt * 0x85EBCA77)
        donor = (tokens.mix(seed) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        hit = have[row, donor]
        first[row[hit], at[hit]] = first[row[hit], donor[hit]]
        row, at = row[~hit], at[~hit]
    return first


def sketch(texts: pa.Array) -> list[np.ndarray | None]:
    """``BINS`` values of ``BITS`` bits for each text; None for a text without words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    texts = tokens.column(texts)
    for lo, hi in tokens.pieces(texts):
        row, key = tokens.shingles(tokens.words(texts.slice(lo, hi - lo), tokens.NOT_SPACE), WORDS)
        if not len(row):
            continue
        place = (row << BIN_BITS) | (key >> np.uint64(tokens.KEY_BITS - BIN_BITS)).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])  # keys ascend, so the first is the least
        rows, inverse = np.unique(row[new], return_inverse=True)
        value = key[new]
        for part in range(0, len(rows), 512):  # bounds the dense matrix
            mine = (inverse >= part) & (inverse < part + 512)
            n = min(512, len(rows) - part)
            first, have = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
            at = (inverse[mine] - part, place[new][mine] & (BINS - 1))
            first[at], have[at] = value[mine], True
            # the bin takes part, so that one key in many bins agrees with another in few of them by chance
            low = (tokens.mix(_filled(first, have) ^ _OF_BIN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
            for r, s in zip(rows[part : part + n], low):
                out[lo + r] = s
    return out


def packed(values: np.ndarray | None) -> str:
    """A sketch as hex digits, one for each bin; empty for a text without words."""
    return "" if values is None else bytes(values[0::2] << 4 | values[1::2]).hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: equal bins, less those that equal low bits make by chance.

    Two texts without words are alike (1), one with and one without are not (0).
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """Adds the packed fingerprint of every whole text.

    Null and empty texts, and texts of white space alone, get ''; equal texts
    get equal fingerprints; repeated rows stay; a column named ``output`` is
    replaced; an empty table gives an empty one.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([packed(s) for s in sketch(batch.column(text))], pa.string())]

    return append_columns(docs, T.StructType([T.StructField(output, T.StringType())]), compute)


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    """Rows in blocks of adjacent keys; each block ends with a copy of the row that follows it.

    The driver gets one bound and one key for each block, never a row for each document.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first()["b"] or [0]))
    depth = len(bounds).bit_length()
    cuts = F.lit(bounds + [2**63 - 1] * (2**depth - 1 - len(bounds)))

    def halve(at, step):  # binary search for the number of bounds below the key
        to = at + step
        return F.when(F.element_at(cuts, to) < F.col(key), to).otherwise(at)

    number = F.aggregate(F.lit([1 << i for i in reversed(range(depth))]), F.lit(0), halve)
    docs = docs.withColumn("_block", F.when(F.col(key).isNull(), 0).otherwise(number))
    least = docs.groupBy("_block").agg(F.min(key).alias("head"), F.count_if(F.col(key).isNull()).alias("nulls"))
    heads = [(r["_block"], None if r["nulls"] else r["head"]) for r in least.orderBy("_block").collect()]
    before = {head: block for (_, head), (block, _) in zip(heads, heads[-1:] + heads[:-1])}
    ahead = F.when(F.col(key).isNull(), F.lit(before.pop(None, None)).cast("int"))
    if before:
        entries = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        ahead = ahead.otherwise(F.try_element_at(entries, F.col(key)))
    places = F.array(*[F.struct(b.alias("block"), F.lit(c).alias("copy")) for b, c in ((F.col("_block"), 0), (ahead, 1))])
    return (
        docs.withColumn("_at", F.explode(F.filter(places, lambda x: x["block"].isNotNull())))
        .select(F.col("_at.block").alias("_block"), F.col("_at.copy").alias("_copy"), *[c for c in docs.columns if c != "_block"])
        .repartitionById(n, F.col("_block"))
        .sortWithinPartitions("_block", "_copy", F.col(key).asc_nulls_first(), F.xxhash64("text"))
    )


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's.

    The edited text has the last half of the code points replaced by as many
    first ones of the next document by doc_id (after the last comes the first).
    Null doc_ids come first; rows with one doc_id are ordered by their text's
    hash; a null text is empty; a lone document is its own next one.
    """
    rows = _blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def answer(held: list[tuple]) -> pa.RecordBatch:
        sketches = sketch(pa.array([t for *_, t in held], pa.string()))
        own = [i for i in range(len(held) - 1) if not held[i][1]]
        edited = [t[: len(t) - len(t) // 2] + held[i + 1][3][: len(t) // 2] for i in own for t in [held[i][3]]]
        changed = sketch(pa.array(edited, pa.string()))
        columns = [
            pa.array([held[i][2] for i in own], pa.int64()),
            pa.array([len(held[i][3]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([packed(sketches[i]) for i in own], pa.string()),
            pa.array([packed(c) for c in changed], pa.string()),
            pa.array([likeness(sketches[i], c) for i, c in zip(own, changed)], pa.float64()),
            pa.array([likeness(sketches[i], sketches[i + 1]) for i in own], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > tokens.SLICE_BYTES:
                    yield answer(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield answer(held)

    return rows.select("_block", "_copy", "doc_id", "text").mapInArrow(run, schema)
