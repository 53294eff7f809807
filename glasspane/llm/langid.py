"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all labelled rows given; the matrix of log-probabilities
(languages x buckets, at most ``MAX_LANGS`` x ``BUCKETS``) is broadcast and each
batch is scored with gathers and segmented sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspane.llm import tokens
from glasspane.llm.rows import append_columns

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGS = 512
SMOOTHING = 0.5


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: their range, hashed n-grams and the row of each, order by order."""
    for lo, hi in tokens.pieces(texts):
        lowered = [t.lower() for t in texts.slice(lo, hi - lo).to_pylist()]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes)
        hashed = points * np.uint32(0x9E3779B1)
        acc = hashed
        for order in range(1, max(ORDERS) + 1):
            if order > 1:
                acc = acc[:-1] * np.uint32(0x85EBCA6B) + hashed[order - 1 :]
            n = len(acc)
            if order in ORDERS and n:
                whole = row[:n] == row[order - 1 :]
                bucket = (acc ^ (acc >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                yield lo, hi, bucket[whole].astype(np.int32), row[:n][whole]


def counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """``label, bucket, n`` over all rows of ``labelled``; added up per partition before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                    names=["label", "bucket", "n"],
                )
            held.clear()

        for batch in batches:
            names, codes = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
            texts = tokens.column(batch.column(0))
            for lo, hi, bucket, row in _grams(texts):
                code = codes[lo:hi][row].astype(np.int64)
                got = np.bincount(code * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k in np.unique(codes[lo:hi]):
                    held[names[k]] = held.get(names[k], 0) + got[k]
            if len(held) > 64:
                yield from flush()
        yield from flush()

    got = labelled.select(F.col(text), F.col(label).cast("string")).mapInArrow(run, "label string, bucket int, n long")
    return got.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log-probabilities, from rows with text and label."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    got = counts(rows, text, label).toArrow()
    if not got.num_rows:
        return [], np.zeros((0, BUCKETS), np.float32)
    names = sorted(pc.unique(got["label"]).to_pylist())
    if len(names) > MAX_LANGS:
        raise ValueError(f"{len(names)} languages; the broadcast matrix holds {MAX_LANGS}")
    matrix = np.zeros((len(names), BUCKETS))
    of = np.searchsorted(np.array(names), np.array(got["label"].to_pylist()))
    matrix[of, got["bucket"].to_numpy()] = got["n"].to_numpy()
    matrix += SMOOTHING
    return names, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the posterior of that language, even priors).

    Null texts and texts without a letter get 'und' and 0, and so does every
    text if nothing was learned; ties go to the first language by name;
    repeated rows stay; own columns of these names are replaced.
    """
    names, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = tokens.column(batch.column(text))
        if not names:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        total = np.zeros((len(texts), len(names)))
        for lo, hi, bucket, row in _grams(texts):
            for k, logp in enumerate(sent.value):
                total[lo:hi, k] += np.bincount(row, weights=logp[bucket], minlength=hi - lo)
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        found = np.where(letters, np.array(names, object)[best], "und")
        return [pa.array(found, pa.string()), pa.array(np.where(letters, posterior, 0.0), pa.float64())]

    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return append_columns(docs, new, compute)
