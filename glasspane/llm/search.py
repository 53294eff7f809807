"""Ranked lexical search: term at a time, rarest first, with a bound on new accumulators.

The queries are the distinct texts of an item table, taken in blocks of a bounded
size; a block's vocabulary is what is broadcast. One pass over the documents
keeps, of each, the block's terms with their counts, and the corpus statistics
are aggregated from that table and from all texts. A second pass turns each batch
of documents into postings and scores every query against them, rarest term
first: a document gets an accumulator only while the largest sum that the
remaining terms could give reaches the score of the k-th best so far; later terms
go on to update the accumulators there are, so each survivor's score is exact. The
best k of a task are merged by query, first within salts, then over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glasspane.llm import tokens
from glasspane.llm.rows import Scratch, small_batches

TOP = 20
#: Bytes of query texts in one block: bounds what is broadcast and what the driver gathers.
BLOCK_BYTES = 8 << 20
#: Fixed values of the score.
B_OUT_OF_100, SCALE, K12 = 25, 1_000_000_000, 12
#: Tasks whose best rows of one query are merged together first.
SALTS = 64
_INDEX = "id long, n long, terms array<int>, counts array<int>"
_FOUND = "query int, score long, id long"


@dataclass
class Vocabulary:
    """The terms of a block of queries, sorted by hash, with their bytes; and each query as term numbers with repeats."""

    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    queries: list[tuple[np.ndarray, np.ndarray]]  # term numbers and how often

    @classmethod
    def of(cls, texts: list[str]) -> Vocabulary:
        w = tokens.words(pa.array(texts, pa.large_string()), tokens.ALNUM)
        # terms of equal hash but other bytes stay apart: they are told apart by their bytes
        spelled: dict[tuple[int, bytes], int] = {}
        for h, s, e in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist()):
            spelled.setdefault((h, w.data[s:e].tobytes()), 0)
        order = sorted(spelled)
        number = {key: i for i, key in enumerate(order)}
        terms = np.array([number[(h, w.data[s:e].tobytes())] for h, s, e in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist())], np.int64)
        firsts = w.firsts()
        queries = [np.unique(terms[a:b], return_counts=True) for a, b in zip(firsts[:-1], firsts[1:])]
        sizes = np.array([len(b) for _, b in order], np.int64)
        return cls(np.array([h for h, _ in order], np.uint64), np.frombuffer(b"".join(b for _, b in order), np.uint8), np.cumsum(sizes) - sizes, sizes, queries)

    def numbers(self, w: tokens.Words) -> np.ndarray:
        """The term number of each word, -1 for words that no query has; bytes are compared."""
        out = np.full(len(w.hash), -1, np.int64)
        if not len(self.hash):
            return out
        at = np.searchsorted(self.hash, w.hash, side="left")
        last = np.searchsorted(self.hash, w.hash, side="right")
        step, open_ = 0, np.flatnonzero(at < last)
        while len(open_):  # more than one round only for terms of equal hash
            term = at[open_] + step
            same = self._equal(w, open_, term)
            out[open_[same]] = term[same]
            rest = open_[~same]
            step += 1
            open_ = rest[at[rest] + step < last[rest]]
        return out

    def _equal(self, w: tokens.Words, word: np.ndarray, term: np.ndarray) -> np.ndarray:
        same = w.end[word] - w.start[word] == self.size[term]
        some = np.flatnonzero(same)
        if len(some):
            size = self.size[term[some]]
            mine, which = tokens.spread(w.start[word[some]], w.end[word[some]])
            theirs, _ = tokens.spread(self.start[term[some]], self.start[term[some]] + size)
            wrong = np.zeros(len(some), bool)
            wrong[which[w.data[mine] != self.data[theirs]]] = True
            same[some[wrong]] = False
        return same


def _counted(values: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of texts: terms of each row, terms of the vocabulary by row, their numbers and counts."""
    width = max(len(vocabulary.hash), 1)
    for a, b in tokens.pieces(values):
        w = tokens.words(values[a:b], tokens.ALNUM)
        number = vocabulary.numbers(w)
        known = number >= 0
        pairs, counts = np.unique(w.row[known] * width + number[known], return_counts=True)
        yield w.counts(), pairs // width, pairs % width, counts


def _index(docs: DataFrame, text: str, doc_id: str, vocabulary) -> DataFrame:
    """``id, n, terms, counts`` of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            at = 0
            for n, row, term, count in _counted(tokens.column(batch.column(1)), known):
                offsets = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, count)]
                out = pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(n)], pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
                at += len(n)
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _INDEX)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


class Ranker:
    """The best documents of each query among the batches seen so far."""

    def __init__(self, vocabulary: Vocabulary, df: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.weight, self.n_docs, self.n_terms, self.top = weights(df, n_docs), n_docs, n_terms, top
        self.queries = []
        for term, often in vocabulary.queries:
            held = df[term] > 0
            order = np.lexsort((term[held], df[term[held]]))  # rarest first
            self.queries.append((term[held][order], often[held][order]))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in self.queries]
        self.created = 0

    def add(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        m = 100 - B_OUT_OF_100 + (B_OUT_OF_100 * n * self.n_docs) // self.n_terms
        order = np.argsort(term, kind="stable")
        row, term, count = row[order], term[order], count[order]
        worth = self.weight[term] * ((SCALE * count) // (1000 * count + K12 * m[row]))
        first = np.searchsorted(term, np.arange(len(self.weight) + 1))
        filled = np.flatnonzero(first[1:] > first[:-1])
        most = np.zeros(len(self.weight), np.int64)
        if len(filled):
            most[filled] = np.maximum.reduceat(worth, first[filled])
        score, live = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        for q, (terms, often) in enumerate(self.queries):
            bound = most[terms] * often
            rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])  # what the terms from here on can give at most
            held = self.best[q][0]
            floor = held.min() if len(held) == self.top else 0
            created: list[np.ndarray] = []
            for k, t in enumerate(terms.tolist()):
                a, b = first[t], first[t + 1]
                if a == b:
                    continue
                at, gain = row[a:b], worth[a:b] * often[k]
                if rest[k] >= max(floor, 1):
                    new = at[~live[at]]
                    live[new] = True
                    created.append(new)
                    score[at] += gain
                    if rest[k + 1] >= floor:  # the k-th partial score is only needed while accumulators may be added
                        mine = np.concatenate(created)
                        if len(mine) >= self.top:
                            floor = max(floor, np.partition(score[mine], len(mine) - self.top)[len(mine) - self.top])
                else:
                    old = live[at]
                    score[at[old]] += gain[old]
            if created:
                mine = np.concatenate(created)
                self.created += len(mine)
                mine = mine[score[mine] >= max(floor, 1)]
                self._keep(q, score[mine], ids[mine], no_id[mine])
                for x in created:
                    score[x], live[x] = 0, False

    def _keep(self, q: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(x) for x in zip(self.best[q], (score, ids, no_id)))
        order = np.lexsort((ids, no_id, -score))[: self.top]
        self.best[q] = score[order], ids[order], no_id[order]


def _lists(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column, and the row of each."""
    sizes = np.diff(values.offsets.to_numpy())
    return values.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(values)), sizes)


def _scored(index: DataFrame, ranker) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ranker.value()
        for batch in batches:
            term, row = _lists(batch.column(2))
            count, _ = _lists(batch.column(3))
            ids = batch.column(0)
            no_id = np.asarray(ids.is_null())
            mine.add(ids.fill_null(0).to_numpy(zero_copy_only=False), no_id, batch.column(1).to_numpy(), row, term.astype(np.int64), count.astype(np.int64))
        for q, (score, ids, no_id) in enumerate(mine.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(score), pa.array(ids, pa.int64(), mask=no_id)], names=["query", "score", "id"])

    return index.mapInArrow(run, _FOUND)


class _Fresh:
    """Makes a new ranker in each task from what is broadcast."""

    def __init__(self, *given):
        self.given = given

    def __call__(self) -> Ranker:
        return Ranker(*self.given)


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best of each query over all tasks: within salts first, so that no query's rows all come to one task."""
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("query", "salt").orderBy(*best))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*best))).where(F.col("rank") <= top).select("query", "rank", "id", "score")


def _block(spark: SparkSession, docs: DataFrame, texts: list[str], text: str, doc_id: str, top: int, scratch: Scratch) -> DataFrame:
    """``query`` (number of the text), ``rank, id, score`` of one block of query texts."""
    vocabulary = Vocabulary.of(texts)
    sent = spark.sparkContext.broadcast(vocabulary)
    index = scratch.save(_index(docs, text, doc_id, sent), "index")
    totals = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary.hash), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most a row for each term of the block
        df[r["term"]] = r["count"]
    ranker = spark.sparkContext.broadcast(_Fresh(vocabulary, df, totals["docs"], max(totals["terms"], 1), top))
    return scratch.save(_merged(_scored(index, ranker), top), "best")


def ranked(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item, with a score above 0.

    Equal scores go by ascending id, rows without an id last. Repeated rows of
    ``docs`` are documents of their own. Items of one text get the same list;
    each row of ``items`` gets its own. Null and empty texts hold no terms;
    empty tables give an empty result. Other columns do not matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    given = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("query_text"))
    texts = scratch.save(given.select("query_text").distinct(), "queries")
    size = texts.agg(F.sum(F.octet_length("query_text")).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    with small_batches(spark):
        for b in range(blocks):
            mine = [r["query_text"] for r in texts.where(F.pmod(F.xxhash64("query_text"), F.lit(blocks)) == b).toLocalIterator()]
            numbered = spark.createDataFrame([(i, t) for i, t in enumerate(mine)], "query int, query_text string")
            found = _block(spark, docs, mine, text, doc_id, top, scratch).join(numbered, "query").drop("query")
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = spark.createDataFrame([], "rank int, id long, score long, query_text string")
        return scratch.finish(given.join(out, "query_text").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked")
