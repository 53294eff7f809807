"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive word k-grams the ones with the least
hash are kept, for the benchmark and for the documents alike. Any shared span of
``SPAN`` words therefore shares a kept k-gram at the same place; each such hit is
extended word by word, which finds every shared span of that length and no other.
Benchmark items of fewer words are looked up whole.

A benchmark of a checked size is sent to the tasks as an index. A larger one is
joined by a shuffle: the kept k-grams of documents and items meet by hash, and the
texts of each pair that shares one are brought together to extend the hits, so
what a task or the driver holds never grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspane.llm import tokens
from glasspane.llm.rows import Scratch, append_columns, small_batches

SPAN = 10
GRAM = 5
#: Bytes of benchmark text up to which its index is broadcast.
INDEX_BYTES = 32 << 20


def _kept(hashed: np.ndarray, whole: np.ndarray, span_row: np.ndarray, width: int) -> np.ndarray:
    """Positions of the k-grams that are least in some window of ``width`` k-grams of one row."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = hashed[:n].copy()
    for j in range(1, width):
        np.minimum(least, hashed[j : j + n], out=least)
    valid = whole[:n] & whole[width - 1 : width - 1 + n] & (span_row[:n] == span_row[width - 1 : width - 1 + n])
    kept = np.zeros(len(hashed), bool)
    for j in range(width):
        kept[j : j + n] |= valid & (hashed[j : j + n] == least)
    return np.flatnonzero(kept)


class Index:
    """Fingerprints of benchmark items, with the items' words to extend hits on."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        w = tokens.words(tokens.column(pa.array(texts, pa.string())), tokens.ALNUM)
        counts, firsts = w.counts(), w.firsts()
        self.ids, self.words, self.item, self.ends = np.array(ids, object), w.hash, w.row, firsts[1:]
        self.starts = firsts[:-1]
        hashed, whole = tokens.windows(w, GRAM)
        at = _kept(hashed, whole, w.row[: len(hashed)], SPAN - GRAM + 1)
        order = np.argsort(hashed[at], kind="stable")
        self.hash, self.at = hashed[at][order], at[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, SPAN):
            items = np.flatnonzero(counts == m)
            if len(items):
                hashed, _ = tokens.windows(w, m)
                of = hashed[firsts[items]]
                order = np.argsort(of, kind="stable")
                self.short[m] = (of[order], items[order])

    def hits(self, w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and item of each shared span."""
        out = [(np.empty(0, np.int64),) * 3]
        hashed, whole = tokens.windows(w, GRAM)
        kept = _kept(hashed, whole, w.row[: len(hashed)], SPAN - GRAM + 1)
        if len(kept) and len(self.hash):
            lo, hi = (np.searchsorted(self.hash, hashed[kept], side=s) for s in ("left", "right"))
            found, which = tokens.spread(lo, hi)
            at, there = kept[which], self.at[found]
            lasts = w.firsts()[1:][w.row[at]]
            firsts = w.firsts()[:-1][w.row[at]]
            item = self.item[there]
            back, ahead = np.zeros(len(at), np.int64), np.full(len(at), GRAM)
            for grown, step in ((back, -1), (ahead, 1)):
                live = np.arange(len(at))
                for _ in range(SPAN - GRAM):
                    a, b = (at[live] - back[live] - 1, there[live] - back[live] - 1) if step < 0 else (at[live] + ahead[live], there[live] + ahead[live])
                    ok = (a >= firsts[live]) & (b >= self.starts[item[live]]) & (a < lasts[live]) & (b < self.ends[item[live]])
                    live, a, b = live[ok], a[ok], b[ok]
                    live = live[w.hash[a] == self.words[b]]
                    grown[live] += 1
            long = back + ahead >= SPAN
            same = long & (w.hash[at] == self.words[there])
            out.append((at[same] - back[same], at[same] + ahead[same], item[same]))
        for m, (of, items) in self.short.items():
            hashed, whole = tokens.windows(w, m)
            lo, hi = (np.searchsorted(of, hashed, side=s) for s in ("left", "right"))
            found, which = tokens.spread(np.where(whole, lo, 0), np.where(whole, hi, 0))
            out.append((which, which + m, items[found]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _answers(texts: pa.Array, index: Index) -> tuple[list, list, list]:
    """For each text: number of words, merged hit spans, ids of the items."""
    n_words, spans, items = [], [], []
    for lo, hi in tokens.pieces(texts):
        w = tokens.words(texts.slice(lo, hi - lo), tokens.ALNUM)
        counts, firsts = w.counts(), w.firsts()
        start, end, item = index.hits(w)
        n_words += counts.tolist()
        own_spans, own_items = [[] for _ in counts], [[] for _ in counts]
        row = w.row[start] if len(start) else start
        for r, a, b in np.unique(np.stack([row, start - firsts[row], end - firsts[row]]), axis=1).T.tolist() if len(start) else []:
            own_spans[r].append((a, b))
        for r, i in np.unique(np.stack([row, item]), axis=1).T.tolist() if len(start) else []:
            own_items[r].append(index.ids[i])
        spans += map(_merged, own_spans)
        items += own_items
    return n_words, spans, items


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_NEW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def _listed(spans: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _by_index(docs: DataFrame, text: str, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n, spans, items = _answers(tokens.column(batch.column(text)), sent.value)
        return [pa.array(n, pa.int64()), _listed(spans), pa.array(items, pa.list_(pa.string()))]

    return append_columns(docs, _NEW, compute)


def _key(text: str) -> list:
    """A text's name: equal texts have the same answer."""
    content = F.coalesce(text, F.lit(""))
    return [F.xxhash64(content).alias("key"), F.xxhash64(F.lit("text"), content).alias("key2")]


def _fingerprints(texts: DataFrame, keys: list[str], short: list[int], whole: bool) -> DataFrame:
    """``keys``, ``m`` and ``gram``: the kept k-grams (m = 0), and for items of m words the m-grams, of items the ``whole`` ones alone."""
    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField("m", T.IntegerType()), T.StructField("gram", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = tokens.column(batch.column(len(keys)))
            for lo, hi in tokens.pieces(values):
                w = tokens.words(values.slice(lo, hi - lo), tokens.ALNUM)
                counts, firsts = w.counts(), w.firsts()
                hashed, same = tokens.windows(w, GRAM)
                at = _kept(hashed, same, w.row[: len(hashed)], SPAN - GRAM + 1)
                found = [(w.row[at], np.zeros(len(at), np.int32), hashed[at])]
                for m in short:
                    hashed, same = tokens.windows(w, m)
                    at = firsts[:-1][counts == m] if whole else np.flatnonzero(same)
                    found.append((w.row[at], np.full(len(at), m, np.int32), hashed[at]))
                row, m, gram = (np.concatenate(x) for x in zip(*found))
                columns = [batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(m), pa.array(gram.view(np.int64))], names=schema.names)

    return texts.mapInArrow(run, schema).distinct()


def _by_join(docs: DataFrame, bench: DataFrame, text: str) -> DataFrame:
    """As ``_by_index``, with all that grows in shuffles."""
    scratch = Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    texts = docs.select(*_key(text), F.coalesce(text, F.lit("")).alias("text"))
    short = list(range(1, SPAN))
    with small_batches(docs.sparkSession):
        of_items = scratch.save(_fingerprints(bench.select("id", "text"), ["id"], short, True), "items")
        used = [r["m"] for r in of_items.where("m > 0").select("m").distinct().collect()]  # nine lengths at most
        of_docs = _fingerprints(texts, ["key", "key2"], sorted(used), False)
        pairs = scratch.save(of_docs.join(of_items, ["m", "gram"]).select("key", "key2", "id").distinct(), "pairs")
        mine = texts.join(pairs.select("key", "key2").distinct(), ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.first("text").alias("text"))
        items = bench.groupBy("id", "text").count().select("id", F.col("text").alias("item"))
        both = mine.join(pairs, ["key", "key2"]).join(items, "id").select("key", "key2", "text", "id", "item")
        both = both.repartition("key", "key2").sortWithinPartitions("key", "key2")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, spans, ids = None, [], set()

            def answer() -> pa.RecordBatch:
                columns = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), _listed([_merged(spans)]), pa.array([sorted(ids)], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(columns, names=["key", "key2", "spans", "items"])

            for batch in batches:
                for key, key2, doc, i, item in zip(*(c.to_pylist() for c in batch.columns)):
                    if (key, key2) != at:
                        if ids:
                            yield answer()
                        at, spans, ids = (key, key2), [], set()
                    _, found, named = _answers(pa.array([doc]), Index([i], [item]))
                    spans = _merged(spans + found[0])
                    ids.update(named[0])
            if ids:
                yield answer()

        hits = scratch.finish(both.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), *_NEW.fields[1:]])), "hits")
    count = lambda batch: [pa.array(tokens.words(tokens.column(batch.column("text")), tokens.ALNUM).counts(), pa.int64())]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_key(text), F.coalesce(text, F.lit("")).alias("text"))
    rows = append_columns(rows, T.StructType([_NEW["n_words"]]), count).drop("text").join(hits, ["key", "key2"], "left")
    none = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in _NEW.fields[1:]]
    return rows.select("row.*", "n_words", *none)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """Adds ``n_words``, ``spans`` (word ranges that occur in the benchmark) and ``items`` to every row.

    Null texts have no words; null items and items without words never hit;
    items with equal texts all count; repeated document rows stay apart; own
    columns of these names are replaced; an empty table on either side gives
    the documents without hits. A null item_id is named ''.
    """
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    if size > index_bytes:
        return _by_join(docs, bench, text)
    got = bench.collect()  # its size has been checked
    return _by_index(docs, text, Index([r["id"] for r in got], [r["text"] for r in got]))


def n_hit(spans: str = "spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
