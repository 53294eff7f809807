"""Toxic spans by a linear-chain conditional random field.

Labels exist for documents only, so tokens of toxic documents are labelled from
document frequencies: a word or word beginning that toxic documents have far
more often than clean ones marks its tokens. The CRF (two states, hashed
features of the word and its beginnings, one chain for each line) is trained on
these; forward-backward marginals give the offending spans, and a calibrated
function of a document's marginals its score.

The model is fitted on a bounded sample of labelled rows: at most ``PER_CLASS``
documents of each label, each of at most ``SAMPLE_BYTES`` bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspane.llm import tokens
from glasspane.llm.rows import append_columns

PER_CLASS = 2000
SAMPLE_BYTES = 16 << 10
BUCKETS = 1 << 18
#: Words that the fit works on at a time; bounds the driver's memory.
GROUP = 1 << 17
PREFIXES = (3, 4, 5, 6, 7, 8)
STEPS = 30
#: A token counts as offending from this marginal on.
SPAN_AT = 0.5


def features(w: tokens.Words) -> np.ndarray:
    """Buckets of each word: the word itself, then its beginnings of 3 to 8 bytes (0: too short)."""
    out = np.zeros((1 + len(PREFIXES), len(w.hash)), np.int32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out[0] = w.hash >> shift
    acc, size = np.zeros(len(w.hash), np.uint64), w.end - w.start
    last = max(len(w.data) - 1, 0)
    for n in range(1, max(PREFIXES) + 1):
        acc = (acc + w.data[np.minimum(w.start + n - 1, last)]) * np.uint64(0x9E3779B97F4A7C15)
        if n in PREFIXES:
            at = tokens.mix(acc + np.uint64(n)) >> shift
            out[1 + PREFIXES.index(n)] = np.where(size >= n, at, 0)
    return out


def chains(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each line's chain, longest first."""
    lines = np.cumsum(w.data == 10)
    line = lines[w.start] if len(w.start) else w.start
    new = np.ones(len(w.row), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(w.row)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # score of each step from state i to state j
    calibration: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return self.bias + sum(self.weights[f] for f in feats)

    def passes(self, e: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-ratios of the forward and backward messages of all chains, step by step for all at once."""
        t, forward, backward = self.moves, e.copy(), np.zeros_like(e)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for k in range(1, len(live)):
            at = first[: live[k]] + k
            r = forward[at - 1]
            forward[at] += np.logaddexp(t[0, 1], r + t[1, 1]) - np.logaddexp(t[0, 0], r + t[1, 0])
        for k in range(len(live) - 1, 0, -1):
            at = first[: live[k]] + k
            r = e[at] + backward[at]
            backward[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + r) - np.logaddexp(t[0, 0], t[0, 1] + r)
        return forward, backward

    def marginals(self, w: tokens.Words) -> np.ndarray:
        forward, backward = self.passes(self.emissions(features(w)), *chains(w))
        return _sigmoid(forward + backward)

    def scores(self, w: tokens.Words, p: np.ndarray) -> np.ndarray:
        return _sigmoid(_document_features(w, p) @ self.calibration)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _document_features(w: tokens.Words, p: np.ndarray) -> np.ndarray:
    """Of each document: 1, log of the expected offending words, and of their share (shrunk for short texts)."""
    expected = np.bincount(w.row, weights=p, minlength=w.rows)
    share = expected / (w.counts() + 20)
    return np.stack([np.ones(w.rows), np.log1p(expected), np.log(share + 1e-4) - np.log(1e-4)], axis=1)


def _gathered(values: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label and features of all words, chain after chain, longest first, and the lengths of the chains.

    A word counts as offending if it is in a toxic document and has a feature that
    toxic documents have at least eight times as often. Texts are read slice by
    slice, twice, so that nothing but the result has the size of the sample.
    """
    parts = [(lo, values.slice(lo, hi - lo)) for lo, hi in tokens.pieces(values)]
    found = [chains(tokens.words(part, tokens.ALNUM)) for _, part in parts]
    counts = np.array([size.sum() for _, size in found], np.int64)
    feats, y = np.empty((1 + len(PREFIXES), counts.sum()), np.int32), np.empty(counts.sum(), bool)
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for (lo, part), at, to in zip(parts, np.cumsum(counts) - counts, np.cumsum(counts)):
        w = tokens.words(part, tokens.ALNUM)
        feats[:, at:to], y[at:to] = features(w), toxic[w.row + lo] == 1
        for f in feats[:, at:to]:
            pairs = np.unique(w.row * np.int64(BUCKETS) + f)
            label = toxic[pairs // BUCKETS + lo]
            for i in (0, 1):
                seen[i] += np.bincount(pairs[label == i] % BUCKETS, minlength=BUCKETS)
    rate = [(s + 1) / (np.sum(toxic == label) + 2) for label, s in enumerate(seen)]
    marked = (rate[1] > 8 * rate[0]) & (seen[1] >= 5)
    marked[0] = False
    first = np.concatenate([f + at for (f, _), at in zip(found, np.cumsum(counts) - counts)])
    size = np.concatenate([s for _, s in found])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    place = np.concatenate([tokens.spread(first[a:b], first[a:b] + size[a:b])[0].astype(np.int32) for a, b, _, _ in _groups(size)] or [first])
    hot = np.zeros(len(y), bool)
    for f in feats:
        hot |= marked[f]
        f[:] = f[place]
    return (hot & y)[place], feats, size


def _groups(size: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Ranges of chains of some ``GROUP`` words (a longer chain stands alone), and the ranges of their words."""
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, GROUP), side="right"), len(size)))
    at = np.append(0, ends)[cuts]
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist()))


def _add_slopes(model: Model, y: np.ndarray, feats: np.ndarray, size: np.ndarray, steps: list) -> None:
    """Adds the slopes of the likelihood of some chains, which stand one after the other: by weights, bias and moves."""
    ends = np.cumsum(size)
    e = model.emissions(feats).astype(float)
    forward, backward = model.passes(e, ends - size, size)
    error = y - _sigmoid(forward + backward)
    for f in feats:
        steps[0] += np.bincount(f, weights=error, minlength=BUCKETS)
    steps[1] += error.sum()
    steps_from = np.ones(len(y), bool)
    steps_from[ends - 1] = False
    at = np.flatnonzero(steps_from)  # words that have a next word in their chain
    gold = np.bincount(2 * y[at] + y[at + 1], minlength=4).reshape(2, 2)
    before, ahead = forward[at].astype(np.float32), (e[at + 1] + backward[at + 1]).astype(np.float32)
    pairs = np.stack([i * before + np.float32(model.moves[i, j]) + j * ahead for i in (0, 1) for j in (0, 1)])
    pairs -= pairs.max(axis=0)
    np.exp(pairs, out=pairs)
    pairs /= pairs.sum(axis=0)
    steps[2] += gold - pairs.sum(axis=1, dtype=np.float64).reshape(2, 2)


def fit(texts: list[str] | pa.Array | pa.ChunkedArray, toxic: np.ndarray, share_toxic: float) -> Model:
    """A model from labelled texts; ``share_toxic`` is the share of label 1 among all labelled rows."""
    values = tokens.column(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    toxic = np.asarray(toxic)
    test = np.random.default_rng(0).permutation(len(values)) % 4 == 3  # kept for the calibration
    y, feats, size = _gathered(values.filter(pa.array(~test)), toxic[~test])
    model = Model(np.zeros(BUCKETS, np.float32), -3.0, np.zeros((2, 2)), np.zeros(3))
    rate, scale = 0.25, [np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(STEPS if len(y) else 0):
        steps = [-0.01 * model.weights.astype(float), 0.0, np.zeros((2, 2))]
        for a, b, lo, hi in _groups(size):
            _add_slopes(model, y[lo:hi], feats[:, lo:hi], size[a:b], steps)
        steps[0][0] = 0
        scale = [s + g * g for s, g in zip(scale, steps)]
        model.weights += (rate * steps[0] / np.sqrt(scale[0])).astype(np.float32)
        model.bias += rate * steps[1] / np.sqrt(scale[1])
        model.moves += rate * steps[2] / np.sqrt(scale[2])
    del feats
    _calibrate(model, values.filter(pa.array(test)), toxic[test], share_toxic)
    return model


def _calibrate(model: Model, values: pa.Array, toxic: np.ndarray, share_toxic: float) -> None:
    """Logistic regression by Newton steps, with classes weighted to their share among all labels."""
    parts = []
    for lo, hi in tokens.pieces(values):
        w = tokens.words(values.slice(lo, hi - lo), tokens.ALNUM)
        parts.append(_document_features(w, model.marginals(w)))
    x = np.concatenate(parts)
    y = toxic.astype(float)
    of = np.array([np.sum(y == 0), np.sum(y == 1)]).clip(1)
    weight = np.where(y == 1, share_toxic / of[1], (1 - share_toxic) / of[0]) * len(y)
    ridge = np.array([1e-3, 0.2, 0.2])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(ridge * beta * beta))

    beta, stride = np.zeros(3), 1.0
    for _ in range(60):
        p = _sigmoid(x @ beta)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * beta)
        while stride > 1e-4 and loss(beta + stride * step) > loss(beta):
            stride /= 2
        beta, stride = beta + stride * step, min(1.0, 2 * stride)
    model.calibration = beta


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model | None:
    """Fits on labelled documents; None where not both labels occur.

    Null ids, labels and texts are left out; a document with both labels counts as toxic.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    )
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    picked = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS) for y in (0, 1)]
    short = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    got = short.join(picked[0].unionByName(picked[1]), "_id").select("_id", "_toxic", "_text").toArrow()
    got = got.sort_by([("_id", "ascending"), ("_text", "ascending")])
    toxic = got["_toxic"].to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    # the texts stay in Arrow's memory, which is given back when they have been used
    model = fit(got["_text"], toxic, sizes[1] / (sizes[0] + sizes[1]))
    del got
    pa.default_memory_pool().release_unused()
    return model


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def _spans(w: tokens.Words, p: np.ndarray) -> list[list[dict]]:
    """Runs of offending words of each row, as code point ranges with their largest marginal."""
    out: list[list[dict]] = [[] for _ in range(w.rows)]
    hot = np.flatnonzero(p >= SPAN_AT)
    if not len(hot):
        return out
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    last = -2
    for t in hot.tolist():
        row = int(w.row[t])
        base = points[w.offsets[row]]
        end, m = int(points[w.end[t]] - base), float(p[t])
        if t == last + 1 and w.row[last] == row:
            out[row][-1]["end"] = end
            out[row][-1]["marginal"] = max(out[row][-1]["marginal"], m)
        else:
            out[row].append({"start": int(points[w.start[t]] - base), "end": end, "marginal": m})
        last = t
    return out


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``spans``.

    Null and empty texts have no words and get the score of such documents;
    without a model every score is 0; repeated rows stay; own columns of these
    names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, m = tokens.column(batch.column(text)), sent.value
        scores, spans = np.zeros(len(texts)), []
        for lo, hi in tokens.pieces(texts) if m else ():
            w = tokens.words(texts.slice(lo, hi - lo), tokens.ALNUM)
            p = m.marginals(w)
            scores[lo:hi] = m.scores(w, p)
            spans += _spans(w, p)
        predicted = (scores >= threshold).astype(np.int32)
        return [pa.array(scores), pa.array(predicted, pa.int32()), pa.array(spans if m else [[]] * len(texts), _SPANS)]

    new = T.StructType(
        [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(_SPAN))]
    )
    return append_columns(docs, new, compute)
