"""Soft-membership mixing to target weights, by DataFrame functions alone.

A classifier learned from a labelled table (Gaussian naive Bayes over a few
text measures, from one aggregation of all labelled rows) gives each document a
posterior over domains. Projected-gradient least squares then finds
nonnegative document rates for which the expected tokens of the domains, the
sums of rate x tokens x posterior, match the targets. Every step is one
aggregation of domains x domains numbers; the step is scaled by the Gram
matrix of the documents that are not at zero.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.llm.rows import Scratch

MAX_DOMAINS = 64
STEPS = 40
#: Largest difference from the targets, as a share of all tokens, at which the steps end.
TOLERANCE = 1e-9
#: Least variance of a measure within a domain, as a share of its overall variance.
FLOOR = 1e-3


def measured(text: Column) -> dict[str, Column]:
    """Measures of a text: tokens, and shares of its characters and words."""
    text = F.coalesce(text, F.lit(""))
    chars, found = F.length(text), F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    words = F.size(found)
    share = lambda n: n / F.greatest(chars, F.lit(1))
    return {
        "tokens": words.cast("long"),
        "length": F.log1p(words.cast("double")),
        "word": F.log1p(chars / F.greatest(words, F.lit(1))),
        "marks": F.log(share(F.regexp_count(text, F.lit(r"[#$%&*+/<=>@\\^_`{|}~]"))) + 1e-3),
        "capitals": F.log(share(F.regexp_count(text, F.lit(r"[A-Z]"))) + 1e-3),
        "digits": F.log(share(F.regexp_count(text, F.lit(r"[0-9]"))) + 1e-3),
        "distinct": F.log(F.size(F.array_distinct(found)) / F.greatest(words, F.lit(1)) + 1e-3),
    }


MEASURES = ("length", "word", "marks", "capitals", "digits", "distinct")


def fit(labelled: DataFrame, domain: str) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """Of each domain: log prior and (mean, variance) of each measure, from one aggregation."""
    moments = [f(m).alias(f"{n}_{m}") for m in MEASURES for n, f in (("mean", F.avg), ("var", F.var_pop))]
    got = labelled.groupBy(F.col(domain).cast("string").alias("d")).agg(F.count("*").alias("n"), *moments).where("d is not null").orderBy("d")
    rows = got.limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    total = sum(r["n"] for r in rows)
    out = {}
    for r in rows:
        pairs = []
        for m in MEASURES:
            mean = sum(s["n"] * s[f"mean_{m}"] for s in rows) / total
            overall = sum(s["n"] * (s[f"var_{m}"] + (s[f"mean_{m}"] - mean) ** 2) for s in rows) / total
            pairs.append((r[f"mean_{m}"], max(r[f"var_{m}"], FLOOR * overall, 1e-9)))
        out[r["d"]] = (math.log(r["n"] / total), pairs)
    return out


def posteriors(model: dict[str, tuple[float, list[tuple[float, float]]]]) -> Column:
    """The domains' posteriors as an array in the order of the model."""
    logs = []
    for prior, pairs in model.values():
        z = F.lit(prior)
        for m, (mean, var) in zip(MEASURES, pairs):
            z = z - (F.col(m) - mean) * (F.col(m) - mean) / (2 * var) - 0.5 * math.log(var)
        logs.append(z)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = F.transform(F.array(*logs), lambda z: F.exp(z - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the steps so far: from 1, less posterior x step, never below 0."""
    if not steps:
        return F.lit(1.0)
    table = F.lit(steps)

    def move(r: Column, v: Column) -> Column:
        product = F.aggregate(F.zip_with("_p", v, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), r - product)

    return F.aggregate(table, F.lit(1.0), move)


def rates(docs: DataFrame, targets: np.ndarray) -> list[list[float]]:
    """Steps that lead from rate 1 to rates whose expected tokens (by domain) match ``targets``.

    ``docs`` has tokens and the posterior as an array ``_p``. Each projected step is halved while it
    does not lessen the squared difference; the driver sees sums only.
    """
    k = len(targets)

    def state(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        live = docs.select("tokens", "_p", _rate(steps).alias("r"))
        p = [F.get("_p", F.lit(i)) for i in range(k)]
        sums = [F.sum(F.col("r") * F.col("tokens") * p[i]).alias(f"s{i}") for i in range(k)]
        grams = [F.sum(F.when(F.col("r") > 0, F.col("tokens") * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        row = live.agg(*sums, *grams).first()
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), gram

    steps: list[list[float]] = []
    total = max(float(targets.sum()), 1.0)
    now, gram = state(steps)
    for _ in range(STEPS):
        miss = now - targets
        if np.abs(miss).max() <= TOLERANCE * total:
            break
        step = np.linalg.lstsq(gram + 1e-12 * np.trace(gram) * np.eye(k), miss, rcond=1e-12)[0]
        for _ in range(6):
            then, then_gram = state([*steps, step.tolist()])
            if np.sum((then - targets) ** 2) < np.sum(miss**2) * (1 - 1e-6):
                break
            step = step / 2
        else:
            break
        steps, now, gram = [*steps, step.tolist()], then, then_gram
    return steps


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "quality", text: str = "text", doc_id: str = "doc_id", tokens: float | None = None
) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate`` for every row of ``docs``.

    ``targets`` gives each domain's share of the ``tokens`` wanted (default: as
    many as there are); shares are scaled to 1 and a domain without one gets 0.
    ``posterior`` maps each domain to its probability. Null and empty texts have
    no tokens and do not matter to the sums; repeated rows each have a rate;
    null labels and ids teach nothing; labels of one id with several values
    teach each. If nothing can be learned the posterior is empty and the rate 1.
    """
    m = measured(F.col(text))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in m.items()]), "measures")
    known = labels.where(F.col(domain).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(domain).alias("_domain")).distinct()
    model = fit(rows.join(known, "doc_id"), "_domain")
    if not model:
        none = F.create_map().cast("map<string,double>")
        return scratch.finish(rows.select("doc_id", F.col("tokens").alias("n_tokens"), none.alias("posterior"), F.lit(1.0).alias("rate")), "rates")
    names = list(model)
    soft = scratch.finish(rows.select("doc_id", "tokens", posteriors(model).alias("_p")), "posteriors")
    wanted = np.array([max(0.0, float(targets.get(n, 0.0))) for n in names])
    if wanted.sum() <= 0:
        raise ValueError("no target for any domain of the labels")
    if tokens is None:
        tokens = float(soft.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    steps = rates(soft, wanted / wanted.sum() * tokens)
    return soft.select("doc_id", F.col("tokens").alias("n_tokens"), F.map_from_arrays(F.lit(names), "_p").alias("posterior"), _rate(steps).alias("rate"))
