"""What the driver holds at once: working memory of the fit, size of the plans."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from glasspane.llm import linededup, rows, toxicity

WORDS = [f"w{i}" for i in range(900)]


def test_the_fit_needs_little_beside_the_features_of_its_sample(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    rnd = random.Random(5)
    toxic = np.arange(3000) % 2
    texts = pa.array([" ".join(rnd.choices(WORDS, k=400)) + (" vileword" if y else "") for y in toxic])
    n_words = 400 * len(texts) + int(toxic.sum())
    tracemalloc.start()
    toxicity.fit(texts, toxic, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = 4 * (1 + len(toxicity.PREFIXES)) * n_words * 3 // 4
    assert peak < 2 * features + 16 * 8 * toxicity.BUCKETS


def test_the_size_of_a_group_of_chains_does_not_change_the_model(monkeypatch):
    rnd = random.Random(6)
    toxic = np.arange(80) % 2
    texts = ["\n".join(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 30))) for _ in range(5)) + (" vileword" * 2 if y else "") for y in toxic]
    one = toxicity.fit(texts, toxic, 0.5)
    monkeypatch.setattr(toxicity, "GROUP", 50)
    two = toxicity.fit(texts, toxic, 0.5)
    assert one.weights.any() and np.allclose(one.weights, two.weights, atol=1e-4)
    assert np.allclose(one.moves, two.moves) and np.allclose(one.calibration, two.calibration, atol=1e-3)


def test_plans_of_line_dedup_stay_small_when_repeats_have_many_lengths(spark, monkeypatch):
    rnd, joins, write = random.Random(8), [], rows.saved

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return df

    save = rows.Scratch.save
    monkeypatch.setattr(rows, "saved", lambda df, name: write(counted(df), name))
    monkeypatch.setattr(rows.Scratch, "save", lambda self, df, name: save(self, counted(df), name))
    data = []
    for k in range(1, 14, 2):  # a run of k lines of 12 // k words or more, twice
        run = "\n".join(" ".join(f"x{k}.{rnd.random()}" for _ in range(-(-12 // k))) for _ in range(k))
        data += [(k, run), (100 + k, f"own {k}\n{run}")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    cut = {r.doc_id: r.cut for r in linededup.repeated_lines(docs, min_words=12).collect()}
    assert cut == {100 + k: list(range(1, k + 1)) for k in range(1, 14, 2)}
    assert max(joins) <= 3, joins
