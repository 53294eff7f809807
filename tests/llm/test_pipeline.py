"""Every stage on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, f"{text(40)}\n{text(30)}") for i in range(120)]
    docs += [(200 + i, f"{text(30)} vileword {text(5)} vileword nastyword") for i in range(20)]
    passage, item = text(60), text(30)
    docs += [(300 + i, f"{text(30)}\n{passage}\n{text(10)}") for i in range(3)]
    near = text(120).split()
    docs += [(400 + i, " ".join([*near[: 30 * i], "changed", *near[30 * i :]])) for i in range(3)]
    docs += [(500, f"{text(20)} {item} {text(5)}"), (501, None), (502, "")]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_stages(spark, folder):
    path, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.saved(stage(spark, docs, path), name)
        if name != "mixing":
            assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(120)) | {501, 502}
    assert all(clean <= set(k) for k in kept.values())
    assert not set(range(200, 220)) & set(kept["toxicity"])
    assert [passage in kept["line_dedup"][300 + i].text for i in range(3)] == [True, False, False]
    assert [400 + i in kept["ngram_jaccard_join"] for i in range(3)] == [True, False, False]
    assert 500 in kept["ngram_jaccard_join"] and 500 not in kept["benchmark_decontamination"]
    assert set(kept["mixing"]) == set(kept["benchmark_decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(kept["mixing"])
