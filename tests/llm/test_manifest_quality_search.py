"""Merkle manifests, quality rules and ranked search against plain versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.llm import merkle, quality, queries, search

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, steps int, id int, host string, kept int, rank int, score double, query int, salt int, n long, lo int, query_text string"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those of the operators."""
    extra = ("x", 1, 2, "h", 3, 4, 0.5, 6, 7, 8, 9, "q")
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).repartition(parts)


def read_as(monkeypatch, **tables):
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: tables[name])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf its (left, right) siblings from the leaf up."""
    level, ways, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            ways[k].append((run[: i % 8], run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], ways


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(t))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in langs]
    trees = [tree([leaf(r, r[1]) for r in g]) for g in groups]
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (sub, ways), above in zip(groups, trees, over):
        for r, way in zip(g, ways):
            given = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            acc = leaf(r, r[1].translate(LOWER) if given else r[1])
            for left, right in way + above:
                acc = sha("".join([*left, acc, *right]))
            proof = sha("".join("".join(a + b) for a, b in way + above))
            out.append((r[0], leaf(r, r[1]), sub, root, proof, acc, acc == root))
    return out


@pytest.mark.parametrize("langs", [[None, "", "a", "é", "b", "c", "d", "e", "f", "g"], ["a"], [None, "a"]])
def test_manifest_equals_plain_version(spark, monkeypatch, langs):
    rnd = random.Random(len(langs))
    rows = [(i, rnd.choice(["Some Text", None, "", "é A", "low"]) , rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([7, None])) for i in range(150)]
    rows += [(None, "no id", langs[0], "s", 1), (None, None, langs[0], None, None), (3, "Twice", langs[-1], "s", 5), (3, "Twice", langs[-1], "s", 5), (900, "alone" * 9000, "zz", "s", 5)]
    read_as(monkeypatch, documents=table(spark, rows))
    got = queries.op11_merkle_manifest(spark, "")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_few_rows(spark, monkeypatch):
    for rows in ([], [(1, "A", "x", "s", 1)], [(None, None, None, None, None)]):
        read_as(monkeypatch, documents=table(spark, rows))
        got = queries.op11_merkle_manifest(spark, "").collect()
        assert list(map(tuple, got)) == (plain_manifest(rows) if rows else [])


def test_tampering_is_seen(spark, monkeypatch):
    rows = [(i, "Capital" if i % 2 else "small", "x", "s", 1) for i in range(40)]
    read_as(monkeypatch, documents=table(spark, rows))
    got = {r.doc_id: r.verified for r in queries.op11_merkle_manifest(spark, "").collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(40) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {p for i, x in enumerate(windows) if counts[x] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def noisy(rnd):
    words = ["a", "b", "c", "É😀", "d#", "<e>", "x y"]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "\t", "\n\n", " \x0b"]) for _ in range(rnd.randint(0, 60)))


def test_measures_equal_plain_version(spark):
    rnd = random.Random(3)
    texts = [noisy(rnd) for _ in range(300)] + [None, "", " \n", "a a a a a a", "a b c d e", "\n".join(["same line"] * 9), "one two three four five " * 2, "w" * 200_000]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(30_000))]
    got = quality.measured(table(spark, [(i, t, "x", "s", 1) for i, t in enumerate(texts)])).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_hosts_are_shrunk_and_joined_back(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too few words"
    rows = [(i, bad if i % 10 else good, "x", "spam", 1) for i in range(200)]  # nine tenths fail
    rows += [(1000 + i, bad if i % 50 == 0 else good, "x", f"host{i % 7}", 1) for i in range(700)]
    rows += [(5000, bad, "x", "once", 1), (5001, good, "x", "once", 1), (5002, bad, "x", "single", 1), (5003, good, "x", None, 1), (5004, None, "x", None, 1), (5003, good, "x", None, 1), (None, good, "x", "spam", 1)]
    got = quality.judged(table(spark, rows)).collect()
    assert len(got) == len(rows)
    gone = {r.host for r in got if r.host_failed}
    assert gone == {"spam"}  # one failing document does not condemn a host of one
    want = sorted((repr((i, plain_measures(t)[0], s != "spam" and plain_measures(t)[0] >= 10)) for i, t, _, s, _ in rows))
    assert sorted(repr((r.doc_id, r.n_words, r.kept)) for r in got) == want
    assert {tuple(r.failed) for r in got if r.host == "single"} == {("short",)}


def test_strength_of_the_prior():
    mean, strength = quality._strength(100.0, 10_000.0, 1, 50.0, 25.0)  # one host tells nothing of how hosts differ
    assert mean == 0.5 and strength == quality.STRONGEST
    sums = lambda hosts: (sum(n for n, _ in hosts), sum(n * n for n, _ in hosts), len(hosts), sum(f for _, f in hosts), sum(f * f / n for n, f in hosts))
    mean, strength = quality._strength(*map(float, sums([(1000, 900), *[(1000, 20)] * 9])))
    assert 0.1 < mean < 0.11 and strength == quality.WEAKEST  # hosts differ far beyond chance
    assert quality._strength(*map(float, sums([(1000, 50)] * 10)))[1] == quality.STRONGEST


def test_quality_of_empty_tables(spark, monkeypatch):
    read_as(monkeypatch, documents=table(spark, []))
    assert queries.op12_quality_rules(spark, "").count() == 0
    read_as(monkeypatch, documents=table(spark, [(None, None, None, None, None)]))
    assert [r.kept for r in queries.op12_quality_rules(spark, "").collect()] == [False]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranks(docs, items, top=20):
    words = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def searched(spark, docs, items):
    d = table(spark, [(i, t, "x", "s", 1) for i, t in docs])
    q = spark.createDataFrame([(i, t, 0.5, 1) for i, t in items], "item_id long, text string, score double, rank int")
    return [tuple(r) for r in search.ranked(d, q).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_ranks_equal_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    rnd = random.Random(9)
    pick = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)] + ["Über", "x_y"]
    docs = [(i, pick(rnd.randint(0, 60))) for i in range(400)]
    docs += [(None, docs[5][1]), (None, None), (7, docs[7][1]), (7, docs[7][1]), (9000, ""), (9001, pick(30_000))] + [(10_000 + i, "tie tie rare") for i in range(60)]
    items = [(i, pick(12)) for i in range(12)] + [(50, "Tie, tie RARE"), (51, None), (52, "nowhere"), (None, "tie"), (53, "tie")]
    assert sorted(map(repr, searched(spark, docs, items))) == sorted(map(repr, plain_ranks(docs, items)))


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_terms_of_equal_hash_stay_apart(monkeypatch):
    from glasspane.llm import tokens

    real = tokens.words

    def clash(values, chars):
        w = real(values, chars)
        w.hash = np.ones_like(w.hash)
        return w

    monkeypatch.setattr(search.tokens, "words", clash)
    v = search.Vocabulary.of(["b a", "ccc a a"])
    w = clash(search.pa.array(["a zz b ccc q"]), tokens.ALNUM)
    assert [bytes(v.data[v.start[t] : v.start[t] + v.size[t]]).decode() if t >= 0 else None for t in v.numbers(w)] == ["a", None, "b", "ccc", None]


def test_common_terms_open_no_accumulators():
    v = search.Vocabulary.of(["rare common"])
    number = {bytes(v.data[s : s + n]).decode(): t for t, (s, n) in enumerate(zip(v.start, v.size))}
    n = 10_000
    df = np.zeros(2, np.int64)
    df[number["rare"]], df[number["common"]] = 100, n
    ranker = search.Ranker(v, df, n, 50 * n, 20)
    row = np.concatenate([np.arange(n), np.arange(100)])
    term = np.concatenate([np.full(n, number["common"]), np.full(100, number["rare"])])
    ranker.add(np.arange(n), np.zeros(n, bool), np.full(n, 50), row, term, np.ones(len(row), np.int64))
    assert ranker.created == 100 and sorted(ranker.best[0][1].tolist()) == list(range(20))
