"""Quality rules that judge a document by itself and by its host, by DataFrame functions alone.

Each text is measured in its own row: words, symbols, repeated lines, words in
repeated 5-word windows. The rules that a document fails are then counted by
host, and each host's failure rate is shrunk towards the rate of all hosts by a
beta prior whose strength comes from how far the hosts differ beyond chance
(method of moments). A host of few documents so keeps the common rate, whatever
they look like; a host whose shrunk rate of any rule is above ``HOST_LIMIT`` is
rejected, and its verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.llm.rows import Scratch

#: Words are runs of anything but blanks; symbols and the window are fixed by the rules.
WORD, SYMBOL, WINDOW = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]", 5
#: A host goes if the shrunk share of its documents that fail one rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents: a host of fewer documents than the first stays near the common rate, however much hosts differ.
WEAKEST, STRONGEST = 20.0, 1e6
#: Documents of one host that are joined to its verdict in one task are dealt over so many salts.
SALTS = 64
#: Rules by name, over the measures of a text; the first two reject a document by themselves.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeats")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(starts: Column) -> Column:
    """Places that windows from these ascending starts cover together."""
    nexts = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1) + WINDOW))
    return F.aggregate(F.zip_with(starts, nexts, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)


def _shared(keyed: Column) -> Column:
    """Of ``key, i`` structs, sorted: the ``i`` whose key has an equal neighbour, ascending."""

    def mine(s: Column) -> Column:
        equal = lambda x, k: x["key"].eqNullSafe(F.get(s, k - 1)["key"]) | x["key"].eqNullSafe(F.get(s, k + 1)["key"])
        return F.transform(F.filter(s, equal), lambda x: x["i"])

    return F.sort_array(_let(F.sort_array(keyed), mine))


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a window of five that the text has twice or more.

    Windows are told apart by a hash first: windows whose hash is alone are
    alone. The few that share one are compared word by word.
    """
    window = lambda w, i: F.slice(w, i, WINDOW)
    keyed = lambda of, at, key: F.transform(at, lambda i: F.struct(key(window(of, i)).alias("key"), i.alias("i")))

    def exact(w: Column, hashes: Column) -> Column:
        maybe = _shared(F.transform(hashes, lambda h, k: F.struct(h.alias("key"), (k + 1).alias("i"))))
        starts = _shared(keyed(w, maybe, lambda x: F.array_join(x, " ")))
        return _let(starts, lambda s: F.when(F.size(s) > 0, _covered(s)).otherwise(0))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(window(w, i)))
        found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w, h)).otherwise(0))
        return F.when(F.size(w) > WINDOW, found).otherwise(0)

    return _let(words, of).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    A null text has no words; columns of these names are replaced.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    both = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    new = {"_words": _let(F.regexp_extract_all(content, F.lit(WORD), F.lit(0)), of), "_lines": _let(lines, both)}
    out = docs.withColumns({**new, "_symbols": F.regexp_count(content, F.lit(SYMBOL)).cast("long")})
    names = {"n_words": "_words.n_words", "word_chars": "_words.word_chars", "n_symbols": "_symbols", "n_lines": "_lines.n_lines", "n_dup_lines": "_lines.n_dup_lines", "n_repeat_words": "_words.n_repeat_words"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return out.select(*kept, *[F.col(at).alias(name) for name, at in names.items()])


def _strength(n: float, squares: float, hosts: float, failed: float, spread: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, from sums over hosts: n, n^2, 1, failures, failures^2 / n."""
    mean = failed / n if n else 0.0
    chance = mean * (1 - mean)
    room = n - squares / n if n else 0.0
    if chance <= 0 or room <= 0:
        return mean, STRONGEST
    beyond = (spread - n * mean * mean - (hosts - 1) * chance) / room
    return mean, min(max(chance / beyond - 1, WEAKEST), STRONGEST) if beyond > 0 else STRONGEST


def host_rates(rows: DataFrame, host: str = "host") -> DataFrame:
    """``host, n, rejected`` and for each rule its failures ``f_<rule>`` and shrunk rate ``r_<rule>``, of measured rows.

    Rows without a host are no host. Rows of one host are counted before they
    are dealt; the driver sees sums over all hosts alone.
    """
    counts = [F.count_if(F.expr(rule)).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *counts)
    sums = [F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("hosts")]
    for name in RULES:
        f = F.col(f"f_{name}").cast("double")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f * f / F.col("n")).alias(f"s_{name}")]
    s = hosts.agg(*sums).first().asDict()
    rates = {}
    for name in RULES:
        mean, strength = _strength(s["n"] or 0.0, s["squares"] or 0.0, s["hosts"], s[f"f_{name}"] or 0.0, s[f"s_{name}"] or 0.0)
        rates[f"r_{name}"] = (F.col(f"f_{name}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    hosts = hosts.withColumns(rates)
    return hosts.withColumn("rejected", F.greatest(*[F.col(f"r_{name}") for name in RULES]) > HOST_LIMIT)


def judged(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, host``, the measures, ``failed`` (names of rules), ``base_failed, host_failed, kept`` of every row.

    A null or empty text has no words and fails as short. A document without a
    host is judged by itself alone. Repeated rows and ids are judged each by
    itself; other columns do not matter, whatever their names; an empty table
    gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text"))
    rows = scratch.save(measured(rows, "_text").drop("_text"), "measures")
    hosts = scratch.save(host_rates(rows), "hosts")
    # one host may own a third of all rows: its verdict goes to every salt, its rows to one each
    gone = hosts.where("rejected").select(F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    joined = salted.join(gone, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    base = F.expr(" or ".join(f"({RULES[name]})" for name in BASE))
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]))
    out = joined.select(*rows.columns, failed.alias("failed"), base.alias("base_failed"), F.col("_host").isNotNull().alias("host_failed"))
    return scratch.finish(out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")), "quality")
