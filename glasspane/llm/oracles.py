"""DuckDB SQL for the queries of this subpackage that SQL can express.

The trained, keyed and sketching operators have none; their tests hold them
against plain versions, round trips and held-out accuracy.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


ALNUM = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

OP4 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.id FROM dw JOIN bw USING (k, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


#: Kind, pattern, group whose length counts, least length, whether base: the contract's patterns, then the added ones.
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", "[0-9a-f]+", 0, 24, True),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, False),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
)


def _matches(number: int) -> str:
    """Spans of one rule: a match starts after the texts before it, which are its gaps and the earlier matches."""
    kind, pattern, group, least, base = SECRETS[number]
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS number, '{kind}' AS kind, {base} AS base, n, (sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) - n)::BIGINT AS start, kept
        FROM (SELECT doc_id, i, length(a[i]) AS gap, length(m[i]) AS n, length(g[i]) AS kept FROM (SELECT doc_id, a, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_split_to_array(text, '{p}') AS a, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g FROM documents WHERE regexp_matches(text, '{p}')))) QUALIFY kept >= {least}"""


OP5 = f"""
WITH s AS ({" UNION ALL ".join(_matches(i) for i in range(len(SECRETS)))}),
l AS (SELECT *, kind || ':' || start || ':' || (start + n) AS span FROM s),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(span, ',' ORDER BY start, number) FILTER (base) AS base, string_agg(span, ',' ORDER BY start, number) AS spans FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN f USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, b AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""


def _h(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


#: CRC-32 of a decimal number: bits go through the reversed polynomial, one after another.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))),
       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


def _tree(name: str, levels: int) -> str:
    """Tables of one tree for each g: {name}k has nodes (g, i, n, h), {name}fk the families (g, j, f); {name}top (g, h)."""
    out = []
    for k in range(levels):
        out.append(f"{name}f{k} AS (SELECT g, i // 8 AS j, any_value(n) AS n, list(h ORDER BY i) AS f FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT g, j AS i, (n + 7) // 8 AS n, sha256(array_to_string(f, '')) AS h FROM {name}f{k})")
    tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}top AS ({tops})"])


def _way(name: str, rows: str, levels: int, acc: str) -> str:
    """Of each row (g, i, ...): what stands beside it and its ancestors, and what ``acc`` folds to."""
    out = [f"{name}w0 AS (SELECT *, '' AS proof, {acc} AS fold FROM {rows})"]
    for k in range(levels):
        at = f"(r.i // {8**k}) % 8"
        left, right = f"coalesce(array_to_string(f.f[1 : {at}], ''), '')", f"coalesce(array_to_string(f.f[{at} + 2 :], ''), '')"
        fold = f"CASE WHEN f.f IS NULL THEN r.fold ELSE sha256({left} || r.fold || {right}) END"
        out.append(f"{name}w{k + 1} AS (SELECT r.* REPLACE (r.proof || {left} || {right} AS proof, {fold} AS fold) FROM {name}w{k} r LEFT JOIN {name}f{k} f ON f.g = r.g AND f.j = r.i // {8 ** (k + 1)})")
    return ",\n".join(out)


#: Levels written out in the SQL: enough for 2 million documents of a language, and for 64 languages.
DEEP, WIDE = 7, 2
OP11 = f"""
WITH d AS (SELECT coalesce('=' || lang, '') AS g, doc_id, sha256({_h("doc_id::VARCHAR")} || {_h("source")} || {_h("lang")} || {_h("n_chars::VARCHAR")} || {_h("text")}) AS h,
       CASE WHEN doc_id IS NOT NULL AND {CRC} % 3 = 0 THEN sha256({_h("doc_id::VARCHAR")} || {_h("source")} || {_h("lang")} || {_h("n_chars::VARCHAR")} || {_h(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed FROM documents),
t0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, doc_id, coalesce(changed, h) AS given FROM d),
{_tree("t", DEEP)},
u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM ttop),
{_tree("u", WIDE)},
{_way("t", "t0", DEEP, "given")},
x AS (SELECT a.doc_id, a.h AS leaf, u0.h AS subroot, a.proof AS below, 0 AS g, u0.i, a.fold AS given FROM tw{DEEP} a JOIN u0 ON u0.lang = a.g),
{_way("u", "x", WIDE, "given")}
SELECT w.doc_id, leaf, subroot, r.h AS root, sha256(below || proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM uw{WIDE} w, utop r
"""

BLANK_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, {BLANK_SPLIT} AS w FROM documents),
g AS (SELECT k, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (k) LEFT JOIN l USING (k)),
f AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS f FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
      unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) AS bad FROM m WHERE source IS NOT NULL) GROUP BY 1, 2),
s AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts, sum(n) - sum(n * n) / sum(n) AS room, sum(f * f / n) AS spread FROM f GROUP BY 1),
b AS (SELECT rule, mean, mean * (1 - mean) AS chance, room, CASE WHEN room > 0 THEN (spread - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / room END AS beyond FROM s),
p AS (SELECT rule, mean, CASE WHEN chance <= 0 OR beyond IS NULL OR beyond <= 0 THEN 1e6 ELSE least(greatest(chance / beyond - 1, 20), 1e6) END AS strength FROM b),
h AS (SELECT source, max((f + mean * strength) / (n + strength)) > 0.5 AS gone FROM f JOIN p USING (rule) GROUP BY 1),
o AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(gone, false) AS host_failed FROM m LEFT JOIN h USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept FROM o
"""

TERMS = _words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS often FROM (SELECT row_number() OVER () AS k, item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY k, item_id, t),
g AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
p AS (SELECT k, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3, 4),
df AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY t, docs),
s AS (SELECT item_id, k, doc_id, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (t) JOIN df USING (t), g GROUP BY 1, 2, 3)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {
    "op4_decontamination": OP4,
    "op5_secret_scan": OP5,
    "op8_jaccard_join": OP8,
    "op11_merkle_manifest": OP11,
    "op12_quality_rules": OP12,
    "op13_ranked_search": OP13,
}
