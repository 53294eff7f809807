"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from glasspane.functions.text import ALPHABET, BIDI, CLOUDS, RESERVED, SHOWN
from glasspane.operators.findings import RIFF_INFO

BITS = "0000000100100011010001010110011110001001101010111100110111101111"


def _class(n: str) -> str:
    e = f"(length(bin({n})) - 1)"
    mask = f"((1::BIGINT << ({e} - length(bin({e}::BIGINT)))::INT) - 1)"
    return f"(CASE WHEN {n} <= 256 THEN 256 ELSE ({n} + {mask}) & ~{mask} END)::BIGINT"


def _chunks(n: str) -> str:
    return f"greatest(1, ({n} + 65535) // 65536)::BIGINT"


def _stanzas(n: str) -> str:
    return f"(CASE WHEN {n} >= 16 THEN {n} WHEN {n} <= 2 THEN 2 ELSE 1::BIGINT << length(bin(({n} - 1)::BIGINT))::INT END)::BIGINT"


def _b32(hexed: str) -> str:
    """Base32 of bytes given in upper-case hex."""
    bits = f"list_aggregate(list_transform(range(1, length({hexed}) + 1), lambda i: substr('{BITS}', (strpos('0123456789ABCDEF', substr({hexed}, i, 1)) * 4 - 3)::INT, 4)), 'string_agg', '')"
    value = "+".join(f"substr(rpad(substr(bits, (i * 5 + 1)::INT, 5), 5, '0'), {k + 1}, 1)::INT * {16 >> k}" for k in range(5))
    return f"(SELECT list_aggregate(list_transform(range(0, (length(bits) + 4) // 5), lambda i: substr('{ALPHABET}', ({value}) + 1, 1)), 'string_agg', '') FROM (SELECT {bits} AS bits))"


def _shown(v: str) -> str:
    return f"CASE WHEN length({v}) > {SHOWN} THEN left({v}, {SHOWN}) || '…' ELSE {v} END"


SEGMENT = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEVERITY = "CASE WHEN event_type IN ('purchase', 'signup') THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END"
FINDINGS = f"SELECT user_id AS artifact_id, event_id AS ord, event_type AS kind, 'props:' || (event_id % 3) AS location, props AS value, {SEVERITY} AS severity FROM events"
HEX64 = lambda prefix, n: f"sha256('{prefix}:' || {n})"
FP = (
    f"sha256(encode('fp-v2') || unhex({HEX64('enc', 'c_custkey')}) || "
    f"CASE WHEN c_custkey % 3 != 0 THEN unhex('01' || {HEX64('sig', 'c_custkey')}) ELSE unhex(repeat('00', 33)) END || "
    f"CASE WHEN c_custkey % 2 = 0 THEN unhex('01' || repeat({HEX64('pq', 'c_custkey')}, 38)) ELSE unhex(repeat('00', 1217)) END)"
)
STATE = "(['seen', 'verified', 'changed', 'revoked'])[(c_custkey % 4 + 1)::INT]"


def _names(table: dict, tag: str) -> str:
    return "CASE " + " ".join(f"WHEN {tag} = '{k}' THEN '{kind}:{sev}'" for (kind, sev), keys in table.items() for k in keys) + " ELSE 'comment:1' END"


def _sessions(where: str, limit: int) -> str:
    return f"""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {limit}000000 THEN 1 ELSE 0 END AS o
        FROM events WHERE {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM e)
        SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL"""


def _png(stamped: str) -> str:
    return f"(8 + 25 + 12 + strlen(source) + 1 + strlen(text) + CASE WHEN {stamped} THEN 12 + 8 ELSE 0 END + 12 + 10 + 12)"




def _hmac(key: str, message: str) -> str:
    """HMAC with SHA-256 (both as hex of 64 digits and a blob): the key's bytes with 36 and 5C by exclusive or, filled up to 64 bytes."""
    padded = lambda byte: f"unhex(list_aggregate(list_transform(range(32), lambda i: printf('%02X', xor(('0x' || substr({key}, (2 * i + 1)::INT, 2))::INT, {int(byte, 16)}))), 'string_agg', '') || '{byte * 32}')"
    return f"sha256({padded('5C')} || unhex(sha256({padded('36')} || {message})))"


_GROUPS = " || ' ' || ".join(f"lpad((('0x' || substr(o, {i * 16 + 1}, 16))::UBIGINT % 100000)::VARCHAR, 5, '0')" for i in range(12))
SAFETY = f"""WITH k AS (SELECT c_custkey, {{fp}} AS fp FROM customer), p AS (SELECT a.c_custkey, sha256(encode('sn-v2') || unhex(least(a.fp, b.fp)) || unhex(greatest(a.fp, b.fp))) AS base FROM k a JOIN k b ON b.c_custkey = a.c_custkey + 1),
        e AS (SELECT c_custkey, {_hmac("repeat('0', 64)", "unhex(base)")} AS prk FROM p), t1 AS (SELECT *, {_hmac("prk", "encode('sn-digits') || unhex('01')")} AS t1 FROM e),
        t2 AS (SELECT *, {_hmac("prk", "unhex(t1) || encode('sn-digits') || unhex('02')")} AS t2 FROM t1), t3 AS (SELECT *, {_hmac("prk", "unhex(t2) || encode('sn-digits') || unhex('03')")} AS t3 FROM t2)
        SELECT c_custkey, {_GROUPS} AS number FROM (SELECT c_custkey, t1 || t2 || t3 AS o FROM t3)"""
#: Lines of an order as entries of an archive.
ZIPS = """z AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, (['', 'home/me/', 'C:\\x\\', 'docs/'])[l_suppkey % 4 + 1]) AS k, l_partkey % 3 = 0 AS picture, CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 8 END::INT AS method,
        (['', 'home/me/', 'C:\\x\\', 'docs/'])[l_suppkey % 4 + 1] || 'f' || l_partkey AS name, ([NULL, 'unix home directory', 'absolute path with drive letter', NULL])[l_suppkey % 4 + 1] AS leak,
        CASE WHEN l_partkey % 3 = 0 THEN 82 ELSE l_linenumber END::BIGINT AS size FROM lineitem)"""

ORACLES: dict[str, str] = {
    "padme_histogram": f"""SELECT padded_size, count(*) AS n_docs, sum(padded_size - n)::BIGINT AS waste
        FROM (SELECT strlen(text) AS n, {_class('strlen(text)')} AS padded_size FROM documents) GROUP BY 1""",
    "padme_waste_by_source": f"""SELECT source, sum(n)::BIGINT AS bytes, sum(p - n)::BIGINT AS padding, max(p - n)::BIGINT AS most
        FROM (SELECT source, strlen(text) AS n, {_class('strlen(text)')} AS p FROM documents) GROUP BY 1""",
    "length_classes": f"SELECT count(DISTINCT strlen(text)) AS lengths_before, count(DISTINCT {_class('strlen(text)')}) AS classes_after FROM documents",
    "chunk_and_cipher_length": f"SELECT doc_id, strlen(text)::BIGINT AS n, {_chunks('strlen(text)')} AS chunks, (strlen(text) + 16 * {_chunks('strlen(text)')})::BIGINT AS cipher_bytes FROM documents",
    "recipient_padding": f"""SELECT recipients, count(*) AS messages, {_stanzas('recipients')} AS stanzas
        FROM (SELECT l_orderkey, count(*) AS recipients FROM lineitem GROUP BY 1) GROUP BY 1""",
    "envelope_size_by_suite": f"""WITH d AS (SELECT {_class('strlen(text)')} AS n, doc_id % 5 + 1 AS r, ((33 + 35 + strlen(source) + 3 + 255) // 256) * 256 AS h FROM documents),
        s AS (SELECT suite, (5 + {_stanzas('r')} * (stanza + 3) + 4 + h + 16 + n + 16 * {_chunks('n')} + 80)::BIGINT AS size FROM d, (VALUES ('classical', 80), ('hybrid', 1168)) AS s(suite, stanza))
        SELECT suite, sum(size)::BIGINT AS total_bytes, min(size) AS least, max(size) AS most FROM s GROUP BY 1""",
    "stanza_order": f"SELECT l_orderkey, array_to_string(list_transform(list_sort(list({HEX64('stanza', 'l_suppkey')})), lambda x: left(x, 8)), ',') AS stanzas FROM lineitem GROUP BY 1",
    "format_verdict_documents": "SELECT source, '' AS format, '' AS hint, 'no statement' AS verdict, count(*) AS files FROM documents GROUP BY 1",
    "format_verdict_pages": "SELECT '' AS format, 'no statement' AS verdict, count(*) AS files FROM pages",
    "format_of_derived_files": """SELECT (['PNG', 'JPEG', 'GIF', 'TIFF', 'Matroska', 'Ogg', 'PDF', 'ZIP', 'SVG', ''])[(doc_id % 10 + 1)::INT] AS format,
        (['', '', 'GIF', '', '', '', 'PDF', 'ZIP container', '', 'gzip'])[(doc_id % 10 + 1)::INT] AS hint, count(*) AS files FROM documents GROUP BY 1, 2""",
    "archive_kinds": """WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey % 7) AS k FROM lineitem GROUP BY 1)
        SELECT CASE WHEN list_contains(k, 0) AND list_contains(k, 1) THEN 'Word' WHEN list_contains(k, 0) AND list_contains(k, 2) THEN 'Excel'
        WHEN list_contains(k, 0) AND list_contains(k, 3) THEN 'PowerPoint' WHEN list_contains(k, 4) THEN 'EPUB' WHEN list_contains(k, 6) THEN 'APK'
        WHEN list_contains(k, 5) THEN 'JAR' ELSE 'archive' END AS kind, count(*) AS archives FROM a GROUP BY 1""",
    "size_gate": "SELECT strlen(text) <= 4096 AS accepted, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    "png_findings": """SELECT doc_id AS artifact_id, 0 AS ord, 'comment' AS kind, 'PNG:tEXt' AS location, source AS value, 1 AS severity FROM documents
        UNION ALL SELECT doc_id, 1, 'timestamp', 'PNG:tIME', NULL, 1 FROM documents WHERE doc_id % 2 = 0""",
    "png_cleaning": f"SELECT doc_id AS artifact_id, {_png('doc_id % 2 = 0')}::INT AS bytes, 67 AS clean_bytes, true AS stable, 0 AS left, 'confirmed' AS verdict FROM documents",
    "riff_info_findings": f"""WITH f AS (SELECT c_custkey AS artifact_id, 0 AS ord, 'IART' AS tag, c_name AS value FROM customer
        UNION ALL SELECT c_custkey, 1, 'ICMT', c_mktsegment FROM customer)
        SELECT artifact_id, ord, tag, value, split_part({_names(RIFF_INFO, 'tag')}, ':', 1) AS kind, split_part({_names(RIFF_INFO, 'tag')}, ':', 2)::INT AS severity FROM f""",
    "riff_cleaning": """WITH s AS (SELECT c_custkey, strlen(c_name) + 1 AS a, strlen(c_mktsegment) + 1 AS b FROM customer),
        t AS (SELECT c_custkey, (12 + 24 + 8 + 4 + 8 + a + a % 2 + 8 + b + b % 2 + 12)::INT AS bytes FROM s)
        SELECT c_custkey AS artifact_id, bytes, bytes AS clean_bytes, 0 AS left, 'WAV' AS format FROM t""",
    "flac_comments": """SELECT s_suppkey AS artifact_id, 0 AS ord, 'Artist' AS key, s_name AS value, 'author' AS kind, 2 AS severity FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'DATE', s_nationkey::VARCHAR, 'timestamp', 1 FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'note', s_suppkey::VARCHAR, 'comment', 1 FROM supplier""",
    "pdf_findings": """SELECT s_suppkey AS artifact_id, 0 AS ord, 'author' AS kind, 'PDF:Author' AS location, s_name AS value, 2 AS severity FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'software', 'PDF:Producer', 'tool', 1 FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'tracked change', 'PDF:history', (s_suppkey % 3 + 1) || ' revisions', 2 FROM supplier WHERE s_suppkey % 3 > 0""",
    "pdf_revisions": """WITH s AS (SELECT s_suppkey, unnest(range(1, s_suppkey % 3 + 2)) AS number, strlen(s_name) AS n FROM supplier)
        SELECT s_suppkey AS artifact_id, number::INT AS number, (9 + 20 + n + 29 + 14 * number)::INT AS bytes FROM s""",
    "html_outside_refs": """WITH r AS (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) AS r FROM pages)
        SELECT page_id, length(r)::INT AS n_refs, length(list_filter(r, lambda x: NOT (trim(x) = '' OR starts_with(trim(x), '#') OR starts_with(trim(x), 'data:'))))::INT AS n_outside FROM r""",
    "html_active_content": rf"""SELECT page_id, length(regexp_extract_all(html, '<script'))::INT AS scripts, length(regexp_extract_all(html, '<!--'))::INT AS comments,
        length(regexp_extract_all(html, '\son[a-z]+='))::INT AS handlers, {_shown("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages""",
    "path_leaks": rf"""WITH n AS (SELECT unnest(string_split(text, chr(10))) AS name FROM documents
        UNION ALL SELECT (['C:\Users\', 'home/', 'x/HOME/', 'D:/', 'share/'])[(page_id % 5 + 1)::INT] || {SEGMENT} FROM pages),
        l AS (SELECT name, replace(translate(name, '{UPPER}', '{LOWER}'), '\', '/') AS low FROM n)
        SELECT CASE WHEN starts_with(low, 'users/') OR contains(low, '/users/') THEN 'windows user path' WHEN starts_with(low, 'home/') OR contains(low, '/home/') THEN 'unix home directory'
        WHEN regexp_matches(name, '^[A-Za-z]:[/\\]') THEN 'absolute path with drive letter' ELSE 'none' END AS leak, count(*) AS names FROM l GROUP BY 1""",
    "filename_gate": rf"""WITH n AS (SELECT (['', 'con.', 'a:b ', chr(8238), chr(9), 'nul'])[(page_id % 6 + 1)::INT] || {SEGMENT} AS name FROM pages)
        SELECT CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '[/\\:]') THEN 'separator' WHEN name IN ('.', '..') THEN 'path element'
        WHEN regexp_matches(name, '[\x00-\x1F\x7F\x{{80}}-\x{{9F}}]') THEN 'control character' WHEN regexp_matches(name, '[{BIDI}]') THEN 'bidi override'
        WHEN upper(split_part(name, '.', 1)) IN {RESERVED} THEN 'reserved name' ELSE 'accepted' END AS fault, count(*) AS names FROM n GROUP BY 1""",
    "cleaned_names": rf"""WITH n AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, {SEGMENT} || '.clean.html' AS name FROM pages),
        k AS (SELECT *, row_number() OVER (PARTITION BY host, name ORDER BY page_id) AS k FROM n)
        SELECT page_id, name, CASE WHEN k = 1 THEN name ELSE regexp_extract(name, '^(.+?)(\.[^.]+)?$', 1) || ' (' || k || ')' || regexp_extract(name, '^(.+?)(\.[^.]+)?$', 2) END AS free_name FROM k""",
    "value_truncation": f"SELECT doc_id, {_shown('text')} AS value FROM documents",
    "keep_first_collapse": f"""WITH f AS ({FINDINGS}) SELECT artifact_id, min(ord) AS ord, kind, location,
        CASE WHEN count(*) > 1 THEN count(*) || ' segments' || coalesce(', each ' || arg_min(value, ord), '') ELSE arg_min(value, ord) END AS value,
        arg_min(severity, ord)::INT AS severity, count(*) AS n FROM f GROUP BY artifact_id, kind, location""",
    "severity_order": f"""WITH f AS ({FINDINGS}), p AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY severity DESC, ord) AS place FROM f)
        SELECT artifact_id, place::INT AS place, ord, severity FROM p""",
    "critical_kinds": f"""WITH f AS ({FINDINGS}), k AS (SELECT artifact_id, kind, min(ord) AS o FROM f WHERE severity = 2 GROUP BY 1, 2)
        SELECT artifact_id, count(kind) > 0 AS critical, coalesce(array_to_string((list(kind ORDER BY o, kind) FILTER (kind IS NOT NULL))[1:3], ','), '') AS kinds, count(kind) > 3 AS more FROM (SELECT DISTINCT artifact_id FROM f) LEFT JOIN k USING (artifact_id) GROUP BY 1""",
    "tracked_changes": """SELECT l_orderkey AS artifact_id, count(*) FILTER (l_returnflag != 'R') AS insertions, count(*) FILTER (l_returnflag = 'R') AS deletions,
        array_to_string(list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m'))), ', ') AS authors FROM lineitem GROUP BY 1""",
    "lines_only_in_older_turn": """WITH c AS (SELECT conv_id, arg_min(text, turn) AS old, arg_max(text, turn) AS new FROM conversations GROUP BY 1),
        r AS (SELECT conv_id, list_filter(list_transform(string_split(old || chr(10) || split_part(new, chr(10), 1) || chr(10) || old, chr(10)), lambda x: trim(x, ' ')), lambda x: x != '') AS o,
        list_transform(string_split(new, chr(10)), lambda x: trim(x, ' ')) AS n FROM c), l AS (SELECT conv_id, list_filter(o, lambda x: NOT list_contains(n, x)) AS l FROM r)
        SELECT conv_id, length(l)::INT AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM l""",
    "safety_numbers": SAFETY.replace("{fp}", FP),
    "key_fingerprints": f"""WITH k AS (SELECT c_custkey, {FP} AS fingerprint FROM customer), b AS (SELECT *, {_b32('upper(fingerprint)')} AS b FROM k)
        SELECT c_custkey, fingerprint, regexp_replace(b, '(.{{4}})', '\\1-', 'g')[1:-2] AS full, regexp_replace(left(b, 32), '(.{{4}})', '\\1-', 'g')[1:-2] AS shown, left(b, 8) AS short FROM b""",
    "base32_round_trip": f"SELECT c_custkey, {_b32('hex(encode(c_name))')} AS b32, c_name AS back FROM customer",
    "exchange_payloads": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'foreign' WHEN c_custkey % 11 = 0 THEN 'damaged' ELSE 'read' END AS status,
        c_custkey % 7 != 0 AND c_custkey % 11 != 0 AND c_custkey % 3 != 0 AND c_custkey % 5 != 0 AS known FROM customer""",
    "transcript_hashes": "SELECT doc_id, sha256(encode('transcript') || unhex(sha256(source)) || unhex(sha256(strlen(text)::VARCHAR)) || unhex(sha256(text))) AS transcript FROM documents",
    "resolve_signers": f"""WITH m AS (SELECT event_id AS message_id, user_id AS u, event_id % 4 AS t FROM events),
        j AS (SELECT m.*, c_custkey, {STATE} AS state FROM m LEFT JOIN customer ON c_custkey = u AND (t = 0 AND c_custkey % 5 != 0 OR t = 1 AND c_custkey % 4 = 2)),
        r AS (SELECT *, CASE WHEN t = 3 THEN 'unsigned' WHEN c_custkey IS NULL THEN 'unknown' WHEN t = 1 THEN 'changed' ELSE state END AS c FROM j)
        SELECT message_id, c AS case, c_custkey AS contact_ord, CASE WHEN c = 'changed' THEN {HEX64('fp', 'c_custkey')} END AS previous_fingerprint,
        CASE WHEN c = 'changed' THEN c_custkey % 8 = 2 END AS previous_verified,
        CASE c WHEN 'verified' THEN 'confirmed' WHEN 'seen' THEN 'warning' WHEN 'changed' THEN 'warning' WHEN 'revoked' THEN 'error' ELSE 'no statement' END AS verdict FROM r""",
    "added_contacts": f"""WITH n AS (SELECT s_suppkey AS ord, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN {HEX64('sig', 's_suppkey')} WHEN 1 THEN {HEX64('new', '(s_suppkey % 10)')} WHEN 2 THEN {HEX64('new', 's_suppkey')} END AS k FROM supplier),
        f AS (SELECT * FROM n WHERE k IS NULL OR k NOT IN (SELECT {HEX64('sig', 'c_custkey')} FROM customer WHERE c_custkey % 5 != 0)),
        p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS p FROM f) SELECT ord, name FROM p WHERE k IS NULL OR p = 1""",
    "contacts_by_name": f"SELECT translate(c_mktsegment, '{UPPER}', '{LOWER}') AS key, min(c_custkey) AS ord, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1",
    "contact_verdicts": f"""SELECT {STATE} AS state, (['no statement', 'confirmed', 'warning', 'error'])[(c_custkey % 4 + 1)::INT] AS verdict, count(*) AS contacts FROM customer GROUP BY 1, 2""",
    "trust_fold": """WITH e AS (SELECT user_id || ':' || ts::DATE AS c, event_id AS q, epoch(date_trunc('second', ts))::BIGINT AS tm,
        CASE WHEN event_type = 'click' THEN 'verify' WHEN event_type = 'view' THEN 'unverify' WHEN event_type = 'purchase' THEN 'replace' WHEN event_type = 'error' AND minute(ts) < 5 THEN 'revoke' END AS a FROM events),
        v AS (SELECT *, min(CASE WHEN a = 'revoke' THEN q END) OVER (PARTITION BY c) AS r FROM e WHERE a IS NOT NULL),
        b AS (SELECT *, lag(a) OVER (PARTITION BY c ORDER BY q) AS before FROM v WHERE r IS NULL OR q < r),
        s AS (SELECT c, arg_max(a, q) AS last, arg_max(tm, q) AS last_at, count(*) FILTER (a = 'replace') AS n, arg_max(before, q) FILTER (a = 'replace') AS lr FROM b GROUP BY 1),
        t AS (SELECT c, max(tm) FILTER (a = 'revoke') AS revoked_at, count(*) FILTER (q > r AND a != 'revoke') AS refused FROM v GROUP BY 1)
        SELECT t.c AS contact_id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN last = 'verify' THEN 'verified' WHEN last = 'replace' THEN 'changed' ELSE 'seen' END AS state,
        coalesce(n, 0)::INT AS previous, CASE WHEN last = 'verify' THEN last_at END AS verified_at, revoked_at, coalesce(lr = 'verify', false) AS last_verified, refused::INT AS refused FROM t LEFT JOIN s ON s.c = t.c""",
    "send_plan": """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 50 = 3 THEN 'revoked' WHEN s_suppkey % 5 = 0 THEN 'changed' WHEN s_suppkey % 5 = 1 THEN 'seen' ELSE 'verified' END AS state, s_suppkey % 3 != 0 AS hybrid FROM supplier WHERE s_suppkey % 40 != 7),
        t AS (SELECT DISTINCT l_orderkey AS message_id, l_suppkey AS k FROM lineitem)
        SELECT message_id, count(*) AS n_recipients, CASE WHEN bool_or(state IS NULL) THEN 'missing recipient' WHEN bool_or(state = 'revoked') THEN 'revoked recipient' ELSE '' END AS refused,
        count(*) FILTER (state IN ('changed', 'seen')) AS n_warnings, CASE WHEN bool_and(coalesce(hybrid, false)) THEN 'hybrid' ELSE 'classical' END AS suite FROM t LEFT JOIN p USING (k) GROUP BY 1""",
    "armor_round_trip": """WITH d AS (SELECT doc_id, length(to_base64(encode(text))) AS n FROM documents)
        SELECT doc_id, (24 + n + (n + 63) // 64 + 21)::INT AS armor_chars, true AS same FROM d""",
    "envelope_outside_view": """WITH o AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
        SELECT (['unsupported', 'classical', 'hybrid'])[(l_orderkey % 3 + 1)::INT] AS suite, c::INT AS stanzas, count(*) AS envelopes FROM o GROUP BY 1, 2""",
    "old_message_exposure": "SELECT c_custkey, c_name AS filename, c_custkey AS size, c_custkey % 2 = 0 AS names_sender FROM customer",
    "derivation_levels": """WITH p AS (SELECT ([65536, 262144, 1048576, 100])[(p_partkey % 4 + 1)::INT] AS m, p_size % 4 + 1 AS t FROM part)
        SELECT m BETWEEN 8192 AND 4194304 AS valid, CASE WHEN m = 65536 AND t = 3 THEN 'low' WHEN m = 262144 AND t = 3 THEN 'middle' WHEN m = 1048576 AND t = 4 THEN 'high' ELSE 'custom' END AS level, count(*) AS files FROM p GROUP BY 1, 2""",
    "idle_sessions": _sessions("true", 900),
    "idle_sessions_without_polls": _sessions("event_type != 'view'", 3600),
    "idle_lock_state": """WITH l AS (SELECT user_id, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) AS idle FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1),
        r AS (SELECT *, greatest(0, floor((43200000000 - idle) / 1000000.0))::BIGINT AS remaining FROM l)
        SELECT user_id, remaining, idle >= 43200000000 AS locked, CASE WHEN remaining <= 0 THEN 'locked' WHEN remaining <= 30 THEN 'countdown' WHEN remaining * 6 <= 43200 THEN 'strong' WHEN remaining * 3 <= 43200 THEN 'soft' ELSE 'none' END AS level FROM r""",
    "batch_rollup": """WITH v AS (SELECT source, doc_id % 10 != 9 AND strlen(text) <= 4000 AS ok FROM documents)
        SELECT source, count(*) AS files, count(*) FILTER (ok) AS complete, count(*) FILTER (NOT ok) AS conspicuous, count(*) FILTER (NOT ok) > 0 AS decide FROM v GROUP BY 1""",
    "directory_preview": "SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1",
    "outcome_rollup": """WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 'was read-only' WHEN 'purchase' THEN 'copies may exist' WHEN 'signup' THEN 'cloud folder' END AS w FROM events),
        f AS (SELECT user_id, w, min(event_id) AS o FROM e WHERE w IS NOT NULL GROUP BY 1, 2), s AS (SELECT user_id, string_agg(w, ',' ORDER BY o) AS warnings FROM f GROUP BY 1)
        SELECT user_id, count(*) FILTER (event_type != 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, coalesce(any_value(warnings), '') AS warnings FROM e LEFT JOIN s USING (user_id) GROUP BY 1""",
    "mount_prefix_match": """WITH m AS (SELECT mount, max(t) AS fstype FROM (SELECT left(url, 10) AS mount, 'ext4' AS t FROM pages UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+)', 1), 'btrfs' FROM pages
        UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)', 1), 'zfs' FROM pages) WHERE mount != '' GROUP BY 1),
        j AS (SELECT DISTINCT url AS path, mount, fstype FROM pages JOIN m ON starts_with(url, mount))
        SELECT path, arg_max(mount, length(mount)) AS mount, arg_max(fstype, length(mount)) AS fstype, arg_max(fstype, length(mount)) IN ('btrfs', 'zfs', 'bcachefs') AS copy_on_write FROM j GROUP BY 1""",
    "deletion_capability": """SELECT CASE WHEN p_partkey % 3 = 0 AND p_partkey // 3 % 3 = 1 AND p_partkey // 9 % 3 = 1 THEN 'overwrite' ELSE 'best effort' END AS capability, count(*) AS files FROM part GROUP BY 1""",
    "cloud_hints": "WITH p AS (SELECT lower((['/OneDrive/', '/Dropbox/', '/Google Drive/', '/iCloud/', '/nextcloud/', '/pCloud/', '/data/'])[(page_id % 7 + 1)::INT] || url) AS p FROM pages) SELECT CASE "
    + " ".join(f"WHEN contains(p, '{k}') THEN '{n}'" for k, n in CLOUDS)
    + " ELSE 'none' END AS hint, count(*) AS paths FROM p GROUP BY 1",
    "human_sizes": "WITH d AS (SELECT doc_id, strlen(text)::BIGINT * strlen(text) AS n FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN n >= {1024**i} THEN ((n * 10 + {1024**i // 2}) // {1024**i}) // 10 || '.' || ((n * 10 + {1024**i // 2}) // {1024**i}) % 10 || ' {u}'" for i, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    + " ELSE n || ' B' END AS size FROM d",
    "json_report": """SELECT doc_id, '{"id":' || doc_id || ',"source":"' || source || '","bytes":' || strlen(text) || '}' AS line FROM documents""",
    "jpeg_findings": """WITH c AS (SELECT c_custkey AS a, c_name, c_custkey % 3 = 0 AS l FROM customer)
        SELECT a AS artifact_id, 0 AS ord, 'unknown extension' AS kind, 'APP0' AS location, '5 bytes' AS value, 0 AS severity FROM c
        UNION ALL SELECT a, 1, 'device', 'APP1:Exif', '12 bytes', 1 FROM c WHERE l UNION ALL SELECT a, 2, 'gps', 'APP1:Exif/GPS', NULL, 2 FROM c WHERE l
        UNION ALL SELECT a, CASE WHEN l THEN 3 ELSE 1 END, 'comment', 'COM', c_name, 1 FROM c""",
    "jpeg_cleaning": """SELECT c_custkey AS artifact_id, (2 + 9 + CASE WHEN c_custkey % 3 = 0 THEN 16 ELSE 0 END + 4 + strlen(c_name) + 6 + 6 + 5)::INT AS bytes,
        'ffd8ffdb00040001ffda00040102a1b2c3ffd9' AS clean, 0 AS left FROM customer""",
    "webp_cleaning": """SELECT s_suppkey AS artifact_id, 'device:1:' || strlen(s_name) || ' bytes,author:2:' || strlen(s_name) || ' bytes' AS found,
        '52494646' || '20000000' || '57454250' || '565038580a000000' || '10000000000000000000' || '56503820020000000102' AS clean, 0 AS left FROM supplier""",
    "bmp_cleaning": """SELECT page_id AS artifact_id, 'BMP' AS format, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'unknown extension:1:' || strlen(url) || ' bytes' END AS found, 58 AS clean_bytes FROM pages""",
    "stanza_scan": """WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1),
        t AS (SELECT l_orderkey, list_transform(s, lambda x: x % 5 = 0) AS f FROM o)
        SELECT l_orderkey, length(list_filter(f, lambda x: NOT x))::INT AS real, length(list_filter(f, lambda x: x))::INT AS dummies, length(f) = 1 OR (length(f) = 2 AND NOT f[1] AND f[2]) AS strict FROM t""",
    # by format: findings as it is; with two bytes behind it; cut to twenty bytes (-1: none can be told)
    "mixed_file_verdicts": """WITH f(made_as, format, n0, n1, n2, o0, o1, o2) AS (VALUES
        (0, 'PNG', 1, -1, -1, 'complete', 'malformed', 'malformed'), (1, 'JPEG', 2, 3, -1, 'complete', 'complete', 'malformed'), (2, 'WebP', 2, -1, -1, 'complete', 'malformed', 'malformed'),
        (3, 'GIF', 2, 3, -1, 'complete', 'complete', 'malformed'), (4, 'BMP', 0, 1, -1, 'complete', 'complete', 'unknown'), (5, 'AVI', 2, -1, -1, 'complete', 'malformed', 'malformed'),
        (6, 'WAV', 2, -1, -1, 'complete', 'malformed', 'malformed'), (7, 'FLAC', 2, 2, -1, 'complete', 'complete', 'malformed'), (8, 'PDF', 2, 3, -1, 'partial', 'partial', 'malformed'),
        (9, 'TIFF', 2, 3, -1, 'partial', 'partial', 'malformed'), (10, 'Ogg', -1, -1, -1, 'unknown', 'unknown', 'unknown')),
        c AS (SELECT c_custkey % 11 AS made_as, c_custkey // 11 % 3 AS damage FROM customer),
        v AS (SELECT made_as, damage, CASE WHEN made_as = 4 AND damage = 2 THEN '' ELSE format END AS format, ([o0, o1, o2])[damage + 1] AS outcome, ([n0, n1, n2])[damage + 1]::INT AS n_findings FROM c JOIN f USING (made_as))
        SELECT made_as, damage, format, outcome, CASE outcome WHEN 'malformed' THEN 'error' WHEN 'complete' THEN 'confirmed' WHEN 'partial' THEN 'warning' ELSE 'no statement' END AS verdict, n_findings, count(*) AS files FROM v GROUP BY ALL""",
    "tiff_directories": """SELECT c_custkey AS artifact_id, CASE WHEN c_custkey % 4 = 2 THEN 'directories in a circle' END AS error, CASE WHEN c_custkey % 4 != 2 THEN
        'device:1:TIFF:Make:' || c_mktsegment || ',author:2:TIFF:Artist:' || c_name || (['', ',unknown extension:1:TIFF:tail:2 bytes', '', ',gps:2:TIFF:GPS-IFD:4 bytes'])[c_custkey % 4 + 1] END AS found FROM customer""",
    "exif_tags": """SELECT s_suppkey AS artifact_id, 'device:1:APP1:Exif/Make:Camera One,author:2:APP1:Exif/Artist:' || s_name || CASE WHEN s_suppkey % 4 = 3 THEN ',gps:2:APP1:Exif/GPS-IFD:4 bytes' ELSE '' END AS found,
        'ffd8ffdb00040001ffda00040102a1b2c3ffd9' AS clean FROM supplier""",
    "zip_entries": f"""WITH {ZIPS} SELECT l_orderkey, (k - 1)::INT AS i, name, method, size, (sum(30 + strlen(name) + size) OVER (PARTITION BY l_orderkey ORDER BY k) - 30 - strlen(name) - size)::BIGINT AS "offset", NULL::VARCHAR AS error FROM z WHERE l_orderkey % 7 != 0
        UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, NULL, NULL, NULL, 'no end record' FROM z WHERE l_orderkey % 7 = 0""",
    "zip_findings": f"""WITH {ZIPS} SELECT l_orderkey, CASE WHEN l_orderkey % 7 != 0 THEN 'comment:1:ZIP:entry names:' || count(*) || ' names' || coalesce(',' || string_agg('author:2:ZIP:' || name || ':' || leak, ',' ORDER BY k) FILTER (leak IS NOT NULL), '')
        || CASE WHEN l_orderkey % 3 = 1 THEN ',comment:1:ZIP:comment:4 bytes' ELSE '' END || CASE WHEN l_orderkey % 5 = 0 THEN ',unknown extension:1:ZIP:tail:2 bytes' ELSE '' END END AS found FROM z GROUP BY l_orderkey""",
    "zip_members": f"""WITH {ZIPS} SELECT CASE WHEN picture THEN 'PNG' ELSE '' END AS format, CASE WHEN picture THEN 'warning' ELSE 'no statement' END AS verdict, CASE WHEN picture THEN 1 ELSE -1 END AS n_findings, count(*) AS files
        FROM z WHERE l_orderkey % 7 != 0 AND method = 0 GROUP BY 1, 2, 3""",
    "film_keys": """WITH k(place, ord, name, kind) AS (VALUES (3, 1, 'com.apple.quicktime.model', 'device:1'), (1, 2, 'com.apple.quicktime.location.ISO6709', 'gps:2'), (4, 3, 'com.apple.quicktime.creationdate', 'timestamp:1'), (2, 4, 'com.apple.quicktime.make', 'device:1')),
        f AS (SELECT c_custkey, ord, kind || ':Video:' || name || ':' || (['+' || c_custkey || '/', c_mktsegment, c_name, '2024-01-02'])[place] AS t FROM customer JOIN k ON (c_custkey + place) % 3 != 0
        UNION ALL SELECT c_custkey, 0, 'timestamp:1:Video:mvhd' FROM customer WHERE c_custkey % 5 = 0)
        SELECT c_custkey AS artifact_id, CASE WHEN c_custkey % 10 = 9 THEN 'box past its range' END AS error, CASE WHEN c_custkey % 10 != 9 THEN string_agg(t, ',' ORDER BY ord) END AS found FROM f GROUP BY 1""",
    "outside_views": """WITH d AS (SELECT doc_id, doc_id % 5 AS k, strlen(text) AS n FROM documents)
        SELECT doc_id, ([1, 2])[k + 1]::INT AS version, (['classical', 'hybrid'])[k + 1] AS suite, CASE WHEN k = 1 THEN 3 END AS stanzas,
        (CASE k WHEN 0 THEN 2 + (n + 10 + 2) // 3 * 4 WHEN 2 THEN n WHEN 3 THEN 4 ELSE n + 5 END)::INT AS bytes,
        (['header', 'number of stanzas'])[k + 1] AS exposes, ([NULL, NULL, 'bad magic', 'truncated', 'unsupported suite'])[k + 1] AS error FROM d""",
    "old_formats": r"""WITH d AS (SELECT ([chr(10) || ' eyJ', chr(9) || '{', '', 'x{'])[doc_id % 4 + 1] || text AS t FROM documents)
        SELECT CASE WHEN starts_with(ltrim(t, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)), 'eyJ') THEN 'message'
        WHEN starts_with(ltrim(t, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)), '{') THEN 'key file' ELSE 'none' END AS old_format, count(*) AS files FROM d GROUP BY 1""",
    "header_validation": f"""WITH c AS (SELECT c_custkey, c_name, c_custkey % 8 AS k FROM customer)
        SELECT c_custkey, ([NULL, NULL, 'signed flag and key disagree', 'reserved type', 'unknown content type', 'name: separator', 'size missing', 'padding not zero'])[k + 1] AS error,
        CASE WHEN k < 2 THEN 'file' END AS content_type, CASE WHEN k < 2 THEN c_custkey END AS plaintext_size, CASE WHEN k < 2 THEN k = 1 END AS signed,
        CASE WHEN k = 1 THEN {HEX64('sig', 'c_custkey')} END AS sender_key, CASE WHEN k < 2 THEN replace(c_name, '#', '_') END AS filename FROM c""",
    "container_types": """SELECT CASE WHEN c_custkey % 7 < 4 THEN (['ODF text', 'ODF spreadsheet', 'ODF presentation', 'ODF'])[c_custkey % 7 + 1] WHEN c_custkey % 7 = 4 THEN 'EPUB'
        WHEN c_custkey % 7 = 5 THEN 'typed container' WHEN c_custkey % 2 = 0 THEN 'JAR' ELSE 'archive' END AS kind, count(*) AS archives FROM customer GROUP BY 1""",
    "gif_cleaning": """WITH c AS (SELECT c_custkey, c_name, c_custkey % 3 AS k FROM customer)
        SELECT c_custkey AS artifact_id, 'comment:1:GIF:comment:' || c_name || (['', ',author:2:GIF:application/XMP Data', ',unknown extension:1:GIF:application/ICCRGBG1'])[k + 1] AS found,
        '474946383961' || CASE WHEN k = 1 THEN '01000100800000aabbccddeeff' ELSE '01000100000000' END || '21f9040000000000' || CASE WHEN k = 0 THEN '21ff0b4e45545343415045322e300301000000' ELSE '' END
        || '2c00000000010001000002024c01003b' AS clean, 0 AS left FROM c""",
    "avi_cleaning": """WITH s AS (SELECT c_custkey, c_name, c_mktsegment, strlen(c_name) + 1 AS a, strlen(c_mktsegment) + 1 AS b FROM customer),
        t AS (SELECT *, (122 + a + a % 2 + b + b % 2)::INT AS bytes FROM s)
        SELECT c_custkey AS artifact_id, 'comment:1:AVI:strn:' || c_name || ',software:1:AVI:INFO/ISFT:' || c_mktsegment AS found, bytes, bytes AS clean_bytes, 0 AS left, 'AVI' AS format FROM t""",
    "contact_list": f"""SELECT c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS name, {STATE} AS state, CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END AS n_previous
        FROM customer WHERE c_custkey % 7 != 0""",
    "conspicuous_files": "SELECT source, doc_id FROM documents WHERE doc_id % 10 = 9 OR strlen(text) > 4000",
    "tree_preview": """WITH e AS (SELECT DISTINCT regexp_extract(url, '^(.*)/[^/]*$', 1) AS path, 'dir' AS kind, 0 AS bytes FROM pages
        UNION ALL SELECT url, CASE WHEN page_id % 11 = 0 THEN 'link' ELSE 'file' END, strlen(html) FROM pages),
        p AS (SELECT string_split(path, '/') AS parts, kind, bytes FROM e),
        a AS (SELECT unnest(list_transform(range(1, length(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS directory, kind, bytes FROM p)
        SELECT directory, count(*) FILTER (kind = 'file') AS files, coalesce(sum(bytes) FILTER (kind = 'file'), 0)::BIGINT AS bytes, count(*) FILTER (kind = 'dir') AS dirs, count(*) FILTER (kind = 'link') AS links FROM a GROUP BY 1""",
    "refusal_rules": """SELECT CASE WHEN page_id % 20 = 9 THEN 'name does not match' ELSE (['drive root', 'drive root', 'home directory', 'system directory', 'allowed', 'system directory', 'system directory', 'contains a repository', 'link', 'allowed'])[page_id % 10 + 1] END AS refusal,
        count(*) AS directories FROM pages GROUP BY 1""",
}
