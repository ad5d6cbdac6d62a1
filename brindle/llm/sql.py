"""DuckDB SQL for those queries of the operators that SQL can express on whole tables.

Learned results (2, 5, 10, the pipeline), a tokenizer's ids (6) and XXH64 with a seed
(9) are tested against brute force instead.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WHITE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _either_case(word: str) -> str:
    """The engine's own flag for case would also fold letters outside ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, pattern, the least code points of a match's group, and that group.
_SECRETS = (
    ("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    ("google", "AIza[0-9A-Za-z_-]{35}", 1, 0),
    ("stripe", "[sr]k_live_[0-9A-Za-z]{16,}", 1, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
)
#: Matches of each kind; the texts between them and their own lengths give the places.
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {n} AS rank, {least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM doc"
    for n, (kind, pattern, least, group) in enumerate(_SECRETS)
)

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH item AS (SELECT item_id, {_FOLD_WORDS} AS w FROM benchmark),
        gram AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item WHERE len(w) > 0)
        ),
        doc AS (SELECT doc_id, {_FOLD_WORDS} AS w FROM documents),
        size AS (SELECT DISTINCT k FROM gram),
        place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k),
        met AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place) p JOIN gram g USING (g, k)),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_substrings": """
        WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        place AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM doc WHERE len(h) >= 200)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM place) WHERE n > 1),
        step AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM later),
        run AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM run GROUP BY doc_id, r),
        gap AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS from_, b FROM span),
        kept AS (
            SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
            FROM gap JOIN doc USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)""",
    "op4_secrets": f"""
        WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({_FOUND}),
        each AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(m) + 1)) AS k, m, v, g FROM found),
        size AS (SELECT doc_id, kind, rank, k, length(g[k]) AS gap, length(m[k]) AS n, length(v[k]) >= least AS ok FROM each),
        span AS (SELECT doc_id, kind, rank, ok, (sum(gap + n) OVER (PARTITION BY doc_id, rank ORDER BY k))::BIGINT AS e, n FROM size),
        kept AS (SELECT doc_id, kind, rank, e - n AS s, e, kind || ':' || (e - n) || ':' || e AS x FROM span WHERE ok),
        total AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(x, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank, e) AS every
            FROM kept GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM doc LEFT JOIN total USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
        bits AS (SELECT *, from_hex(h) AS raw FROM d),
        letters AS (
            SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                ((('0x' || substr(h || '0', 1 + (5 * k) // 4, 2))::BIGINT) >> (3 - (5 * k) % 4)) & 31)::INT, 1), '' ORDER BY k) AS b32
            FROM bits, range(0, 32) t(k) GROUP BY page_id
        )
        SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END::BIGINT AS refers_to
        FROM bits JOIN letters USING (page_id)""",
    "op8_passages": f"""
        WITH doc AS (SELECT doc_id, {_WHITE_WORDS} AS w FROM documents),
        place AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM place) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM twice),
        each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM doc),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS k FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)""",
}
