"""DuckDB SQL for the registered queries that SQL can express.

Not expressible there: 64-bit xxhash and Unicode case folding (1, 5), tokenisation and dynamic programming (3, 7), fitted
models (8, 9), approximate quantiles along a Hilbert curve (10), and the pipeline, which holds several of them.
"""

from __future__ import annotations

import re

from .audit import ORACLE_SQL as AUDIT_SQL
from .chat import ORACLE_SQL as CHAT_SQL
from .phrases import ORACLE_SQL as PHRASES_SQL
from .secrets import BASE_RULES, RULES, Rule
from .topk import ORACLE_SQL as TOPK_SQL


def _either_case(pattern: str) -> str:
    """(?i:...) spelt out as classes of ASCII letters, so that no engine folds beyond them."""
    inside = lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1])
    return re.sub(r"\(\?i:(\((?:[^()]|\([^()]*\))*\))\)", inside, pattern)


def _spans(rule: Rule, k: int) -> str:
    p = _either_case(rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind,
    list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS b, length(ms[i]) AS size, length(g[i]) AS counts, {rule.least} AS least
  FROM (SELECT doc_id, ms, g, gaps, unnest(generate_series(1, len(ms))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {rule.group}) AS g, string_split_regex(text, '{p}') AS gaps
    FROM t WHERE regexp_matches(text, '{p}')))"""


SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS ({" UNION ALL ".join(_spans(r, k) for k, r in enumerate(RULES))}),
kept AS (SELECT doc_id, k, kind, CAST(b AS BIGINT) AS b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + size AS BIGINT) AS span FROM every WHERE counts >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY b, k) FILTER (k < {len(BASE_RULES)}), '') AS base, string_agg(span, ',' ORDER BY b, k) AS spans
  FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed USING (doc_id)
"""

SUBSTRING_SQL = """
WITH t AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM t WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS place FROM hits)),
words AS (SELECT doc_id, place, w[place] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS place FROM t)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op2_secrets": SECRETS_SQL, "op4_topk": TOPK_SQL, "op6_substrings": SUBSTRING_SQL, "op11_phrases": PHRASES_SQL, "op12_audit": AUDIT_SQL, "op13_chat": CHAT_SQL}
