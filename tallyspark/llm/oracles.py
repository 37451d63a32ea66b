"""DuckDB statements for the queries whose result SQL can express."""

from __future__ import annotations

import re

from . import licenses, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


def secret_scan() -> str:
    """Spans from what an expression matches and what lies between its matches."""

    def pattern(rule: secrets.Rule) -> str:
        if not rule.pattern.startswith("(?ai)"):
            return rule.pattern
        key, rest = rule.pattern.removeprefix("(?ai)").split(")", 1)
        either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", key)
        return either + ")" + rest

    parts = []
    for nth, rule in enumerate(secrets.RULES):
        p = _quoted(pattern(rule))
        parts.append(
            f"SELECT rid, {nth} AS nth, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {rule.least} AS least, "
            f"string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, "
            f"regexp_extract_all(t, {p}, {rule.group}) AS held FROM d"
        )
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.RULES if r.base
    )
    shown = "kind || ':' || begin_at || ':' || end_at, ',' ORDER BY begin_at, nth"
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        f"r AS ({' UNION ALL '.join(parts)}), "
        "s AS (SELECT rid, nth, kind, base, least, unnest(list_transform(range(len(hits)), lambda i: {'b': "
        "CAST(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], "
        "lambda x: length(x))), 0) AS BIGINT), 'n': length(hits[i + 1]), 'held': length(held[i + 1])})) AS m FROM r "
        "WHERE len(hits) > 0), "
        "f AS (SELECT rid, nth, kind, base, m.b AS begin_at, m.b + m.n AS end_at FROM s WHERE m.held >= least) "
        f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({shown}) FILTER (WHERE base), '')) AS base_sha256, "
        f"coalesce(string_agg({shown}) FILTER (WHERE kind IS NOT NULL), '') AS spans "
        "FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"
    )


def license_scan() -> str:
    """Every window of every text against every template, every start of every phrase."""
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    phrases = " UNION ALL ".join(
        f"SELECT rid, {_quoted(label)} AS label, unnest(list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: "
        f"w[i + 1:i + {len(p.split())}] = {_listed(p.split())})) AS place FROM d WHERE len(w) >= {len(p.split())}"
        for p, label in licenses.PHRASES
    )
    templates = ", ".join(
        f"({_quoted(label)}, {_listed(sorted(words))}, {licenses.need(len(words), licenses.THRESHOLD)}, {size})"
        for label, words, size in (
            (label, licenses.template_words(s), len(re.findall("[0-9a-z]+", s.lower()))) for label, s in licenses.TEMPLATES
        )
    )
    joined = "array_to_string(list_sort(list_distinct({0})), ',')"
    return (
        "WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents), "
        f"d AS (SELECT *, regexp_extract_all(t, {word}) AS w FROM low), "
        f"p AS ({phrases}), "
        f"b AS (SELECT rid, label, tw, need, size, w, unnest(range(0, len(w), size // 2)) AS i FROM d, "
        f"(VALUES {templates}) v(label, tw, need, size) WHERE len(list_intersect(list_distinct(w), tw)) >= need), "
        "x AS (SELECT rid, label, tw, need, list_distinct(w[i + 1:i + 2 * size]) AS w FROM b), "
        "m AS (SELECT rid, label, len(list_intersect(w, tw)) / len(tw) AS c FROM x WHERE len(list_intersect(w, tw)) >= need), "
        "pa AS (SELECT rid, count(*) AS n, min(place) AS lo, max(place) AS hi, list(label) AS ls FROM p GROUP BY rid), "
        "ma AS (SELECT rid, max(c) AS c, list(label) AS ls FROM m GROUP BY rid) "
        "SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pa.n, 0) AS BIGINT) AS n_base, "
        "CAST(pa.lo AS BIGINT) AS first_word, CAST(pa.hi AS BIGINT) AS last_word, "
        f"{joined.format('coalesce(pa.ls, [])')} AS base_labels, "
        f"{joined.format('list_concat(coalesce(pa.ls, []), coalesce(ma.ls, []))')} AS labels, "
        "CASE WHEN pa.n > 0 THEN 1.0 ELSE coalesce(ma.c, 0.0) END::DOUBLE AS score "
        "FROM d LEFT JOIN pa USING (rid) LEFT JOIN ma USING (rid)"
    )


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def divergence_audit() -> str:
    """Every kept term in every group of its language, every pair of groups over all terms."""
    share = "1 + (1000000000::HUGEINT * (coalesce({0}, 0) + 2)) // (coalesce({1}, 0) + 2 * v.n)"
    gap = "CAST((p - q) * (p - q) // (p + q) AS BIGINT)"
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, "
        f"regexp_extract_all({LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents), "
        "t AS (SELECT rid, lang, source, unnest(w) AS term FROM d), "
        "k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10), "
        "v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM k GROUP BY lang), "
        "c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL), "
        "gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL), "
        "cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL), "
        "g AS (SELECT DISTINCT lang, source FROM d), "
        f"s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST({share.format('c.n', 'gn.n')} AS HUGEINT) AS p "
        "FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) "
        "LEFT JOIN gn USING (lang, source)), "
        f"l AS (SELECT cl.lang, cl.term, CAST({share.format('cl.n', 'ln.n')} AS HUGEINT) AS q "
        "FROM cl JOIN ln USING (lang) JOIN v USING (lang)), "
        "x AS (SELECT a.lang, a.source, b.source AS item, sum(CAST((a.p - b.p) * (a.p - b.p) // (a.p + b.p) AS BIGINT)) AS value "
        "FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL), "
        "pairs AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g JOIN g h "
        "ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source "
        "AND x.item = h.source), "
        f"terms AS (SELECT lang, source, term AS item, {gap} AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q) "
        f"SELECT lang, source, 'pair' AS part, item, value, {rank} FROM pairs UNION ALL "
        f"SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {rank} FROM terms) WHERE rank <= 10"
    )


def importance_resample() -> str:
    """Features counted by bucket, CRC-32 by its table of 256 (made from the polynomial 0xEDB88320)."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), "
        "lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), "
        "lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000"
    )
    words = f"regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws"
    return (
        f"WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(256)) AS b) UNION ALL "
        f"SELECT b, k + 1, {step} FROM bits WHERE k < 8), "
        "crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8), "
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, {words} FROM documents), b AS (SELECT {words} FROM benchmark), "
        "dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b), "
        f"h AS (SELECT w, {crc} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc), "
        "dc AS (SELECT rid, bucket, count(*) AS n FROM dw JOIN h USING (w) GROUP BY ALL), "
        "s AS (SELECT bucket, sum(n) AS n FROM dc GROUP BY ALL), "
        "t AS (SELECT bucket, count(*) AS n FROM bw JOIN h USING (w) GROUP BY ALL), "
        "z AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) AS s, "
        "CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) AS t), "
        "gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (z.s + 10000) / "
        "((s.n + 1.0::DOUBLE) * (z.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), z), "
        "dg AS (SELECT rid, sum(n * gain) AS weight FROM dc JOIN gain USING (bucket) GROUP BY ALL), "
        "e AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, "
        "('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN dg USING (rid)), "
        "f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e), "
        "r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= 20) "
        "SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank "
        "FROM f LEFT JOIN r USING (rid)"
    )
