"""DuckDB SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations


from usagemill.llm import hard_negatives, quality_rules, secrets, topk

SPACE = r"[\x20\x09-\x0D]"


def _either_case(pattern: str) -> str:
    """pattern with its (?i:...) groups and look-behinds as DuckDB's regex has them: classes of both cases, and a word boundary."""
    out, depth, inside, i = "", 0, [], 0
    in_class = False
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("(?<![A-Za-z0-9_])", i):
            out, i = out + r"\b", i + len("(?<![A-Za-z0-9_])")
            continue
        if pattern.startswith("(?i:", i) and not in_class:
            out, depth, i = out + "(?:", depth + 1, i + 4
            inside.append(depth)
            continue
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            if inside and inside[-1] == depth:
                inside.pop()
            depth -= 1
        if inside and c.isalpha() and not in_class:
            out += f"[{c.upper()}{c.lower()}]"
        elif inside and in_class and c == "[":
            body = pattern[i : pattern.index("]", i) + 1]
            out += body.replace("a-z", "A-Za-z") if "A-Z" not in body else body
            i += len(body)
            in_class = False
            continue
        else:
            out += c
        i += 1
    return out


def _secrets() -> str:
    kinds = secrets.STRONG | secrets.WEAK
    parts = []
    for k, (pattern, group, least) in enumerate(kinds.values()):
        p = _either_case(pattern).replace("'", "''")
        parts.append(
            f"SELECT rid, {k} AS k, i, length(list_extract(g, i)) AS lg, length(list_extract(f, i)) AS lf, coalesce(length(list_extract(v, i)) >= {least}, FALSE) AS hit FROM "
            f"(SELECT rid, g, f, v, unnest(range(1, len(g) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')))"
        )
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    count = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{k}" for i, k in enumerate(secrets.STRONG))
    near = lambda of: f"(coalesce(max(CASE WHEN {of} THEN e END) OVER b >= s - {secrets.REACH}, FALSE) OR coalesce(min(CASE WHEN {of} THEN s END) OVER f <= e + {secrets.REACH}, FALSE))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT rid, k, hit, lf, CAST(sum(lg + coalesce(lf, 0)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS e FROM pieces),
found AS (SELECT rid, k, e - lf AS s, e FROM placed WHERE hit AND lf IS NOT NULL),
linked AS (SELECT *, {near("k IN (0, 2, 3)")} AS secret, {near("k IN (1, 4)")} AS name, {near("k = 5")} AS place, coalesce(max(CASE WHEN k IN (0, 2) THEN e END) OVER b > s, FALSE) AS inside FROM found
  WINDOW b AS (PARTITION BY rid ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY rid ORDER BY s, e, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
told AS (SELECT rid, k, s, e, {names}[k + 1] || ':' || s || ':' || e AS x FROM linked WHERE k < 3 OR (k = 3 AND (name OR place) AND NOT inside) OR (k = 4 AND secret) OR (k = 5 AND secret AND name)),
by_doc AS (SELECT rid, {count}, string_agg(x, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base, string_agg(x, ',' ORDER BY s, k, e) AS spans FROM told GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_doc USING (rid)"""


def _rules() -> str:
    metrics = {
        "symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "capitals": "capitals * 1000 // greatest(word_chars, 1)", "marks": "marks * 1000 // greatest(word_chars, 1)",
        "sameness": "(n_words - n_distinct) * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 10 // greatest(n_words, 1)",
    }
    assert list(metrics) == list(quality_rules.METRICS)
    exact = quality_rules.EXACT
    bins = " UNION ALL ".join(f"SELECT rid, l, s, {i} AS metric, more * {exact // 2} + (x >> more) AS bin FROM (SELECT *, greatest(length(bin(x)) - {exact.bit_length() - 1}, 0) AS more FROM (SELECT rid, l, s, CAST({x} AS BIGINT) AS x FROM c))" for i, x in enumerate(metrics.values()))
    slack = "[" + ", ".join(map(str, quality_rules.METRICS.values())) + "]"
    levels = " UNION ALL ".join(f"SELECT '{level}' AS level, {l} AS l, {s} AS s, metric, bin, count(*) AS n FROM bins GROUP BY ALL" for level, l, s in (("own", "l", "s"), ("lang", "l", "''"), ("all", "''", "''")))
    keep = lambda body: f"length(regexp_replace(t, '[^{body}]+', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, 'null') AS l, coalesce('=' || source, 'null') AS s, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT rid, doc_id, l, s, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({keep("#*$%&|<>")} AS BIGINT) AS n_symbols, {keep(r"\p{Lu}")} AS capitals, {keep("!?")} AS marks,
  len(list_distinct(w)) AS n_distinct, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE[1:]}')) AS lines FROM d),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
cover AS (SELECT rid, CAST(sum(least(3, i - before)) AS BIGINT) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -2) AS before FROM twice) GROUP BY rid),
bins AS ({bins}), sketch AS ({levels}),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, metric ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY level, l, s, metric) AS total FROM sketch),
quart AS (SELECT level, l, s, metric, max(total) AS rows, min(bin) FILTER (WHERE cum * 100 >= total * 25) AS a, min(bin) FILTER (WHERE cum * 100 >= total * 50) AS b, min(bin) FILTER (WHERE cum * 100 >= total * 75) AS c FROM ranked GROUP BY ALL),
fence AS (SELECT level, l, s, metric, rows, greatest(c + {quality_rules.FENCE} * (c - a), b + {slack}[metric + 1]) AS fence FROM quart),
broken AS (SELECT rid, count(*) AS n FROM bins JOIN fence o ON o.level = 'own' AND o.l = bins.l AND o.s = bins.s AND o.metric = bins.metric JOIN fence g ON g.level = 'lang' AND g.l = bins.l AND g.metric = bins.metric JOIN fence a ON a.level = 'all' AND a.metric = bins.metric
  WHERE bin > CASE WHEN o.rows >= {quality_rules.MIN_GROUP_ROWS} THEN o.fence WHEN g.rows >= {quality_rules.MIN_GROUP_ROWS} THEN g.fence ELSE a.fence END GROUP BY rid),
base AS (SELECT c.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(broken.n, 0) AS n_broken FROM c LEFT JOIN cover USING (rid) LEFT JOIN broken USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_broken = 0 AS kept FROM base"""


ORACLES = {"op1_secret_scans": _secrets(), "op3_quality_rules": _rules(), "op10_topk": topk.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
