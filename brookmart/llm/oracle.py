"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from brookmart.llm import line_dedup, quality_rules, spelling, url_filter


def _op3() -> str:
    q = quality_rules
    n = len(q.RULES)
    votes = " || ".join(f"CASE WHEN {bad} THEN '0' WHEN {good} THEN '1' ELSE '-' END" for _, good, bad in q.RULES)

    def odds(p: str = "em") -> str:
        terms = [f"ln(1 - {p}.share) - ln({p}.share)"]
        for j in range(1, n + 1):
            terms.append(
                f"CASE substr(votes, {j}, 1) WHEN '1' THEN ln({p}.bad[{j}]) - ln({p}.good[{j}]) "
                f"WHEN '0' THEN ln(1 - {p}.bad[{j}]) - ln(1 - {p}.good[{j}]) ELSE 0.0 END")
        return " + ".join(terms)

    def held(x: str) -> str:
        return f"least(greatest({x}, {q.FLOOR}), {1 - q.FLOOR})"

    def rate(j: int, start: float, mass: str) -> str:
        ones = f"sum(CASE WHEN substr(votes, {j}, 1) = '1' THEN {mass} ELSE 0.0 END)"
        cast = f"sum(CASE WHEN substr(votes, {j}, 1) <> '-' THEN {mass} ELSE 0.0 END)"
        return held(f"({ones} + (sum(n) * {q.PRIOR} + 1) * {start}) / ({cast} + (sum(n) * {q.PRIOR} + 1))")

    good = ", ".join(rate(j, q.START_GOOD, "n * q") for j in range(1, n + 1))
    bad = ", ".join(rate(j, q.START_BAD, "n * (1 - q)") for j in range(1, n + 1))
    share = held(f"(sum(n * q) + (sum(n) * {q.PRIOR} + 1) * {q.START_SHARE}) / (sum(n) + (sum(n) * {q.PRIOR} + 1))")
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS c
  FROM (SELECT rid, p, ws[p:p + {q.WINDOW - 1}] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS p FROM d))
), rep AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(p, p + {q.WINDOW})) AS k FROM win WHERE c > 1) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, len(ws) AS n_words,
         length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
         len(list_filter(ws, lambda x: ends_with(x, '.') OR ends_with(x, '?'))) AS n_stops,
         len(list_distinct(ws)) AS n_distinct,
         len(list_filter(ws, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}][.,;:?!]?$'))) AS n_plain,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_bare,
         len(list_filter(ls, lambda x: contains(x, '|'))) AS n_bar_lines
  FROM d LEFT JOIN rep ON d.rid = rep.rid
), v AS MATERIALIZED (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, {votes} AS votes FROM m
), pat AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes),
em AS (
  SELECT 0 AS it, CAST({q.START_SHARE} AS DOUBLE) AS share,
         CAST({[q.START_GOOD] * n} AS DOUBLE[]) AS good, CAST({[q.START_BAD] * n} AS DOUBLE[]) AS bad
  UNION ALL
  SELECT it + 1, {share}, [{good}], [{bad}]
  FROM (SELECT em.it, pat.votes, pat.n, 1 / (1 + exp({odds()})) AS q FROM em, pat WHERE em.it < {q.ROUNDS}) GROUP BY it
), quality AS (
  SELECT votes, 1 / (1 + exp({odds('em')})) AS quality FROM pat, em WHERE em.it = {q.ROUNDS}
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND quality >= 0.5 AS kept, v.votes, round(quality, 4) AS quality
FROM v JOIN quality ON v.votes = quality.votes
"""


def _op6() -> str:
    u = url_filter
    a, edge = u.ALPHABET, u.EDGE
    ranked = sorted(u.RULES, key=lambda r: (-len(r[0]), r[0]))

    def case(value) -> str:
        arms = []
        for text, verdict in ranked:
            host, slash, path = text.partition("/")
            arms.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{value(text, verdict)}'")
        return "CASE " + " ".join(arms) + " END"

    def log_p(k: str) -> str:
        p0 = f"(({k}_c + 1) / ({k}_n + {a}))"
        p1 = f"(CASE WHEN {k}_b > 0 THEN ({k}_bc + {k}_bt * {p0}) / ({k}_b + {k}_bt) ELSE {p0} END)"
        return f"ln(CASE WHEN {k}_ab > 0 THEN ({k} + {k}_abt * {p1}) / ({k}_ab + {k}_abt) ELSE {p1} END)"

    both = ("allow", "block")
    return f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS MATERIALIZED (SELECT *, {case(lambda t, v: t)} AS rule, {case(lambda t, v: v)} AS ruled FROM p),
sym AS (
  SELECT rid, ruled, list_concat([{edge}, {edge}], list_transform(
           list_filter(string_split(translate(url, '{u.UPPER}', '{u.LOWER}'), ''), lambda c: c <> ''), lambda c: instr('{u.LETTERS}', c)), [{edge}]) AS s
  FROM r
), cell AS MATERIALIZED (
  SELECT rid, ruled, i, (s[i] * {a} + s[i + 1]) * {a} + s[i + 2] AS cell FROM (SELECT rid, ruled, s, unnest(range(1, len(s) - 1)) AS i FROM sym)
), cnt AS (
  SELECT g.cell, {', '.join(f"CAST(count(CASE WHEN ruled = '{k}' THEN 1 END) AS DOUBLE) AS {k}" for k in both)}
  FROM (SELECT unnest(range({a ** 3})) AS cell) g LEFT JOIN (SELECT * FROM cell WHERE ruled IS NOT NULL) x ON g.cell = x.cell GROUP BY g.cell
), grid AS MATERIALIZED (SELECT cell, allow, block, cell // {a} AS ab, (cell // {a}) % {a} AS b, cell % {a} AS c FROM cnt),
bc AS (SELECT b, c, {', '.join(f'sum({k}) AS {k}_bc' for k in both)} FROM grid GROUP BY b, c),
one AS (SELECT c, {', '.join(f'sum({k}_bc) AS {k}_c, sum(sum({k}_bc)) OVER () AS {k}_n' for k in both)} FROM bc GROUP BY c),
aft AS (SELECT b, {', '.join(f'sum({k}_bc) AS {k}_b, count(CASE WHEN {k}_bc > 0 THEN 1 END) AS {k}_bt' for k in both)} FROM bc GROUP BY b),
two AS (SELECT ab, {', '.join(f'sum({k}) AS {k}_ab, count(CASE WHEN {k} > 0 THEN 1 END) AS {k}_abt' for k in both)} FROM grid GROUP BY ab),
model AS (SELECT cell, {log_p('allow')} - {log_p('block')} AS d FROM grid JOIN bc USING (b, c) JOIN one USING (c) JOIN aft USING (b) JOIN two USING (ab)),
score AS (SELECT rid, round(sum(d ORDER BY i) / count(*), 6) AS score FROM cell JOIN model USING (cell) GROUP BY rid),
bins AS (
  SELECT CAST(least(greatest(floor(score * {u.EDGES_PER_UNIT}), {-u.LARGEST * u.EDGES_PER_UNIT}), {u.LARGEST * u.EDGES_PER_UNIT}) AS BIGINT) AS bin,
         count(CASE WHEN ruled = 'allow' THEN 1 END) AS allow, count(CASE WHEN ruled = 'block' THEN 1 END) AS block
  FROM r JOIN score USING (rid) WHERE ruled IS NOT NULL GROUP BY 1
), cut AS (
  SELECT bin, round(coalesce(sum(allow) OVER below, 0) / greatest(sum(allow) OVER (), 1) + 1
                    - coalesce(sum(block) OVER below, 0) / greatest(sum(block) OVER (), 1), 9) AS wrong,
         sum(allow) OVER () AS allows, sum(block) OVER () AS blocks
  FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (
  SELECT coalesce((SELECT bin / {u.EDGES_PER_UNIT}.0 FROM cut WHERE allows > 0 AND blocks > 0 ORDER BY wrong, abs(bin), bin LIMIT 1), 0.0) AS threshold
)
SELECT page_id, host, path, rule, score, coalesce(ruled, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN score USING (rid), best
"""



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A one-row relation with the table of CRC-32.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
)"""


def _crc(codes: str) -> str:
    """CRC-32 of a list of bytes; ``tab`` is in reach."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _op11() -> str:
    s = spelling
    codes = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195::BIGINT, CAST(ord(c) - 64 AS BIGINT)] END))"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {s.MIN_LETTERS} GROUP BY doc_id, run
), hashed AS (SELECT run, n, {_crc(codes)} AS h FROM runs, crc_table),
noisy AS (
  SELECT CASE WHEN h % {s.NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= {s.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {s.MIN_COUNT}
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN w v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN w v ON c.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS form_n, first(near ORDER BY near_n DESC, near) AS form FROM near GROUP BY word
), told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {s.FORM_RATIO} * w.n THEN form END AS form,
         CASE WHEN form_n >= {s.FORM_RATIO} * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word
), way AS (
  SELECT word, word AS root FROM told UNION ALL SELECT way.word, t.form FROM way JOIN told t ON way.root = t.word WHERE t.form IS NOT NULL
)
SELECT told.word, form, root, told.n, n_near, form_n FROM told
JOIN (SELECT way.word, way.root FROM way JOIN told t ON way.root = t.word WHERE t.form IS NULL) USING (word)
"""


def _op12() -> str:
    d = line_dedup
    white = " || ".join(f"chr({c})" for c in (32, *range(9, 14)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT rid, doc_id, text, line, place, translate(trim(line, {white}), '{_UPPER}', '{_LOWER}') AS key FROM l),
shared AS (
  SELECT key FROM (SELECT DISTINCT key, doc_id, sha256(text) AS digest FROM k) WHERE length(key) >= {d.MIN_LETTERS} GROUP BY key HAVING count(*) >= {d.MIN_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN shared ON k.key = shared.key GROUP BY rid, doc_id
"""


def _op13() -> str:
    def leaf(n_chars: str) -> str:
        texts = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(" + " || ".join(f"CASE WHEN {t} IS NULL THEN '-' ELSE strlen({t}) || ':' || {t} END" for t in texts) + ")"

    def levels(name: str, start: str) -> str:
        """Nodes of every level of the trees of ``start`` (g, pos, digest)."""
        return f"""{name} AS (
  SELECT 0 AS level, g, pos, digest, count(*) OVER (PARTITION BY g) AS held FROM {start}
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(held) + 1) // 2 FROM {name} WHERE held > 1 GROUP BY level, g, pos // 2
)"""

    def siblings(nodes: str, tree: str, up: int) -> str:
        """Per level of a node's way up: L or R and the digest left or right of it, or N."""
        return f"""SELECT x.rid, {up} + a.level AS level, coalesce(CASE WHEN b.pos < a.pos THEN 'L' ELSE 'R' END || b.digest, 'N') AS side
  FROM {nodes} x JOIN {tree} a ON a.g = x.g AND a.pos = x.pos >> a.level AND a.held > 1
  LEFT JOIN {tree} b ON b.g = a.g AND b.level = a.level AND b.pos = xor(a.pos, 1)"""

    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    grown = "CAST(n_chars AS HUGEINT) + 1"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS g, {leaf('n_chars')} AS leaf,
         CASE WHEN {_crc(codes)} % 7 = 0 THEN {leaf(grown)} ELSE {leaf('n_chars')} END AS changed
  FROM documents, crc_table
), leaves AS MATERIALIZED (
  SELECT rid, doc_id, g, leaf AS digest, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), {levels('inner_tree', 'leaves')}, subroots AS MATERIALIZED (
  SELECT g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS pos, 0 AS g FROM (SELECT g, digest FROM inner_tree WHERE held = 1)
), {levels('outer_tree', 'subroots')}, top AS (SELECT digest AS root FROM outer_tree WHERE held = 1),
placed AS (SELECT l.rid, s.g, s.pos FROM leaves l JOIN subroots s ON s.name = l.g),
sides AS ({siblings('leaves', 'inner_tree', 0)} UNION ALL {siblings('placed', 'outer_tree', 1000)}),
ways AS (SELECT rid, list(side ORDER BY level) AS way FROM sides GROUP BY rid),
folded AS (
  SELECT l.rid, sha256(list_aggregate(list_transform(list_filter(coalesce(way, []), lambda x: x <> 'N'), lambda x: x[2:]), 'string_agg', '')) AS proof_sha256,
         list_reduce(list_prepend(l.changed, coalesce(way, [])),
           lambda c, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || c) WHEN 'R' THEN sha256(c || x[2:]) ELSE sha256(c) END) AS folded_root
  FROM leaves l LEFT JOIN ways ON ways.rid = l.rid
)
SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.name = l.g JOIN folded f ON f.rid = l.rid CROSS JOIN top
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _op3(), "op6_url_filter": _op6(), "op11_spelling_variants": _op11(), "op12_line_dedup": _op12(),
        "op13_merkle_manifest": _op13(),
    }
