"""SQL checks of the operators that SQL can express (DuckDB)."""

#: Rules and the moment-fitted beta prior of quality_rules, stated from the definitions.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, i + k AS p FROM rep, range(3) AS r(k)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
          OR 100 * n_dup_lines > 50 * n_lines) AS rule_failed FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS bad FROM f GROUP BY source),
prior AS (SELECT avg(bad / n) AS mu, var_pop(bad / n) AS v FROM h),
rate AS (
  SELECT source, (bad + s * mu) / (n + s) > 0.5 AS host_rejected FROM h, (
    SELECT mu, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mu * (1 - mu) / v - 1))
                    ELSE 1000.0 END AS s FROM prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT rule_failed AND NOT host_rejected AS kept, rule_failed, host_rejected
FROM f JOIN rate ON f.source IS NOT DISTINCT FROM rate.source
"""

#: Items whose distinct 5-word shingles (a shorter text: itself) stand to four fifths in a text.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id AS id, 'd' AS side,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 'i',
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT id, side, array_to_string(w[i : i + 4], ' ') AS g FROM (
    SELECT id, side, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
hits AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment
FROM hits JOIN n ON n.id = hits.item_id WHERE 5 * n_shared >= 4 * n
"""

#: Conversations that no longer conversation starts with, turn by turn, one of equal ones.
OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n,
         list(coalesce(role, '') || chr(1) || coalesce(text, '') ORDER BY turn NULLS FIRST, role NULLS FIRST,
              text NULLS FIRST) AS t,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>',
                    chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT t[1 : k] AS t FROM (SELECT t, unnest(range(1, n)) AS k FROM c))
SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies,
       any_value(rendered) AS rendered
FROM c WHERE t NOT IN (SELECT t FROM p) GROUP BY t
"""


def _merkle_sql(fanout: int = 16, levels: int = 6, top_levels: int = 5) -> str:
    """The manifest with its levels written out: ``levels`` for the sources (16.7 million
    rows each), ``top_levels`` above them. ``r`` lists a run's digests, ``a`` is a node's index."""
    def tree(name: str, depth: int) -> str:
        steps = []
        for k in range(depth):
            steps.append(f"""
{name}{k}r AS (SELECT g, a // {fanout} AS a, list(d ORDER BY a) AS r, any_value(n) AS n FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT g, a, CASE WHEN n > 1 THEN sha256(array_to_string(r, '')) ELSE r[1] END AS d,
  (n + {fanout - 1}) // {fanout} AS n FROM {name}{k}r)""")
        return ",".join(steps)

    def path(name: str, depth: int, start: str) -> str:
        """(id, p): the lists [left, right] of each node of ``start`` (id, g, a), level by level."""
        arms = [f"""
  SELECT x.id, {k} AS k, [array_to_string(r[1 : (x.a // {fanout ** k}) % {fanout}], ''),
    array_to_string(r[(x.a // {fanout ** k}) % {fanout} + 2 :], '')] AS s
  FROM {start} x JOIN {name}{k}r t ON t.g = x.g AND t.a = x.a // {fanout ** (k + 1)} WHERE t.n > 1"""
                for k in range(depth)]
        return "SELECT id, list(s ORDER BY k) AS p FROM (" + " UNION ALL ".join(arms) + ") GROUP BY id"

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
                 for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    bits = ("flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: "
            "list_transform(range(8), lambda j: (ascii(c)::BIGINT >> j::INT) & 1)))")
    crc = (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda x, b: "
           "xor(x >> 1, CASE WHEN (xor(x, b) & 1) = 1 THEN 3988292384 ELSE 0 END)))")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf('(' + lower + ')')} END AS changed FROM documents),
p AS (
  SELECT id, doc_id, leaf, coalesce(changed, leaf) AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS a,
         count(*) OVER (PARTITION BY source) AS n FROM d),
s0 AS (SELECT g, a, leaf AS d, n FROM p),{tree("s", levels)},
t0 AS (SELECT 0 AS g, g AS a, d, count(*) OVER () AS n FROM s{levels}),{tree("t", top_levels)},
u AS (SELECT g AS id, 0 AS g, g AS a FROM s{levels}),
sp AS ({path("s", levels, "p")}),
tp AS ({path("t", top_levels, "u")}),
f AS (
  SELECT p.doc_id, p.leaf, p.seen, s.d AS subroot, t.d AS root,
         list_concat(coalesce(sp.p, []), coalesce(tp.p, [])) AS path
  FROM p JOIN s{levels} s ON s.g = p.g JOIN t{top_levels} t ON true
  LEFT JOIN sp ON sp.id = p.id LEFT JOIN tp ON tp.id = p.g),
e AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256,
         list_reduce(list_concat([[seen, '']], path), lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root
  FROM f)
SELECT *, folded_root = root AS verified FROM e
"""


#: Digest trees per source and over the sources, with the proof of every row.
OP12_SQL = _merkle_sql()

#: Components of documents whose sets of 3-word shingles (a shorter text: itself) have
#: 100 * intersection >= 85 * union.
OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT id, list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i : i + 2], ' ')))) AS g
  FROM w WHERE len(w) > 0),
u AS (SELECT g, min(id) AS u FROM l GROUP BY g),
s AS (SELECT u, len(g) AS n, unnest(g) AS x FROM u),
pair AS (
  SELECT a.u AS a, b.u AS b FROM s a JOIN s b ON a.x = b.x AND a.u <> b.u
  GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT u AS a, u AS b FROM u
  UNION
  SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
root AS (SELECT a AS u, min(b) AS root FROM reach GROUP BY a),
m AS (SELECT l.id, len(l.g) AS n, root.root FROM l JOIN u USING (g) JOIN root ON root.u = u.u),
least AS (SELECT root, min(doc_id) AS component_id FROM m JOIN w USING (id) GROUP BY root),
o AS (
  SELECT w.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles,
         CASE WHEN m.id IS NULL THEN w.doc_id ELSE least.component_id END AS component_id
  FROM w LEFT JOIN m USING (id) LEFT JOIN least ON least.root = m.root)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""

#: Every vec_id divisible by 100 against all rows, in whole numbers.
OP13_SQL = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, r.id, a.label = r.label AS own,
         list_dot_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.id % 100 = 0 AND r.id <> a.id),
p AS (
  SELECT a, id, score FROM s WHERE own
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.a, p.id AS p, p.score AS ps, s.id, s.score,
         row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, id AS negative_id,
       ps AS positive_score, score AS negative_score FROM n WHERE rank <= 10
"""
