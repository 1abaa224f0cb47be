"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from tenure.llm import divergence, filteraudit, mixing, secrets, urlfilter

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)

URL_FILTER = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
                arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
         FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
         GROUP BY u.host, u.path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def _inverse(shape: tuple[float, ...]) -> str:
    knots = mixing.KNOTS
    widths = [b - a for a, b in zip(knots, knots[1:])]
    area = sum(h * (a + b) / 2 for h, a, b in zip(widths, shape, shape[1:]))
    r = [x / area for x in shape]
    cases, reached = [], 0.0
    for j, h in enumerate(widths):
        y = f"(u - {reached!r}::DOUBLE)"
        t = (f"CASE WHEN {y} <= 0 THEN {float(knots[j])!r}::DOUBLE ELSE {float(knots[j])!r}::DOUBLE + 2.0::DOUBLE * {y} / "
             f"({r[j]!r}::DOUBLE + sqrt({r[j] * r[j]!r}::DOUBLE + {2.0 * (r[j + 1] - r[j]) / h!r}::DOUBLE * {y})) END")
        reached += h * (r[j] + r[j + 1]) / 2
        cases.append(f"ELSE {t}" if j == len(widths) - 1 else f"WHEN u <= {reached!r}::DOUBLE THEN {t}")
    return f"CASE {' '.join(cases)} END"


_POSITION = "CASE " + " ".join(f"WHEN weight = {w} THEN {_inverse(shape)}" for w, shape in mixing.RATES.items()) + " END"

MIXING = f"""
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM counted),
sized AS (
  SELECT doc_id, source, size,
         md5(CASE WHEN doc_id IS NOT NULL AND copy = 0 THEN CAST(doc_id AS VARCHAR)
                  ELSE concat(coalesce(CAST(doc_id AS VARCHAR), ''), '#', size, '#', copy) END) AS ord FROM numbered),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT source, source_size,
                    [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
                    {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS budget, {mixing.REPEATS} * source_size AS cap FROM sums),
ranked AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                  sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighted),
flagged AS (SELECT *, cap::DOUBLE * weight_left::DOUBLE <= (budget - cap_before::DOUBLE) * weight AS is_full FROM ranked),
totals AS (SELECT *, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_weight,
                  coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS full_cap FROM flagged),
targets AS (SELECT source, weight, source_size,
                   CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (budget - full_cap::DOUBLE) / open_weight END AS target FROM totals),
placed AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM sized s),
taken AS (SELECT p.doc_id, p.size, p.start, t.weight, t.source_size, t.target,
                 greatest(0, least(floor(t.target)::BIGINT - p.start, p.size)) + greatest(0, least(floor(t.target)::BIGINT - t.source_size - p.start, p.size)) AS taken
          FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
timed AS (SELECT *, start::DOUBLE / target AS u FROM taken)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN {_POSITION} END AS position FROM timed
"""

_FOLD = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"

SOURCE_DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, {_FOLD}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.MIN_DOCS}),
grouped AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grouped g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
dense AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                 1 + {divergence.SCALE} * (coalesce(c.n, 0) + {divergence.SMOOTH}) // (t.total + {divergence.SMOOTH} * s.v) AS p
          FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (SELECT c.lang, c.term, 1 + {divergence.SCALE} * (sum(c.n)::HUGEINT + {divergence.SMOOTH})
                 // ((SELECT sum(total)::HUGEINT FROM totals t WHERE t.lang = c.lang) + {divergence.SMOOTH} * any_value(s.v)) AS q
          FROM counts c JOIN sizes s USING (lang) GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
over AS (SELECT d.lang, d.source, d.term AS item, d.p - w.q AS value FROM dense d JOIN whole w USING (lang, term) WHERE d.n > 0 AND d.p > w.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM over
           QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {divergence.TOP})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""

FILTER_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
fails AS (SELECT doc_id, part,
                 [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
                  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
          FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before
          FROM orders, letters s),
flat AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fail, len(list_filter(before, lambda i: f[i])) > 0 AS gone,
                len(list_filter(f, lambda x: x)) AS all_fails FROM cells, steps),
summed AS (SELECT part, filter_order, step, own,
       coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
       coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fail AND all_fails = 1), 0) AS unique_fails,
       coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
FROM flat GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""


def _found(kind: int, text: str, pattern: str) -> str:
    """Spans of a pattern: lengths of the pieces between the matches and of the matches, added up."""
    return f"""SELECT doc, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
                 start := list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                 size := length(m[i]), own := length(g[i])))) AS s
               FROM (SELECT doc, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS pieces,
                            regexp_extract_all({text}, '{pattern}', 1) AS g FROM docs)"""


_NAMES = "(?:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?"
_PLAIN = " OR ".join(f"contains(translate(value, {_FOLD}), '{w}')" for w in secrets.PLACEHOLDERS)

SECRET_SCAN = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS text, translate(coalesce(text, ''), {_FOLD}) AS low FROM documents),
found AS ({_found(0, "low", _NAMES + "([a-z0-9+/_.=-]+)")} UNION ALL {_found(1, "text", "(AKIA[A-Z0-9]+)")}
          UNION ALL {_found(2, "text", "([0-9a-f]+)")} UNION ALL {_found(3, "text", "([A-Za-z0-9_+=-]+)")}),
spans AS (SELECT doc, doc_id, source, kind, s.start::BIGINT AS start, (s.start + s.size)::BIGINT AS stop,
                 substr(text, (s.start + s.size - s.own + 1)::BIGINT, s.own) AS value FROM found JOIN docs USING (doc)
          WHERE s.own >= [{secrets.ASSIGN_MIN}, 18, 16, 20][kind + 1]),
base AS (SELECT * FROM spans WHERE kind < 3),
opaque AS (SELECT * FROM spans t WHERE kind = 3 AND len(list_distinct(string_split(value, ''))) >= {secrets.TOKEN_DISTINCT}
             AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
             AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = t.doc AND b.start < t.stop AND b.stop > t.start)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
owned AS (SELECT value, count(DISTINCT coalesce(source, '~')) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM every GROUP BY value),
judged AS (SELECT e.*, owners >= {secrets.COPIED_OWNERS} AND repositories >= {secrets.COPIED_REPOSITORIES} AS copied,
                  len(list_distinct(string_split(value, ''))) < {secrets.LIVE_DISTINCT} OR {_PLAIN} AS plain FROM every e JOIN owned USING (value)),
named AS (SELECT *, NOT copied AND NOT plain AS live, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS name FROM judged),
listed AS (SELECT doc, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                  string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS every,
                  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM named GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(every, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN listed USING (doc)
"""
