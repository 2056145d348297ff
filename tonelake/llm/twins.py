"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .url_filter import DEVIATIONS, DOUBLE_SUFFIXES, FAINT, LEAST_WEIGHT, MOST_WEIGHT, THRESHOLD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _weight(table: str) -> str:
    alike = "(sum(power(k - m * above, 2) / m) - sum(above * (1 - above))) / nullif(sum(above * (1 - above) * (m - 1)), 0)"
    return f"(SELECT coalesce(least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, CASE WHEN {alike} > 0 THEN 1 / ({alike}) - 1 ELSE {MOST_WEIGHT} END)), {MOST_WEIGHT}) FROM {table} WHERE m > 0)"


def _posterior(table: str) -> str:
    prior = f"greatest({FAINT}, above * (1 - above) / (above * (1 - above) / ({_weight(table)} + 1) + doubt) - 1)"
    return f"(SELECT *, k + {prior} * above AS bad, m - k + {prior} * (1 - above) AS good FROM {table})"


_PARENT = "bad / (bad + good) AS above, bad * good / ((bad + good) * (bad + good) * (bad + good + 1)) AS doubt"

URL_FILTER = f"""
WITH cut AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM cut
), labelled AS (
    SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad FROM ruled
), hosts AS (
    SELECT host, sum(coalesce(bad, 0)) AS k, count(bad) AS m FROM labelled GROUP BY host
), named AS (
    SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '(:[0-9]*)?\\.*$', '') AS name FROM hosts
), parts AS (
    SELECT *, regexp_matches(name, '^[0-9.]*$|^\\[') AS address, string_split(name, '.') AS labels FROM named
), two AS (
    SELECT *, array_to_string(labels[-2:], '.') IN {DOUBLE_SUFFIXES} AS two FROM parts
), placed AS (
    SELECT host, k, m, CASE WHEN address THEN name WHEN two THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
           CASE WHEN address THEN name WHEN two THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix
    FROM two
), share AS (
    SELECT (sum(k) + 0.5::DOUBLE) / (sum(m) + 1) AS above, sum(m) AS labelled FROM placed
), s AS (
    SELECT suffix, sum(k) AS k, sum(m) AS m, any_value(share.above) AS above, any_value(share.above * (1 - share.above) / (share.labelled + 2)) AS doubt FROM placed, share GROUP BY suffix
), s_known AS (
    SELECT suffix, {_PARENT} FROM {_posterior("s")}
), d AS (
    SELECT domain, suffix, sum(k) AS k, sum(m) AS m, any_value(above) AS above, any_value(doubt) AS doubt FROM placed JOIN s_known USING (suffix) GROUP BY domain, suffix
), d_known AS (
    SELECT domain, {_PARENT} FROM {_posterior("d")}
), h AS (
    SELECT host, k, m, above, doubt FROM placed JOIN d_known USING (domain)
), h_known AS (
    SELECT host, k, m, ln(bad / good) - {DEVIATIONS} * sqrt(1 / bad + 1 / good) > ln({THRESHOLD} / (1 - {THRESHOLD})) AS blocked FROM {_posterior("h")}
)
SELECT page_id, host, path, rule, CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
       m AS n_labelled, CAST(k AS BIGINT) AS n_bad
FROM labelled JOIN h_known USING (host)
"""

COLLOCATIONS = f"""
WITH rows AS (
    SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents
), pieces AS (
    SELECT row_number() OVER () AS piece, lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM rows)
), words AS (
    SELECT piece, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM pieces
), runs AS (
    SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4 FROM words WINDOW x AS (PARTITION BY piece ORDER BY i)
), sizes AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, 1 AS width, w1 AS p FROM runs
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), f AS (
    SELECT lang, width, p, string_split(p, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), halves AS (
    SELECT lang, p, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM f, range(1, 4) AS t(k) WHERE width > k
), cuts AS (
    SELECT c.*, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
    FROM halves AS c JOIN f AS l ON l.lang = c.lang AND l.p = c.head JOIN f AS r ON r.lang = c.lang AND r.p = c.tail
), best AS (
    SELECT lang, p, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), longer AS (
    SELECT lang, unnest(list_transform(range(1, width - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p, f FROM f, range(2, 4) AS t(k) WHERE width > k
), most AS (
    SELECT lang, p, max(f) AS longest FROM longer GROUP BY ALL
), kept AS (
    SELECT lang, p AS phrase, a, l, r, score FROM best LEFT JOIN most USING (lang, p) WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

SQL = {"op12_phrase_collocations": COLLOCATIONS, "op13_url_filter": URL_FILTER}
