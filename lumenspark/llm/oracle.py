"""DuckDB SQL of the queries that SQL can express."""

_HOST = "translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"

_URLS = f"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, position('/' IN rule)) AS p FROM rules),
urls AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
best AS (
    SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM urls LEFT JOIN split ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best"""

_QUALITY = """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
parts AS (
    SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM texts),
grams AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM parts)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS i FROM twice) GROUP BY doc_id),
counts AS (
    SELECT doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
    FROM parts LEFT JOIN covered USING (doc_id)),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS rules_failed,
        100 * n_symbols > 2 * word_chars OR 100 * n_dup_lines > 35 * n_lines OR 100 * n_repeat_words > 25 * n_words AS doubtful
    FROM counts),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (rules_failed)::DOUBLE AS k FROM judged GROUP BY host),
moments AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS spread FROM hosts),
prior AS (SELECT m, CASE WHEN spread > 0 THEN least(1000.0::DOUBLE, greatest(2.0::DOUBLE, m * (1 - m) / spread - 1)) ELSE 1000.0::DOUBLE END AS weight FROM moments),
rates AS (SELECT host, m, (k + m * weight) / (n + weight) AS rate, n + weight + 1 AS size FROM hosts, prior),
verdicts AS (SELECT host, CASE WHEN rate > 0.5::DOUBLE THEN 'bad' WHEN rate - m > 1.6448536269514722::DOUBLE * sqrt(rate * (1 - rate) / size) THEN 'suspect' ELSE 'good' END AS host_verdict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (rules_failed OR host_verdict = 'bad' OR doubtful AND host_verdict = 'suspect') AS kept, rules_failed, doubtful, host, host_verdict
FROM judged JOIN verdicts USING (host)"""

SQL = {"op7_url_filter": _URLS, "op10_quality_rules": _QUALITY}
