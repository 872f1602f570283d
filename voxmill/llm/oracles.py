"""SQL of the corpus queries that SQL can express."""

from voxmill.llm import oracles_more

_LEVEL = """
k_{name} AS (SELECT 1.0 / CASE WHEN room > 0 THEN least(greatest((spread - chance) / room, 1e-4), 0.5) ELSE 0.1 END - 1.0 AS k
  FROM (SELECT coalesce(sum(n * pow(bad / n::DOUBLE - prior, 2)), 0) AS spread, coalesce(sum(prior * (1 - prior)), 0) AS chance,
    coalesce(sum(prior * (1 - prior) * (n - 1)), 0) AS room FROM {name}s WHERE n > 0)),
post_{name} AS (SELECT {name}, (k * prior + bad) / (k + n) AS rate, k + n AS weight FROM {name}s, k_{name})"""

URL_FILTER = f"""
WITH parsed AS (SELECT page_id, url, html, strpos(url, '://') AS pos FROM pages),
cut AS (SELECT page_id, html, CASE WHEN pos > 0 THEN substr(url, pos + 3) END AS rest FROM parsed),
pieces AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM cut),
page AS (SELECT page_id, CASE WHEN rest IS NULL THEN '' ELSE translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
  CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) END AS path,
  regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|&[a-z]+;|[\\t\\n\\x0B\\f\\r ]+', '', 'g') AS visible FROM pieces),
seen AS (SELECT page_id, host, path, CASE WHEN length(visible) > 0 THEN (length(regexp_replace(visible, '[^#*$%&|!]+', '', 'g')) * 20 > length(visible))::INT END AS bad FROM page),
named AS (SELECT *, string_split(host, '.') AS l FROM seen),
leveled AS (SELECT page_id, host, path, bad, array_to_string(l[-2:], '.') IN ('ac.uk','co.in','co.jp','co.nz','co.uk','co.za','com.au','com.br','org.uk') AS is_long,
  array_to_string(l[-1:], '.') AS s1, array_to_string(l[-2:], '.') AS s2, array_to_string(l[-3:], '.') AS s3 FROM named),
placed AS (SELECT page_id, host, path, bad, CASE WHEN is_long THEN s2 ELSE s1 END AS suffix, CASE WHEN is_long THEN s3 ELSE s2 END AS domain FROM leveled),
suffixs AS (SELECT suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
  (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (count(bad) + 1.0::DOUBLE) FROM placed) AS prior FROM placed GROUP BY suffix),
{_LEVEL.format(name="suffix")},
domains AS (SELECT domain, n, bad, rate AS prior FROM (SELECT domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM placed GROUP BY 1, 2) JOIN post_suffix USING (suffix)),
{_LEVEL.format(name="domain")},
hosts AS (SELECT host, n, bad, rate AS prior FROM (SELECT host, domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM placed GROUP BY 1, 2) JOIN post_domain USING (domain)),
{_LEVEL.format(name="host")},
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM placed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN post_host USING (host)"""

_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
wins AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM wins JOIN items USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM found GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_SPACE = "[\\x20\\x09-\\x0D]+"
_BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
_spread = lambda levels: "coalesce(" + ", ".join(f"nullif({x}.high - {x}.low, 0)" for x in levels) + ", 0)"
_BIN = "v - v % power(2, greatest(length(bin(v)) - 10, 0))::BIGINT"
_QUARTILES = """SELECT {keys} metric, max(n_rows) AS n_rows, min(bin) FILTER (WHERE so_far * 4 >= n_rows) AS low, min(bin) FILTER (WHERE so_far * 4 >= n_rows * 3) AS high FROM (
  SELECT {keys} metric, bin, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bin) AS so_far, sum(n) OVER (PARTITION BY {keys} metric) AS n_rows FROM (SELECT {keys} metric, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""
QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE times > 1) GROUP BY 1),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_lines, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS bang,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
  FROM (SELECT *, len(string_split(t, chr(10))) AS n_lines, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d) d LEFT JOIN rep USING (doc_id)),
m AS (SELECT doc_id, lang, source, metric, base_failed, {_BIN} AS bin FROM (SELECT doc_id, lang, source, {_BASE_FAILED} AS base_failed, unnest(['symbols', 'capitals', 'dup_lines', 'word_length', 'bangs', 'stutter']) AS metric,
  unnest([n_symbols * 1000 // greatest(word_chars, 1), upper * 1000 // greatest(word_chars, 1), n_dup_lines * 1000 // (n_lines + 50), word_chars * 1000 // greatest(n_words, 1), bang * 1000 // greatest(n_words, 1), same * 1000 // greatest(n_words, 1)]) AS v FROM c)),
sketch AS (SELECT lang, source, metric, bin, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
own AS ({_QUARTILES.format(keys="lang, source,")}), by_lang AS ({_QUARTILES.format(keys="lang,")}), whole AS ({_QUARTILES.format(keys="")}),
fence AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.n_rows >= 100 THEN o.high + greatest(50, 5 * {_spread("oga")}) WHEN g.n_rows >= 100 THEN g.high + greatest(50, 5 * {_spread("ga")}) ELSE a.high + greatest(50, 5 * {_spread("a")}) END AS most
  FROM (SELECT * FROM own) o JOIN by_lang g ON g.lang IS NOT DISTINCT FROM o.lang AND g.metric = o.metric JOIN whole a ON a.metric = o.metric),
bad AS (SELECT doc_id, string_agg(m.metric, ',' ORDER BY list_position(['symbols', 'capitals', 'dup_lines', 'word_length', 'bangs', 'stutter'], m.metric)) AS failed FROM m JOIN fence f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source AND f.metric = m.metric WHERE bin > most GROUP BY 1)
SELECT *, NOT base_failed AND failed = '' AS kept FROM (SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_FAILED} AS base_failed, coalesce(failed, '') AS failed FROM c LEFT JOIN bad USING (doc_id))"""

ORACLES = {"op4_quality_rules": QUALITY_RULES, "op2_url_filter": URL_FILTER, "op7_decontamination": DECONTAMINATION} | oracles_more.ORACLES
