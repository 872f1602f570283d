"""SQL of the near-duplicate trees, the spelling variants and the manifest."""

#: crc32 of a text's UTF-8 bytes, by a table that the query works out.
CRC_TABLE = """crc_table AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM (SELECT unnest(range(256)) AS b)))"""


def crc32(text: str) -> str:
    """An expression over ``crc_table``'s list t."""
    code = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295)"


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CLIMB = """SELECT {g} AS g, 0 AS lv, {place} AS place, {n} AS n, {d} AS d FROM {rows}
  UNION ALL SELECT g, lv + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY g, lv, place // 8"""
_SIDES = """SELECT a.g, a.lv, a.place, coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM {name} a JOIN {name} b ON b.g = a.g AND b.lv = a.lv AND b.place // 8 = a.place // 8 WHERE a.n > 1 GROUP BY ALL"""

MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, g, leaf, tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format(text=f"translate(text, {_UPPER})")} END AS tampered FROM documents, crc_table)),
up AS ({_CLIMB.format(g="g", place="place", n="n", d="leaf", rows="leaves", name="up")}),
subs AS (SELECT g, d, (SELECT count(DISTINCT g) FROM leaves) AS n FROM up WHERE n = 1),
over AS ({_CLIMB.format(g="0", place="g", n="n", d="d", rows="subs", name="over")}),
side AS ({_SIDES.format(name="up")}),
over_side AS ({_SIDES.format(name="over")}),
steps AS (SELECT *, row_number() OVER (PARTITION BY g, place ORDER BY tree, lv) AS k FROM (
  SELECT v.g, v.place, 0 AS tree, s.lv, s.l, s.r FROM leaves v JOIN side s ON s.g = v.g AND s.place = v.place >> (3 * s.lv)
  UNION ALL SELECT v.g, v.place, 1, s.lv, s.l, s.r FROM leaves v JOIN over_side s ON s.place = v.g >> (3 * s.lv))),
folding AS (SELECT g, place, 0 AS k, coalesce(tampered, leaf) AS d FROM leaves
  UNION ALL SELECT f.g, f.place, f.k + 1, sha256(s.l || f.d || s.r) FROM folding f JOIN steps s ON s.g = f.g AND s.place = f.place AND s.k = f.k + 1),
proofs AS (SELECT g, place, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY 1, 2),
ends AS (SELECT g, place, max_by(d, k) AS folded_root FROM folding GROUP BY 1, 2)
SELECT doc_id, leaf, subs.d AS subroot, o.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = o.d AS verified
FROM leaves v JOIN subs ON subs.g = v.g JOIN (SELECT d FROM over WHERE n = 1) o ON true JOIN ends e ON e.g = v.g AND e.place = v.place LEFT JOIN proofs p ON p.g = v.g AND p.place = v.place"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(w, {_UPPER}) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents)),
seen AS (SELECT w, n, {crc32("(doc_id::VARCHAR || ':' || w)")} AS h FROM (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL), crc_table),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM seen)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM vocab)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN vocab b ON a.cut = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN vocab b ON a.cut = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1, 2),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN forms g ON g.word = f.here WHERE g.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, max_by(here, k) AS root FROM follow GROUP BY 1) USING (word)"""

CHOSEN_PATH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
-- equal sets are linked with the smallest id of theirs, and only these are compared
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(string_agg(g, chr(10) ORDER BY g))) AS rep FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, g, n FROM s JOIN same ON same.doc_id = s.doc_id AND rep = s.doc_id JOIN n ON n.doc_id = s.doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
  UNION SELECT rep, doc_id FROM same WHERE rep <> doc_id),
arcs AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT DISTINCT u AS x, u AS y FROM arcs UNION SELECT x, v FROM reach JOIN arcs ON u = y),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON x = d.doc_id"""

ORACLES = {"op11_chosen_path": CHOSEN_PATH, "op12_spelling_variants": SPELLING, "op13_merkle_manifest": MERKLE}
