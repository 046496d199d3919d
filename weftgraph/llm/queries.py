"""The corpus operators as queries over a folder of tables, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, divergence, exact_dedup, language, licenses, near_dedup, packing, prefix_trie, quality, sim_hash, substring_dedup, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op8_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"], m["end"])), ",")
    return chat.rotate(_table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim_hash.link(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_quality, op4_license_scan, op5_decontaminate, op6_language, op7_substring_dedup, op8_rotate, op9_suffix_dedup, op10_pack, op11_divergence, op12_simhash, op13_prefix_trie)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"('{pair}', {n}, {at}, {pairs}, {base}, '{label}')" for pair, n, at, pairs, base, label in licenses.template_rows()[1:])

ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ}, '{_WORDS}') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+9], ' '))) AS g, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM n),
p AS (SELECT doc_id, w, k.k AS k, unnest(range(1, len(w) - k.k + 2)) AS i FROM d, k),
h AS (SELECT doc_id, i, p.k AS k, item_id FROM p JOIN n ON n.k = p.k AND n.g = array_to_string(w[i:i+p.k-1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_license_scan": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ}, '{_WORDS}') AS w FROM documents),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(pair, template, tpos, pairs, is_base, label)),
g AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM d WHERE len(w) > 1),
m AS (SELECT doc_id, template, is_base, label, pairs, pos, tpos FROM g JOIN t USING (pair)),
c AS (SELECT doc_id, template, label, pairs, pos, tpos, 1 AS n FROM m WHERE NOT is_base
      UNION SELECT m.doc_id, m.template, m.label, m.pairs, m.pos, m.tpos, c.n + 1 FROM c JOIN m ON m.doc_id = c.doc_id AND m.template = c.template
      WHERE m.tpos > c.tpos AND m.pos > c.pos AND abs((m.pos - m.tpos) - (c.pos - c.tpos)) <= {licenses.NEAR}),
s AS (SELECT doc_id, is_base, label, pos - tpos AS first, count(*) / pairs AS share FROM m WHERE is_base GROUP BY doc_id, is_base, label, template, pairs, pos - tpos
      UNION ALL SELECT doc_id, false, label, NULL, max(n) / any_value(pairs) FROM c GROUP BY doc_id, template, label),
r AS (SELECT doc_id, count(*) FILTER (is_base AND share = 1) AS n_base, min(first) FILTER (is_base AND share = 1) AS first_word, max(first) FILTER (is_base AND share = 1) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (is_base AND share = 1)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label) FILTER ((is_base AND share = 1) OR (NOT is_base AND share >= {licenses.COVERAGE}))), ',') AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN r USING (doc_id)""",
    "op8_rotate": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text, turn // {chat.SEGMENT} AS segment FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> 'system'),
h AS (SELECT c.*, perspective, role = perspective AS own, '{chat.OPEN}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head FROM c JOIN p USING (conv_id)),
o AS (SELECT *, length(head) + length(text) + {len(chat.CLOSE)} + 1 AS size, row_number() OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, role, text) AS n FROM h),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, perspective, segment ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS begins FROM o)
SELECT conv_id, perspective, segment, min(turn)::BIGINT AS first_turn, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || text || '{chat.CLOSE}' || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(begins || '-' || (begins + length(text) + {len(chat.CLOSE)}), ',' ORDER BY n) FILTER (own), '') AS mask FROM a GROUP BY conv_id, perspective, segment""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS x FROM r WHERE n > 1),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS x, unnest(w) AS word FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t, count(*) AS n FROM a ANTI JOIN c USING (doc_id, x) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(s.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS d FROM (SELECT row_number() OVER () AS i, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING sum(d) >= 30),
l AS (SELECT lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(t.n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, 1 + (1000000000 * (coalesce(t.n, 0) + 5)::HUGEINT) // (g.total + 5 * v) AS p, 1 + (1000000000 * (k.n + 5)) // (l.total + 5 * v) AS q FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op13_prefix_trie": r"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(z[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), z),
o AS (SELECT *, md5(role) || md5(text) AS mark, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS r FROM t),
b AS (SELECT c.conv_id, r, 0 AS own, mark, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND r <= h UNION ALL SELECT conv_id, r, 1, mark, words FROM o JOIN c USING (conv_id) WHERE r > h),
s AS (SELECT conv_id, words, row_number() OVER w AS depth, md5(string_agg(mark, '') OVER w) AS node FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, r)),
m AS (SELECT conv_id, 0 AS depth, 0 AS words, '' AS node FROM c UNION ALL SELECT conv_id, depth, words, node FROM s),
e AS (SELECT arg_max(node, depth) AS node, conv_id FROM m GROUP BY conv_id),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM m GROUP BY node, depth),
u AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN m p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM u GROUP BY parent),
a AS (SELECT a.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(saved) AS saved_tokens FROM n LEFT JOIN k USING (node) JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node),
f AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM e GROUP BY node)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u JOIN a USING (node) LEFT JOIN k USING (node) LEFT JOIN f USING (node) LEFT JOIN n p ON p.node = u.parent""",
}
