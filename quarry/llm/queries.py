"""Queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.audit import op13_audit
from quarry.llm.decontaminate import op9_decontaminate
from quarry.llm.factorisation import op2_quality
from quarry.llm.languages import op12_language
from quarry.llm.lines import op3_lines
from quarry.llm.mixing import op10_mixing
from quarry.llm.negatives import op11_negatives
from quarry.llm.pii import op1_pii
from quarry.llm.rules import op5_rules
from quarry.llm.sharding import op7_sharding
from quarry.llm.simhash import op4_simhash
from quarry.llm.substrings import op6_substrings
from quarry.llm.warc import op8_warc
from quarry.plans.staging import scoped


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stages of ``corpus_pipeline``, which imports this folder's operators itself."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: scoped(query)
    for name, query in {
        "op1_pii": op1_pii,
        "op2_quality": op2_quality,
        "op3_lines": op3_lines,
        "op4_simhash": op4_simhash,
        "op5_rules": op5_rules,
        "op6_substrings": op6_substrings,
        "op7_sharding": op7_sharding,
        "op8_warc": op8_warc,
        "op9_decontaminate": op9_decontaminate,
        "op10_mixing": op10_mixing,
        "op11_negatives": op11_negatives,
        "op12_language": op12_language,
        "op13_audit": op13_audit,
        "pipeline": pipeline,
    }.items()
}


ORACLE_SQL: dict[str, str] = {
    "op6_substrings": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS k FROM d WHERE len(ws) >= 13)),
h AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first_id FROM w) WHERE doc_id > first_id),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT d.doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS body, count(*) AS n
         FROM t LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM r) g ON t.doc_id = g.doc_id AND t.p = g.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_sharding": """
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS body FROM documents),
o AS (
  SELECT doc_id, size, body,
         coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS n FROM d),
s AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM o),
bits AS (SELECT range AS i, CAST(range AS UBIGINT) AS c FROM range(256)),
t AS (
  SELECT i, list_reduce(list_concat([c], [CAST(k AS UBIGINT) FOR k IN range(8)]),
         lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END) AS v FROM bits),
table_ AS (SELECT list(v ORDER BY i) AS tab FROM t),
c AS (
  SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)],
           [CAST('0x' || k AS UBIGINT) FOR k IN regexp_extract_all(hex(encode(body)), '..')]),
           lambda x, y: xor(x >> 8, tab[CAST(xor(x, y) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS crc
  FROM d, table_)
SELECT s.doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN c ON s.doc_id = c.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)""",
    "op9_decontaminate": """
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark),
iw AS (SELECT DISTINCT id AS item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM w WHERE kind = 'b' AND len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT id AS doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win
       FROM (SELECT w.id, w.ws, lens.n, unnest(range(1, len(w.ws) - lens.n + 2)) AS k FROM w, lens WHERE kind = 'd' AND len(ws) >= lens.n)),
m AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.id = h.doc_id LEFT JOIN i ON w.id = i.doc_id WHERE kind = 'd'""",
    "op10_mixing": """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5('mix-1' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '-') || chr(31) || md5(md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT g, sum(size) AS source_size FROM d GROUP BY g),
w AS (SELECT g, CAST(source_size AS DOUBLE) AS z, 2.0 * source_size AS lim,
             CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY encode(g)) - 1) % 3 AS BIGINT) + 1] AS DOUBLE) AS wt FROM s),
r AS (SELECT *, 1.5 * (SELECT sum(z) FROM w) AS total,
             coalesce(sum(lim) OVER (ORDER BY lim / wt, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled,
             sum(wt) OVER (ORDER BY lim / wt, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, wt * ((total - settled) / rest) >= lim AS capped FROM r),
l AS (SELECT (max(total) - coalesce(sum(lim) FILTER (capped), 0)) / sum(wt) FILTER (NOT capped) AS level FROM c),
t AS (SELECT g, CAST(z AS BIGINT) AS source_size, CASE WHEN capped THEN lim ELSE wt * level END AS target FROM c, l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t USING (g)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM e""",
    "op11_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((mask & (before + own)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS removed,
  coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & own) > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
