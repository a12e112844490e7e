"""The operators over their whole tables, with production parameters, and the SQL to hold them against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, embedding_dedup, importance, language_id, minhash, mpeg_audio, personal_data, prefix_trie, quality, source_mix, suffix_dedup, token_counts, toxicity
from quern.llm.common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document, learnt from rows that aren't held out. Awkward rows: see the operator."""
    out = held_out("doc_id", 5, 0)
    found = language_id.identify(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components over 3-word shingles of a similarity of 85 % or more. Awkward rows: see the operator."""
    return minhash.near_copies(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit by the sentencepiece model. Awkward rows: see the operator."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by the byte-level ranks. Awkward rows: see the operator."""
    return byte_bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from labels of rows that aren't held out. Awkward rows: see the operator."""
    out = held_out("doc_id", 3, 1)
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each document. Awkward rows: see the operator."""
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept over cosines of 0.9 or more; the operator also gives its audited recall. Awkward rows: see the operator."""
    found = embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op8_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from labels of rows that aren't held out. Awkward rows: see the operator."""
    out = held_out("doc_id", 3, 1)
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by strings of 50 bytes. Awkward rows: see the operator."""
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and digests of every text stored as a stream and read back. Awkward rows: see the operator."""
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text. Awkward rows: see the operator."""
    return personal_data.span_digests(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of a draw towards the benchmark. Awkward rows: see the operator."""
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node. Awkward rows: see the operator."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mix": op6_source_mix,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity_kn": op8_toxicity_kn,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_personal_data": op11_personal_data,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {}

ORACLE["op6_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS tie FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS full_at FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM c WINDOW up AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, docs, coalesce(least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)), cap) AS target FROM l),
p AS (
  SELECT source AS of, source_size, target, ceil(docs / 2000)::BIGINT AS blocks,
         ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 7))::BIGINT * 4 AS ofs,
         coalesce(floor(target / nullif(source_size, 0)::DOUBLE * 1073741824 + 0.5), 0)::BIGINT AS step FROM t),
j AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), ('0x' || substr(tie, 1, 8))::BIGINT % blocks, size, tie) AS nth
  FROM d JOIN p ON source IS NOT DISTINCT FROM of)
SELECT doc_id, size, source_size, target, size * ((ofs + nth * step) // 1073741824 - (ofs + (nth - 1) * step) // 1073741824) AS taken FROM j
"""

ORACLE["op2_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.seen = u.a),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

ORACLE["op9_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (len(h) // 2)::BIGINT AS n_bytes FROM d),
w AS (SELECT doc_id, unnest(range(0, n_bytes - 49)) AS s, hash(substr(h, (2 * s + 1)::BIGINT, 100)) AS g FROM (SELECT * FROM n WHERE n_bytes >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT doc_id, s FROM w JOIN m USING (g) WHERE least < doc_id),
b AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS p FROM hit),
runs AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM b),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 1 AS z FROM runs GROUP BY doc_id, r),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER o, 0) AS a, p.a AS z, row_number() OVER o AS k FROM spans p WINDOW o AS (PARTITION BY doc_id ORDER BY p.a)
  UNION ALL SELECT doc_id, max(z), NULL, count(*) + 1 FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(z, n_bytes) - a))::BIGINT), '' ORDER BY k) AS h FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN t ON t.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

ORACLE["op7_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, u.b FROM r JOIN u ON r.seen = u.a),
m AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM u GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.vec_id = m.vec_id
"""

#: The stored form in SQL: an Info frame, then a frame of 15 bytes of header, checksum and side information, a unit, and zeros.
ORACLE["op10_mpeg_audio"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, greatest(1, (len(h) + 1151) // 1152)::BIGINT AS n, h FROM d),
p AS (SELECT doc_id, n_bytes, n, h || repeat('FF', 576 * n - n_bytes) AS h FROM u),
m AS (
  SELECT *, 'FFF2D8C0E1F0' || repeat('00', 9) AS head, list_transform(range(0, 32), lambda k: ('0x' || substr(h, (len(h) - 63 + 2 * k)::BIGINT, 2))::BIGINT) AS tail,
    list_aggregate(list_transform(range(0, 100), lambda k: lpad(to_hex(k * 256 // 100), 2, '0')), 'string_agg', '') AS toc FROM p),
s AS (
  SELECT *, unhex(head || hex('Info') || '00000007' || lpad(to_hex(n), 8, '0') || lpad(to_hex((n + 1) * 648), 8, '0') || toc || repeat('00', 648 - 15 - 16 - 100)
    || list_aggregate(list_transform(range(0, n), lambda k: head || substr(h, (1152 * k + 1)::BIGINT, 1152) || repeat('00', 57)), 'string_agg', '')) AS media FROM m)
SELECT doc_id, n_bytes, 576 * n AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295::BIGINT, list_reduce(tail, lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) AS tail_crc32,
  648 * (n + 1) AS media_bytes, sha256(media) AS media_sha256,
  'v2 l3 16000 Hz 1 ch; frames ' || n || '; samples ' || 576 * n || '; seconds ' || 9 * n // gcd(n, 250) || '/' || 250 // gcd(n, 250) || '; crc ' || n || '/0; resync 0; table Info ' || n || '; last frame ' || 648 * n AS feature
FROM s
"""

#: CRC-32 of distinct words only, bit by bit.
ORACLE["op12_importance_resampling"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT r, unnest(ws) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)),
c AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::BIGINT, 2))::BIGINT),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) % 10000 AS bucket FROM v),
s AS (SELECT bucket, count(*) AS s FROM x JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM x) AS ss, (SELECT count(*) FROM b) AS tt),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(0, 10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM x JOIN c USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS nth, count(*) OVER () * 10 // 100 AS size FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN nth <= size THEN nth END AS rank FROM e LEFT JOIN k USING (doc_id)
"""

ORACLE["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, ''))::BIGINT AS size,
    turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS nth FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295::BIGINT, list_reduce(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT),
      lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, g, size, nth FROM c JOIN o ON o.conv_id = c.base AND nth <= h
  UNION ALL SELECT c.conv_id, g, size, nth + 100000000 FROM c JOIN o ON o.conv_id = c.conv_id AND nth > h),
r AS (SELECT conv_id, size, row_number() OVER w AS d, string_agg(g, ',') OVER w AS p FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
u AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS p, NULL AS up, 0::BIGINT AS size FROM c
  UNION ALL SELECT conv_id, d, p, CASE WHEN d = 1 THEN '' ELSE substr(p, 1, length(p) - 65) END, size FROM r),
n AS (SELECT p, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM u GROUP BY p),
l AS (SELECT conv_id, max(d) AS d FROM u GROUP BY conv_id),
z AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM u JOIN l USING (conv_id, d) GROUP BY p),
k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT a.p, sum((x.n_convs - 1) * x.size)::BIGINT AS saved, count(*) FILTER (k.kids IS NULL) AS leaves
  FROM n a JOIN n x ON x.p = a.p OR a.depth = 0 OR starts_with(x.p, a.p || ',') LEFT JOIN k ON k.up = x.p GROUP BY a.p)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN n m ON m.p = n.up LEFT JOIN k ON k.up = n.p LEFT JOIN z ON z.p = n.p
"""
