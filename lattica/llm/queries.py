"""The opN_ queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, mixing, neardup, pii, prefix_trie, search, shards, structure_repair, token_counts, toxicity, warc
from .common import new_folder, tables

#: Vocabulary files; any of the same kind will do.
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048
#: Both turns of the conversation that op10 adds: control strings inside texts.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(tables(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(tables(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tables(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(tables(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, tables(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(tables(spark, sf_dir, "documents"), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_round_trip(tables(spark, sf_dir, "documents"), new_folder(spark, "token-shards"), BYTE_BPE)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(tables(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digests(turns.unionByName(added))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(tables(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = structure_repair.damaged(tables(spark, sf_dir, "conversations"))
    return structure_repair.repair(turns, keep_turns=False).withColumnRenamed("conv", "conv_id")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.fit(docs)))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS x FROM p),
b AS (SELECT page_id, n, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS digest FROM d),
f AS (SELECT digest, min(page_id) AS first FROM b GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (digest)
"""

OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.seen FROM r JOIN e ON e.x = r.doc_id),
k AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
e AS (
  SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) AS rn,
         lag(role) OVER o IS DISTINCT FROM role AS opens FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(n + CASE WHEN opens THEN 12 + rn + 1 + 11 ELSE 10 END) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM g
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, in SQL."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_transform(range(len({text})), lambda i: ord(substr({text}, i + 1, 1)))"
    return f"xor(list_reduce({codes}, lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: {bit}), 4294967295), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) r),
c AS (SELECT conv_id, {_crc32('conv_id::VARCHAR')} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t) r),
b AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos AS d, digest, words FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(n, 0)) + pos - h, digest, words FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN b ON b.base = c.base WHERE pos > h),
p AS (SELECT c.conv_id, coalesce(list(digest ORDER BY d) FILTER (d IS NOT NULL), []) AS path, coalesce(list(words ORDER BY d) FILTER (d IS NOT NULL), []) AS ws FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
o AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path, ws FROM p),
k AS (SELECT conv_id, depth, array_to_string(path[:depth], ',') AS key, array_to_string(path[:depth - 1], ',') AS up, len(path) = depth AS ends, coalesce(ws[depth], 0) AS words, path FROM o),
n AS (
  SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, any_value(path)[:depth] AS path,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM k GROUP BY key, depth),
ch AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.up = n.key AND ch.depth = n.depth),
a AS (SELECT array_to_string(path[:d], ',') AS key, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT path, saved, n_children, unnest(range(depth + 1)) AS d FROM m) x GROUP BY ALL)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.key = m.key AND a.depth = m.depth LEFT JOIN n u ON u.key = m.up AND u.depth = m.depth - 1
"""


def _viterbi() -> str:
    """A turn's step of op12's states, as SQL. A state is a cost of 8 digits and its audit, so that the least string is best."""
    add = lambda s, n, letter: f"(lpad((left({s}, 8)::INT + {n})::VARCHAR, 8, '0') || substr({s}, 9) || '{letter}')"
    each = lambda states, n, letter: ", ".join(add(s, n, letter) for s in states)
    layer = ", ".join([
        f"{add('s0', 2, 'D')} AS t0",
        f"least({add('s1', 2, 'D')}, CASE WHEN may AND first = 's' THEN {add('s0', 'cut', 'K')} END) AS t1",
        f"least({add('s2', 2, 'D')}, CASE WHEN may AND first = 'u' THEN least({each(['s0', 's1', 's3'], 'cut', 'K')}) END, CASE WHEN may THEN least({each(['s0', 's1', 's3'], '1 + cut', 'R')}) END) AS t2",
        f"least({add('s3', 2, 'D')}, CASE WHEN may AND first = 'a' THEN {add('s2', 'cut', 'K')} END, CASE WHEN may THEN {add('s2', '1 + cut', 'R')} END) AS t3",
    ])
    return f"""SELECT conv_id, i, t0, t1, u2, least(t3, {add('u2', 5, 'I')}) FROM (
      SELECT *, least(t2, {each(['t0', 't1', 't3'], 5, 'I')}) AS u2 FROM (SELECT g.conv_id, g.i, {layer} FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1) x) y"""


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations),
x AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE f <> 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, substr(role, 1, 1) AS first
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x) y),
e AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM r),
g AS (SELECT *, fault NOT IN (1, 2) AS may, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS cut FROM e),
k AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
v(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '00000000', NULL::VARCHAR, '00000005I', '00000010II' FROM d
  UNION ALL {_viterbi()}),
z AS (
  SELECT v.conv_id, gaps, blank, duplicate, truncated, illegal, left(least(s0, s3), 8)::BIGINT AS cost, substr(least(s0, s3), 9) AS audit
  FROM v LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(n, 0)),
l AS (SELECT conv_id, audit, p, substr(audit, p, 1) AS edit, p - len(replace(left(audit, p), 'I', '')) AS inserts FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM z) y),
o AS (SELECT l.*, g.role, g.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) - 1 AS q FROM l LEFT JOIN g ON edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = p - inserts WHERE edit <> 'D'),
s AS (SELECT *, max((q = 0 AND edit = 'K' AND substr(role, 1, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS shift FROM o),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM s GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM z LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_bpe": op2_bpe, "op3_warc": op3_warc, "op4_near_duplicates": op4_near_duplicates, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_token_counts": op7_token_counts, "op8_token_shards": op8_token_shards, "op9_nearest": op9_nearest, "op10_chat": op10_chat,
            "op11_prefix_trie": op11_prefix_trie, "op12_structure_repair": op12_structure_repair, "op13_pii": op13_pii}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op10_chat": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL}
