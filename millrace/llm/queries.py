"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import alignment, bpe, chat, exact, langid, mixing, neardup, passages, permutation, topk, trie, warc, wordpiece
from millrace.session import read_table, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


@_query
def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# One half of the documents, by a hash of the id, is the snapshot, the other half the new batch.
SNAPSHOT_HALF = "pmod(xxhash64(doc_id), 2) = 0"


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicate_groups(read_table(spark, sf_dir, "documents"), F.expr(SNAPSHOT_HALF))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op1_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    training = langid.in_training(F.col("doc_id"))
    model = langid.learn(docs.filter(training))
    found = langid.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~langid.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@_query
def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("url")


ORACLES["op7_warc_round_trip"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@_query
def op8_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = wordpiece.vocabulary_of(file.read())
    return wordpiece.token_counts(read_table(spark, sf_dir, "documents"), vocabulary)


@_query
def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotations(read_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("conv_id", "speaker", "part", "n_turns", "text", spans.alias("masks"))


ORACLES["op9_perspectives"] = """
WITH t AS (
  SELECT conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') AS name, replace(coalesce(text, ''), '<|', '< |') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
r AS (
  SELECT s.conv_id, speaker, (position - 1) // 64 AS part, position, name = speaker AS own,
         '<|im_start|>' || CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user name=' || name END || chr(10) AS head,
         said || '<|im_end|>' AS body
  FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY position
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM r)
SELECT conv_id, speaker, part::INTEGER AS part, count(*)::INTEGER AS n_turns, string_agg(head || body || chr(10), '' ORDER BY position) AS text,
       coalesce(string_agg(CASE WHEN own THEN (before + length(head)) || '-' || (before + length(head) + length(body)) END, ',' ORDER BY position), '') AS masks
FROM o GROUP BY ALL
"""


@_query
def op10_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


# Every conversation is rebuilt on the first of its hundred, as many turns of it as its own checksum says.
HUNDRED = "conv_id - conv_id % 100"
HEAD = "crc32(cast(cast(conv_id AS string) AS binary)) % 6"


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"), F.expr(HUNDRED), F.expr(HEAD))


ORACLES["op11_prefix_trie"] = """
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, sha256(coalesce(role, '')), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
      FROM (SELECT DISTINCT conv_id FROM c)),
ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM b),
heads AS (SELECT i.conv_id, c.p AS d, role, text, c.conv_id AS rc, c.p AS rp FROM ids i JOIN c ON c.conv_id = i.conv_id - i.conv_id % 100 AND c.p <= h),
n AS (SELECT i.conv_id, h, count(x.d) AS nh FROM ids i LEFT JOIN heads x ON x.conv_id = i.conv_id GROUP BY ALL),
r AS (SELECT * FROM heads
      UNION ALL SELECT c.conv_id, nh + p - h, role, text, c.conv_id, p FROM c JOIN n ON n.conv_id = c.conv_id WHERE p > h),
lengths AS (SELECT n.conv_id, count(d) AS length FROM n LEFT JOIN r ON r.conv_id = n.conv_id GROUP BY ALL),
m AS (
  SELECT conv_id, 0::BIGINT AS d, ''::VARCHAR AS path, ''::VARCHAR AS above, '' AS last, NULL::BIGINT AS rc, NULL::BIGINT AS rp FROM n
  UNION ALL
  SELECT conv_id, d, string_agg(turn, '') OVER w, coalesce(string_agg(turn, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), text, rc, rp
  FROM (SELECT *, sha256(role) || sha256(text) AS turn FROM r) WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (SELECT path, above, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(length(last)) AS saved, min((rc, rp)) AS ref
          FROM m GROUP BY path, above, d),
kids AS (SELECT above AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
owned AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
sums AS (SELECT m.path, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens
         FROM m JOIN owned v ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.path),
ends AS (SELECT path, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids
         FROM m JOIN lengths ON lengths.conv_id = m.conv_id AND length = d GROUP BY path)
SELECT o.conv_id, o.d AS depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256, o.ref[1] AS ref_conv_id, o.ref[2] AS ref_position
FROM owned o JOIN sums ON sums.path = o.path LEFT JOIN ends ON ends.path = o.path
LEFT JOIN owned up ON o.d > 0 AND up.path = o.above
"""


@_query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, change=topk.quantised(256))


ORACLES["op12_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.y, c.y) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(read_table(spark, sf_dir, "documents"), *files)[0]
