"""The thin queries of the text operators and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, media, packing, secret_scan, token_counts, toxicity,
    whitening,
)
from .common import held_out, table


#: The end-of-text id of the word vocabulary.
WORD_BPE_END = 49407


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), WORD_BPE_END)


#: Both turns of the conversation that every run formats besides the table's own.
PLANTED = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    formatted = chat_format.format_conversations(turns.unionByName(planted))
    return chat_format.digests(chat_format.with_loss_mask(formatted))


SQL_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, contains(text, '</turn>' || chr(10)) OR contains(text, '\\') OR contains(text, '#\##') OR contains(text, '<\/turn>')
    OR contains(role, '</turn>' || chr(10)) OR contains(role, '\\') OR contains(role, '#\##') OR contains(role, '<\/turn>')
    OR contains(role, ':\ ') OR contains(role || ': ', ': ') AND strpos(role || ': ', ': ') <= length(role) AS odd
  FROM t
), u AS (
  SELECT *, CASE WHEN odd THEN
      length(replace(replace(replace(replace(role, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>'), ': ', ':\ '))
      + length(replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>'))
    ELSE length(role) + length(text) END + 14 AS chars
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


#: All windows that hold a shingle of an item, each compared with it.
SQL_DECONTAMINATION = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), own AS (
  SELECT item_id, n, k, m, s, count(*) AS ci FROM (SELECT item_id, n, k, m, array_to_string(w[p + 1 : p + k], ' ') AS s FROM (SELECT *, unnest(range(m)) AS p FROM i))
  GROUP BY ALL
), sh AS (
  SELECT r, k, p, size, array_to_string(w[p + 1 : p + k], ' ') AS s
  FROM (SELECT r, w, k, len(w) AS size, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))
), hits AS (
  SELECT r, item_id, n, k, m, s, ci, p, size FROM sh JOIN own USING (k, s)
), enough AS (
  SELECT r, item_id FROM hits GROUP BY ALL HAVING 4 * count(*) >= 3 * min(m)
), starts AS (
  SELECT *, unnest(range(greatest(p - m + 1, 0), least(p, greatest(size - n, 0)) + 1)) AS b FROM hits SEMI JOIN enough USING (r, item_id)
), per AS (
  SELECT r, item_id, b, m, least(m, size - k + 1) AS own, s, least(count(*), min(ci)) AS c FROM starts GROUP BY r, item_id, b, m, size, k, s
), win AS (
  SELECT r, item_id, m + own AS total, sum(c) AS c FROM per GROUP BY r, item_id, b, m, own
)
SELECT doc_id, item_id, max(c / (total - c)) AS similarity FROM win JOIN d USING (r)
WHERE 100 * c >= 75 * (total - c) GROUP BY r, doc_id, item_id
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs of documents that share a shingle; then the smallest id that a chain of links reaches.
SQL_JACCARD = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p + 1 : p + 5], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY a, b)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = html_extract.train(pages)
    found = pages.select("page_id", "url", html_extract.main_text(weights, F.col("html"), spark).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "pos", "part", "run", "value", "score", "is_secret")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encoded(F.col("text"), *file, spark).alias("ids"))
    docs = docs.withColumn("bytes", byte_bpe.decoded(F.col("ids"), *file, spark))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


#: All pairs of an anchor and a row.
SQL_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=1024, offset=100_000)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_language_id": op2_language_id, "op4_chat_format": op4_chat_format}
QUERIES |= {"op3_token_counts": op3_token_counts}
QUERIES |= {"op5_decontamination": op5_decontamination, "op10_secret_scan": op10_secret_scan}
QUERIES |= {"op6_jaccard_join": op6_jaccard_join, "op7_packing": op7_packing, "op8_html_extract": op8_html_extract, "op9_media": op9_media}
QUERIES |= {"op11_byte_bpe": op11_byte_bpe, "op12_hard_negatives": op12_hard_negatives, "op13_whitening": op13_whitening}
SQL = {"op12_hard_negatives": SQL_NEGATIVES, "op4_chat_format": SQL_CHAT, "op5_decontamination": SQL_DECONTAMINATION, "op6_jaccard_join": SQL_JACCARD}
