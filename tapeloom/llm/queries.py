"""The registered queries of this package: whole tables in, digest columns out, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    alignment,
    bpe_count,
    byte_bpe,
    chat_format,
    chosen_path,
    decontaminate,
    html_text,
    quadratic,
    quality_rules,
    substring,
    toxicity,
    variants,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_decontaminate", """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT d.doc_id, d.i, d.size, x.item_id FROM doc_windows d JOIN item_windows x ON d.k = x.k AND d.size = x.size),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
       sha256(coalesce(x.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items x USING (doc_id)
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.scan(docs, table(spark, folder, "benchmark")).drop("text")


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query("op6_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35)),
repeated AS (SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS j FROM repeated) GROUP BY doc_id),
kept AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY j) AS body, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM w) x LEFT JOIN gone g USING (doc_id)
  WHERE g.js IS NULL OR NOT list_contains(g.js, j) GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(len(w.w), 0) AS n_words, coalesce(len(w.w), 0) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digests(table(spark, folder, "documents"))


@query("op2_chosen_path_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.links(table(spark, folder, "documents"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quadratic.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


_STOP_SQL = ", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)


@query("op9_quality_rules", f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM repeated) GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
stop AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, regexp_replace(lower(unnest(w)), '[.,;:!?]+$', '') AS x FROM d) WHERE x IN ({_STOP_SQL}) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(stop.n, 0) AS n_stop_words,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_shouted
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN line USING (doc_id) LEFT JOIN stop USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < 20 OR word_chars / n_words BETWEEN 2.0 AND 20.0) AND n_symbols / greatest(n_words, 10) <= 0.2
       AND (n_words < 100 OR n_stop_words / n_words >= 0.01) AND (n_words < 20 OR n_dup_lines / greatest(n_lines, 1) <= 0.5)
       AND (n_words < 20 OR n_shouted / greatest(word_chars, 1) <= 0.5) AS kept
FROM b
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and conversation -7 that says control strings."""
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op10_chat_format", """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '<\\\\*\\|')) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder).withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.digests(chat_format.format_chats(turns))


@query("op1_warc_index", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest, CASE WHEN best IS NULL OR best IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best IS NULL OR best IS NOT DISTINCT FROM page_id THEN NULL ELSE best END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest AND d.n >= 1000
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_html_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_column(table(spark, folder, "pages").select("page_id", "html")).withColumn("n_chars", F.length("text"))


@query("op11_toxicity")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


@query("op12_spelling_variants", f"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
occurrences AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS word FROM documents)
  GROUP BY doc_id, word),
seeds AS (
  SELECT *, hex(encode(doc_id || ':' || word)) AS hexed FROM occurrences),
hashed AS (
  SELECT doc_id, word, n, xor(4294967295, list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(hexed) // 2), lambda j: CAST('0x' || hexed[2 * j + 1:2 * j + 2] AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS h
  FROM seeds, crc_table),
results AS (
  SELECT CASE WHEN h % 31 = 0 THEN word[:h % length(word)] || word[h % length(word) + 2:] ELSE word END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS k FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.k = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.k = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, root, last) AS (
  SELECT word, word, form IS NULL FROM forms
  UNION ALL SELECT c.word, f.form, g.form IS NULL FROM chain c JOIN forms f ON c.root = f.word JOIN forms g ON f.form = g.word WHERE NOT c.last)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.last
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return variants.corpus_variants(table(spark, folder, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    paths = alignment.Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, folder, "documents"), paths)
