"""The operators applied to their whole tables, with production parameters: what __spark_entry__ registers."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_events,
    decontaminate,
    embedding_dedup,
    html_wrapper,
    language_id,
    minhash_dedup,
    prefix_trie,
    sentencepiece_fst,
    token_counts,
    token_shards,
    toxicity,
    vector_codes,
    warc_zip,
)
from .common import new_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_sha256("items").alias("items_sha256"), "contaminated")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), new_path(spark, "shards"))
    read = token_shards.read_slots(spark, manifest)
    return read.select("slot", "doc_id", "seq_no", "n_tokens", "shard", "byte_offset", F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(_read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings, as an event log."""
    forged = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", forged), (-7, 1, "assistant", forged)], "conv_id long, turn long, role string, text string")
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_events.format_chats(chat_events.event_log(chats))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_decontamination,
        op3_token_shards,
        op4_token_counts,
        op5_warc_zip,
        op6_main_text,
        op7_toxicity,
        op8_embedding_dedup,
        op9_language_id,
        op10_minhash_dedup,
        op11_prefix_trie,
        op12_vector_codes,
        op13_chat_formatting,
        pipeline,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of 13 words joined by spaces; every text is matched whole.
OP2_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM wins),
spots AS (SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM docs, sizes, unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m),
found AS (SELECT s.k, s.m, s.i, x.item FROM spots s JOIN wins x USING (m, win)),
hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, m, i FROM found), unnest(range(i, i + m)) AS r(p) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (k) LEFT JOIN named n USING (k)
"""

#: Equal payloads of at least 0 bytes: the smallest page_id is the response.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bytes AS (SELECT *, unhex(sha1(html)) AS d FROM p),
bits AS (SELECT *, list_transform(range(0, 160), lambda i: get_bit(CAST(d AS BIT), CAST(i AS INTEGER))) AS b FROM bytes)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * b[5 * j + 1] + 8 * b[5 * j + 2] + 4 * b[5 * j + 3] + 2 * b[5 * j + 4] + b[5 * j + 5], 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""

#: Bitwise CRC-32 of the digits of c.
_CRC = """(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))))"""
_TURN_SHA = "sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))"

#: A node is the digest of its turns' digests; what lies below it, by way of the paths of nodes' smallest members.
OP11_SQL = f"""
WITH turns AS (SELECT conv_id AS c, {_TURN_SHA} AS t, strlen(coalesce(text, '')) AS n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_SHA}) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, n, c - c % 5 AS donor, {_CRC} % 9 AS h FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)),
rebuilt AS (
  SELECT v.c, t.i AS d, t.t, t.n_bytes FROM convs v JOIN turns t ON t.c = v.donor AND t.i <= v.h
  UNION ALL SELECT v.c, t.i - v.h + least(v.h, coalesce(o.n, 0)), t.t, t.n_bytes FROM convs v JOIN turns t ON t.c = v.c AND t.i > v.h LEFT JOIN convs o ON o.c = v.donor),
keyed AS (SELECT c, d, n_bytes, sha256(string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt),
paths AS (SELECT c, d, n_bytes, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), 'root') AS up FROM keyed UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
nodes AS (SELECT k, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, min(n_bytes) AS n_bytes FROM paths GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
family AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids USING (k) LEFT JOIN nodes p ON p.k = n.up),
below AS (SELECT x.k, sum((y.n_convs - 1) * y.n_bytes) AS saved, sum(CAST(y.n_children = 0 AS BIGINT)) AS leaves FROM family y JOIN paths x ON x.c = y.conv_id AND x.d <= y.depth GROUP BY x.k),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, k, d = max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE last GROUP BY k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM family JOIN below USING (k) LEFT JOIN ends USING (k)
"""


def _op12_sql() -> str:
    """Full search, four times over and a last time."""
    steps = []
    for r in range(5):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT k, p, min(256 * dist + e) AS best FROM (
  SELECT k, p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM parts JOIN book{r} USING (p)) GROUP BY k, p)""")
        if r < 4:
            steps.append(f"""mean{r} AS (SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM (
  SELECT p, CAST(best % 256 AS BIGINT) AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM parts JOIN near{r} USING (k, p), unnest(range(1, len(x) + 1)) AS r(i) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN mean{r} m USING (p, e))""")
    return f"""
WITH kept AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS k FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT k, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, unnest(range(0, 4)) AS r(p)),
book0 AS (SELECT p, k - 1 AS e, x AS y FROM parts WHERE k <= 256),
{", ".join(steps)},
coded AS (SELECT k, string_agg(lower(lpad(to_hex(CAST(best % 256 AS BIGINT)), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near4 GROUP BY k),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4),
labelled AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM kept JOIN coded USING (k))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM labelled, digest
"""


def _escaped(text: str) -> str:
    """Length of a text once backslashes are doubled and control strings broken up."""
    controls = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"]
    found = " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in controls)
    return f"(length(replace({text}, '\\', '\\\\')) + {found})"


OP13_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, substr({_TURN_SHA}, 1, 16) AS tie, CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 12 WHEN 'system' THEN 18 ELSE 22 + {_escaped("role")} END + {_escaped("text")} AS n FROM turns),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op5_warc_zip": OP5_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_vector_codes": _op12_sql(),
    "op13_chat_formatting": OP13_SQL,
}
