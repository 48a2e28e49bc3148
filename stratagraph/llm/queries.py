"""One registered query for each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, gif, license, minhash, mixing, pii, quality, suffix
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents without what also starts earlier; null texts are empty, null ids last, rows of one id and text one document (see ``suffix``)."""
    return suffix.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position; null sources are a source, null and repeated ids and rows are kept (see ``mixing``)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.mix(docs)
    return out.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from the output; null roles and texts are empty (see ``chat``)."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(own)))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every text's GIF; null texts are empty, null ids and repeated rows are kept (see ``gif``)."""
    return gif.text_media(read(spark, sf_dir, "documents"), keep_media=False)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and class; null texts are empty, null ids are never kept, repeated rows are rows each (see ``minhash``)."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score; null texts are empty, null ids are scored and never learnt from (see ``quality``)."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text; null texts are empty, null ids and repeated rows are kept, ties of score go to the first (see ``pii``)."""
    return pii.find(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text; null texts are empty, null ids and repeated rows are kept (see ``bpe``)."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op9_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every hundredth vector; unusable vectors and null ids take no part, repeated ids are rows each (see ``ann``)."""
    return ann.search(read(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every text; null texts are empty, null ids and repeated rows are kept (see ``license``)."""
    return license.scan(read(spark, sf_dir, "documents")).drop("blocks")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, md5(array_slice(t, i + 1, i + {suffix.LENGTH})) AS k
  FROM (SELECT doc_id, t, unnest(range(octet_length(t) - {suffix.LENGTH - 1})) AS i FROM d WHERE octet_length(t) >= {suffix.LENGTH})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM again),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {suffix.LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges),
cut AS (SELECT doc_id, k, min(i) AS a, max(i) + {suffix.LENGTH} AS b FROM runs GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY k) AS b, k FROM cut
  UNION ALL SELECT doc_id, 0, min(a), 0 FROM cut GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY k) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM cut GROUP BY doc_id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.HEAD + chat.SAYS + chat.END)} + length(role || text) + length(regexp_replace(role || text, '[^\\\\|]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {minhash.WORDS - 1}) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {minhash.WORDS - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
step AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, step.b FROM reach JOIN step ON step.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _license_sql() -> str:
    rows = ", ".join(f"('{label}', {list(dict.fromkeys(w.decode() for w in license.words_of(text)))}, {len(license.words_of(text))})" for label, text in license.TEMPLATES.items())
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE list_contains(w, '{phrase.split()[0]}')) WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}"
        for phrase, label in license.PHRASES.items()
    )
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH w AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
t(label, words, n) AS (VALUES {rows}),
near AS (SELECT doc_id, w, label, words, n FROM w, t WHERE len(list_intersect(w, words)) >= ceil({license.THRESHOLD} * len(words) - 1e-9)),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
found AS (
  SELECT doc_id, label, max(k / m) AS score FROM (
    SELECT doc_id, label, len(list_intersect(w[i:i + n - 1], words)) AS k, len(words) AS m
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM near) WHERE list_contains(words, w[i]))
  WHERE k >= ceil({license.THRESHOLD} * m - 1e-9) GROUP BY doc_id, label),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  (CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0) END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that it can express; the others are tested against plain versions."""
    return {"op1_suffix_dedup": _REPEATS_SQL, "op3_chat_format": _CHAT_SQL, "op5_minhash_neardup": _NEAR_SQL, "op10_license_scan": _license_sql()}
