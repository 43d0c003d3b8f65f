"""Registered queries of the package and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark.llm import (
    chat, idfile, jaccard, lines, mixing, near_vectors, packing, pitman_yor, quality, repair,
    search, topk, warc,
)
from adspark.llm._common import settled, stored
from adspark.llm.files import as_uri
from adspark.sources.scratch import new_scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that are within two edits of an earlier one."""
    return settled(spark, lambda: lines.dedup_lines(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "kept_in",
        F.length("text").cast("bigint").alias("n_chars_left"), F.md5("text").alias("text_md5")),
        "op1")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    return pitman_yor.score_texts(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the fixed rules and the likelihood ratio."""
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized, written as token-id files and read back."""
    folder = as_uri(new_scratch_path(spark, "ids"))
    path = public_tokenizers.path("word_bpe_49k.json")
    idfile.write_id_files(_read(spark, sf_dir, "documents"), folder, path, end_id=2)
    return idfile.read_id_files(spark, folder).select(
        "doc_id", "start", "n_tokens", "ids").mapInArrow(
        idfile.crc_of_ids, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at source weights 5, 2, 1 in turn, three epochs at most."""
    return mixing.mix(_read(spark, sf_dir, "documents"), (5.0, 2.0, 1.0)).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, written and read back."""
    odd = "\\### Assistant: </turn> ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    out = stored(chat.format_conversations(rows.unionByName(more)), "chat")
    turns = chat.read_turns(F.col("formatted"))
    learnt = F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]),
        lambda s: chat.unescaped(s["text"], chat.Template())), "")
    told = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumns({"turns": turns, "learnt": learnt}).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "accepted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return settled(spark, lambda: packing.packed_pieces(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2), "op8")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, then read from the archives."""
    folder = as_uri(new_scratch_path(spark, "warc"))
    written = warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    empty = spark.createDataFrame([], warc.READ_SCHEMA)
    records = warc.read_archives(spark, folder) if written.head(1) else empty
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type",
                          "refers_to")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by Jaccard similarity 0.9 of 3-word shingles."""
    return settled(spark, lambda: jaccard.jaccard_components(
        _read(spark, sf_dir, "documents"), 3, 9, 10), "op10")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return settled(spark, lambda: search.ranked(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10), "op11")


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, those of the same label linked from cosine 0.98."""
    return settled(spark, lambda: near_vectors.near_vectors(
        _read(spark, sf_dir, "embeddings"), 0.98), "op12")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum, then repaired."""
    return settled(spark, lambda: _repaired(_read(spark, sf_dir, "conversations")), "op13")


def _repaired(rows: DataFrame) -> DataFrame:
    broken = repair.damaged(rows)
    plan = stored(repair.plan_repairs(broken), "repair-plan")
    hashed = stored(repair.digests(repair.repaired_rows(broken, plan)), "repair-digests")
    out = rows.select("conv_id").distinct()
    for side in (plan, hashed):
        side = side.withColumnRenamed("conv_id", "_id")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill(
        {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


QUERIES = {
    "op1_lines": op1_lines,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_quality": op3_quality,
    "op4_token_ids": op4_token_ids,
    "op5_mix": op5_mix,
    "op6_chat": op6_chat,
    "op7_topk": op7_topk,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_jaccard": op10_jaccard,
    "op11_search": op11_search,
    "op12_near_vectors": op12_near_vectors,
    "op13_repair": op13_repair,
}

ORACLE = {
    "op5_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('17:' || coalesce(cast(doc_id AS varchar), '')) AS k,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size
  FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS w
  FROM d GROUP BY source),
r AS (SELECT *, sum(3.0::double * source_size) OVER o - 3.0::double * source_size AS used,
    sum(w) OVER () - sum(w) OVER o + w AS left_w, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 3.0::double * source_size / w, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lv AS (SELECT arg_min((total - used) / left_w, 3.0::double * source_size / w) FILTER (
    3.0::double * source_size / w >= (total - used) / left_w - 1e-9) AS level FROM r),
t AS (SELECT s.*, least(3.0::double * source_size, w * level) AS target FROM s, lv),
e AS (SELECT *, cast(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END
    AS bigint) AS whole FROM t),
f AS (SELECT d.*, e.source_size, e.target, e.whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  cast(size * (whole + CASE WHEN 2 * upto - size < 2 * (target - whole * source_size)
    THEN 1 ELSE 0 END) AS bigint) AS taken
FROM f""",
    "op6_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
    (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
p AS (SELECT *, lag(role) OVER w AS prev FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
      FILTER (role = 'assistant'), '') AS learnt,
    sum(length(replace(replace(replace(replace(role, '\', '\b'), '###', '\m'), '</turn>', '\c'),
        ':', '\d'))
      + length(replace(replace(replace(text, '\', '\b'), '###', '\m'), '</turn>', '\c'))
      + length('### ' || ': ' || '</turn>') + 1) AS formatted_chars,
    bool_and(coalesce(prev, '') || '>' || role IN ('>system', '>user', 'system>user',
      'user>assistant', 'assistant>user'))
      AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS accepted
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars,
  sha256(learnt) AS loss_sha256, cast(formatted_chars AS bigint) AS formatted_chars, accepted
FROM g""",
    "op7_topk": r"""
WITH v AS (SELECT row_number() OVER () AS no, vec_id,
    [floor(256 * x::double) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.no, a.vec_id AS query_id, b.vec_id,
    cast(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.no <> b.no AND len(a.v) = len(b.v)),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS integer)
    AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, cast(octet_length(encode(h)) AS bigint) AS payload_bytes,
    sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
    count(*) OVER (PARTITION BY payload_digest) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> first THEN 'revisit'
    ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> first THEN first END AS refers_to
FROM m""",
    "op11_search": r"""
WITH a AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT no, item_id, unnest(list_distinct(ts)) AS term FROM (
    SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)),
g AS (SELECT count(*) AS n_docs, sum(len(ts))::bigint AS n_terms FROM a WHERE len(ts) > 0),
p AS (SELECT no, doc_id, len(ts) AS n, term, count(*) AS tf
  FROM (SELECT no, doc_id, ts, unnest(ts) AS term FROM a) GROUP BY ALL),
w AS (SELECT term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double
    / (2 * count(*) + 1)::double)) AS bigint) AS w
  FROM p, g WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.no, q.item_id, p.no AS d, p.doc_id, cast(sum(w * ((1000000000 * tf)
    // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS bigint) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST)
    AS integer) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_near_vectors": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS no, vec_id, label, embedding::double[] AS e
  FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len([1 FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.no AS a, b.no AS b, b.vec_id FROM u a JOIN u b ON a.label = b.label
    AND a.no <> b.no AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT no AS a, no AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON r.b = v.no GROUP BY r.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, cast(coalesce(n.n, 0) AS bigint) AS n_links, c.component_id,
  v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c ON v.no = c.a LEFT JOIN n ON v.no = n.a""",
}
