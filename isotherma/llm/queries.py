"""Registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import uuid

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, tune
from . import blob_ledger, decontaminate, importance, line_chunks, mixing, prefix_trie, rarity_digest, slot_table, superminhash, token_files, toxicity, turn_repair, warc_bundles

SHARDS = [f"shard-{k:03d}" for k in range(64)]
MIX_WEIGHTS = [3, 1, 2]
MIX_SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cleaned text."""
    return line_chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=line_chunks.PASSAGE_WORDS)


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    token_files.write_shards(table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, 1.5, 2.0, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_rarity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = rarity_digest.level_counts(docs).collect()  # at most 1024 rows
    return rarity_digest.compare_with_next(docs, rarity_digest.rank_table([(r["level"], r["n"]) for r in counts]))


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS total,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (  -- by the ratio at which a source is clamped; a clamped set is a head of this order
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (1.5::DOUBLE * total - caps) / free AS lev FROM o),
l AS (SELECT arg_min(lev, cap / weight) FILTER (cap >= weight * lev) AS lev FROM v),
p AS (
  SELECT source, source_size, least(cap, coalesce(weight * l.lev, cap)) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, coalesce(weight * l.lev, cap)) / source_size)::BIGINT ELSE 0 END AS whole
  FROM v CROSS JOIN l),
q AS (  -- a place for every row in its source's order
  SELECT d.*, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size + 1e-6)::BIGINT AS part,
         row_number() OVER (PARTITION BY d.source ORDER BY u, size) AS pos
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
w AS (  -- from a place on, what is left of the fraction: up to the next row that is smaller than that but does not fit any more
  SELECT source, max(part) AS room, 0::BIGINT AS pos FROM q GROUP BY source
  UNION ALL
  SELECT source, min(room) - coalesce(max(CASE WHEN cum <= room THEN cum END), 0)::BIGINT, min(CASE WHEN cum > room THEN pos END)
  FROM (SELECT q.source, w.room, q.pos, sum(q.size) OVER (PARTITION BY q.source ORDER BY q.pos ROWS UNBOUNDED PRECEDING) AS cum
        FROM q JOIN w ON q.source IS NOT DISTINCT FROM w.source
        WHERE w.pos IS NOT NULL AND q.pos > w.pos AND q.size > 0 AND q.size <= w.room) x
  GROUP BY source),
n AS (SELECT *, lead(pos) OVER (PARTITION BY source ORDER BY pos NULLS LAST) AS stop, min(room) OVER (PARTITION BY source) AS gap FROM w),
t AS (
  SELECT q.*, n.gap, q.size > 0 AND n.pos IS NOT NULL AND q.size <= n.room AND q.pos < coalesce(n.stop, 9e18) AS walked
  FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source AND (q.pos >= n.pos AND (n.stop IS NULL OR q.pos < n.stop))),
f AS (  -- the smallest row not taken, if it comes nearer
  SELECT *, min(CASE WHEN NOT walked AND size > gap AND size < 2 * gap THEN (size, u, pos) END) OVER (PARTITION BY source) AS best FROM t)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN walked OR coalesce((size, u, pos) = best, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = blob_ledger.findings(docs, new_folder(spark, "ledger"), blob_ledger.BASE + blob_ledger.MORE)
    base = F.filter("spans", lambda s: s["place"] < len(blob_ledger.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in blob_ledger.BASE],
                        F.sha2(blob_ledger.spelled(base).cast("binary"), 256).alias("base_sha256"), blob_ledger.spelled(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, r, '{kind}' AS kind, {place} AS place, unnest(range(1, len(hits) + 1)) AS k, hits, marks, parts, {least} AS least
  FROM (SELECT doc_id, r, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS marks,
               regexp_split_to_array(text, '{pattern}') AS parts FROM d)"""


OP5_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
h AS (""" + "\n  UNION ALL".join(
    _sql_spans(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(blob_ledger.BASE + blob_ledger.MORE)) + """),
m AS (
  SELECT r, kind, place, k, least, length(hits[k]) AS hit, length(marks[k]) AS mark, length(parts[k]) AS gap FROM h),
s AS (
  SELECT r, kind, place, least, mark, hit, (sum(gap + hit) OVER (PARTITION BY r, kind ORDER BY k))::BIGINT AS stop FROM m),
t AS (SELECT r, kind, place, stop - hit AS start, kind || ':' || (stop - hit) || ':' || stop AS said FROM s WHERE mark >= least),
a AS (
  SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(said, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(said, ',' ORDER BY start, place) AS spans
  FROM t GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and which."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "item_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("n_words"), "similarity")


def op7_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_table.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    decision = importance.decide(docs, labels)
    return decision.scores.where(decision.kept())


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superminhash.groups(table(spark, sf_dir, "documents"), superminhash.Rule(3, 85))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc_bundles.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc_bundles.read_bundles(spark, folder)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation with its faults and its cheapest repair."""
    return turn_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


LLM_QUERIES = {q.__name__: q for q in (
    op1_line_chunks, op2_token_files, op3_source_mixing, op4_rarity_digest, op5_secret_scan, op6_decontamination, op7_slot_sharding, op8_importance, op9_superminhash, op10_warc_bundles, op11_toxicity, op12_turn_repair, op13_prefix_trie)} | {"pipeline": corpus_pipeline.run}
LLM_SQL = {"op3_source_mixing": OP3_SQL, "op5_secret_scan": OP5_SQL}
