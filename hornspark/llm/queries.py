"""One query per operator, over the whole table it is meant for, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secrets, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without the secrets themselves."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), F.round("score", 6).alias("score"), "is_secret")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = quality_rules.judged(docs, carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *(F.col("__hs_" + c).alias(c) for c in names), F.round("__hs_quality", 6).alias("quality"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, reached through the index: each URL is looked up, and what has that very URL is read."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    captures = archive.lookup(pages.select("url").distinct()).where(F.col("url").eqNullSafe(F.col("query")))
    return archive.records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, n_lines_col="n_lines", n_dropped_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, coalesce(max(k.k), 0) AS n_links
FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) k ON k.a = d.doc_id
GROUP BY d.doc_id
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS lo FROM p WHERE octet_length(b) >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.lo IS NULL OR f.lo = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.lo <> p.page_id THEN f.lo END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
c AS (SELECT k, min(doc_id) AS lo FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.k IS NOT NULL AND l.doc_id > c.lo) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.k IS NULL OR l.doc_id = c.lo), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k
GROUP BY l.doc_id
""",
}
