"""The registered queries of this subpackage, each over a whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import archive_pages
from .class_lm import score_corpus
from .common import table, tokenizer, written
from .exact_dedup import exact_groups
from .fill_middle import FILL_MIDDLE_SQL, round_trip
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from .license_scan import scan_licenses, scan_sql
from .media import describe_media, encode_media
from .ngram_join import similar_texts
from .packing import pack_documents
from .piecewise import compare_with_next
from .segmentations import decode_segmentations, sample_segmentations
from .toxicity import toxicity
from .url_filter import filter_sql, filter_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op7_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op8_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def decode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text from the ids of its first sampled segmentation.

    The ids are written in between, so that an executor doesn't run the Python of both steps at a time."""
    model = tokenizer("piece_bpe_32k.model")
    samples = sample_segmentations(table(spark, sf_dir, "documents"), model, samples=1, with_ids=True)
    return decode_segmentations(written(samples.select("doc_id", "ids"), "segmentations"), model).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def op9_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(written(encode_media(table(spark, sf_dir, "documents")), "media"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 100 == 0, label=label)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (
  SELECT doc_id, content,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""

OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_page FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to FROM f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_license_scan": op1_license_scan, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op3_exact_dedup": op3_exact_dedup, "op4_best_fit_packing": op4_best_fit_packing, "op5_toxicity": op5_toxicity, "op6_class_lm": op6_class_lm, "op7_warc_from_arc": op7_warc_from_arc, "op8_sampled_segmentations": op8_sampled_segmentations, "op9_media_audio": op9_media_audio, "op10_url_filter": op10_url_filter, "op11_hard_negatives": op11_hard_negatives, "op12_fill_middle": op12_fill_middle, "op13_fingerprints": op13_fingerprints, "decode_segmentations": decode_samples}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": scan_sql(), "op3_exact_dedup": OP3_SQL, "op7_warc_from_arc": OP7_SQL, "op10_url_filter": filter_sql(), "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_fill_middle": FILL_MIDDLE_SQL, "decode_segmentations": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents"}
