"""The given tables as the operators take them, each key once, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.session import read

CHUNKS = ["chunk_id", "doc_id", "chunk_index", "text", "page", "token_count", "bounding_box", "confidence", "region_kind", "section_path"]


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "chunks").select(*CHUNKS).dropDuplicates(["chunk_id"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts with a vector of 64 finite numbers that isn't all zero."""
    v = F.col("modal_features.vector.embedding")
    fit = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return read(spark, folder, "vector_drafts").where(F.coalesce(fit, F.lit(False))).select("draft_id", "doc_id", "page", "confidence", v.alias("embedding")).dropDuplicates(["draft_id"])


def words(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "ocr_words").dropDuplicates(["word_id"])


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "ocr_regions").dropDuplicates(["region_id"])


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversation_messages").dropDuplicates(["id"])


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript drafts as timed segments: doc_id, seq, start, end, speaker, n_tokens, text."""
    a = F.col("modal_features.audio_segment")
    return read(spark, folder, "transcript_drafts").dropDuplicates(["draft_id"]).select("doc_id", F.col("draft_id").alias("seq"), a["start_s"].alias("start"), a["end_s"].alias("end"), F.coalesce(a["speaker"], F.lit("UNKNOWN")).alias("speaker"), F.col("token_count").alias("n_tokens"), "text")


CHUNKS_SQL = "c as (select distinct on (chunk_id) * exclude (ingested_at) from chunks)"
VECTORS_SQL = """v as (select distinct on (draft_id) draft_id, doc_id, page, confidence, modal_features.vector.embedding as embedding from vector_drafts
  where len(modal_features.vector.embedding) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x is not null and isfinite(x))) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x <> 0)) > 0)"""
WORDS_SQL = "w as (select distinct on (word_id) * from ocr_words)"
REGIONS_SQL = "r as (select distinct on (region_id) * from ocr_regions)"
MESSAGES_SQL = "m as (select distinct on (id) * from conversation_messages)"
SEGMENTS_SQL = """s as (select distinct on (draft_id) doc_id, draft_id as seq, modal_features.audio_segment.start_s as start, modal_features.audio_segment.end_s as stop,
  coalesce(modal_features.audio_segment.speaker, 'UNKNOWN') as speaker, token_count as n_tokens, text from transcript_drafts)"""
