"""Passage search: lexical and vector scores, title boost, floors, top-k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

TITLE_BOOST = 0.30
TOP_K = 8
CHAT_TOP_K, CHAT_FLOOR = 6, 0.58
INTENT_TOP_K, INTENT_THRESHOLD = 20, 0.20


def query_keywords(query: str | None) -> list[str]:
    """The keywords of a query text, as ``functions.text.keywords`` finds them."""
    found = re.findall(T.KEYWORD, (query or "").lower())
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and (t in T.TECH_TERMS or t not in T.STOPWORDS)))


def cosine(embedding: Column, query: list[float]) -> Column:
    """Dot product with a query vector, over the shorter length; null without an embedding. Unit vectors are taken for granted."""
    pairs = F.zip_with(F.slice(embedding.cast("array<double>"), 1, len(query)), F.slice(F.array(*[F.lit(float(x)) for x in query]), 1, F.greatest(F.size(embedding), F.lit(1))), lambda a, b: a * b)
    return F.when(F.size(embedding) > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))))


def doc_titles(chunks: DataFrame) -> DataFrame:
    """doc_id and title: the first non-blank section path in order of chunk_index, else ``Untitled document``."""
    path = T.none_if_blank(F.col("section_path"))
    return chunks.groupBy("doc_id").agg(F.min_by(path, F.when(path.isNotNull(), F.struct("chunk_index", "chunk_id"))).alias("t")).select("doc_id", F.coalesce("t", F.lit("Untitled document")).alias("title"))


def average_words(chunks: DataFrame) -> DataFrame:
    """doc_id and avg_words of its chunks."""
    words = F.col("_words") if "_words" in chunks.columns else T.word_count(F.col("text"))
    return chunks.groupBy("doc_id").agg(F.avg(words).alias("avg_words"))


def scored_passages(chunks: DataFrame, query: str, query_vector: list[float] | None = None, min_score: float = 0.0) -> DataFrame:
    """Every passage with a signal: doc_id, doc_title, chunk_id, chunk_index, page, text, score, title_match.

    Content is the cosine where query and chunk both have vectors, else the lexical
    score; a document whose title holds a query keyword adds 0.30. Passages without
    content and title match are dropped, and scores under ``min_score``. A blank
    query gives no rows. Chunks need not be unique; each row is scored.
    """
    tokens = query_keywords(query)
    if not (query or "").strip():
        return chunks.limit(0).select("doc_id", F.lit("").alias("doc_title"), "chunk_id", "chunk_index", "page", "text", F.lit(0.0).alias("score"), F.lit(False).alias("title_match"))
    counted = chunks.withColumn("_words", T.word_count(F.col("text")))
    path = T.none_if_blank(F.col("section_path"))
    per_doc = counted.groupBy("doc_id").agg(F.avg("_words").alias("avg_words"), F.min_by(path, F.when(path.isNotNull(), F.struct("chunk_index", "chunk_id"))).alias("_t"))
    docs = per_doc.select("doc_id", "avg_words", F.coalesce("_t", F.lit("Untitled document")).alias("title")).withColumn("title_match", T.title_matches(tokens, F.col("title")))
    rows = counted.join(docs, "doc_id")
    content = T.bm25_lite(tokens, F.col("text"), F.col("section_path"), F.col("avg_words"), F.col("_words"))
    if query_vector is not None and "embedding" in chunks.columns:
        content = F.coalesce(cosine(F.col("embedding"), query_vector), content)
    if query_vector is None or "embedding" not in chunks.columns:
        # a lexical score is over 0 just where a token occurs; that test is cheap, so the score stands in the plan once
        rows = rows.where(T.contains_any(tokens, F.col("text")) | T.contains_any(tokens, F.col("section_path")) | F.col("title_match"))
        rows = rows.withColumn("content", content)
    else:
        rows = rows.withColumn("content", content).where((F.col("content") != 0) | F.col("title_match"))
    rows = rows.withColumn("raw", F.col("content") + F.when(F.col("title_match"), TITLE_BOOST).otherwise(0.0))
    if min_score > 0:
        rows = rows.where(F.col("raw") >= min_score)
    return rows.select("doc_id", F.col("title").alias("doc_title"), "chunk_id", "chunk_index", "page", "text", F.round("raw", 6).alias("score"), "title_match")


def search(chunks: DataFrame, query: str, query_vector: list[float] | None = None, top_k: int = TOP_K, min_score: float = 0.0) -> DataFrame:
    """The ``top_k`` passages; equal scores go by doc_id, then chunk_index, then chunk_id."""
    return scored_passages(chunks, query, query_vector, min_score).orderBy(F.desc("score"), "doc_id", "chunk_index", "chunk_id").limit(max(0, int(top_k)))


def retrieve(chunks: DataFrame, query: str, query_vector: list[float] | None, top_k: int = CHAT_TOP_K, floor: float = CHAT_FLOOR) -> DataFrame:
    """Passages for an answer: vectors for all or lexical for all, never mixed.

    If any non-blank chunk has a vector of the query's length, the ``top_k`` by
    cosine of ``floor`` or more; else the ``top_k`` of positive lexical score, with one
    average length over all chunks.
    """
    rows = chunks.where(F.coalesce(T.strip(F.col("text")) != "", F.lit(False)))
    if query_vector is not None and "embedding" in chunks.columns:
        fit = rows.where(F.size("embedding") == len(query_vector))
        if not fit.isEmpty():
            scored = fit.withColumn("score", F.round(cosine(F.col("embedding"), query_vector), 4)).where(F.col("score") >= floor)
            return scored.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(top_k).select("doc_id", "chunk_id", "page", "text", "score")
    average = rows.agg(F.avg(T.word_count(F.col("text")))).first()[0] or 1.0
    section = F.col("section_path") if "section_path" in chunks.columns else F.lit("")
    scored = rows.withColumn("score", F.round(T.bm25_lite(query_keywords(query), F.col("text"), section, F.lit(float(average))), 4))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id", "chunk_index").limit(top_k).select("doc_id", "chunk_id", "page", "text", "score")


def dynamic_floor(scored: DataFrame, threshold: float = INTENT_THRESHOLD, per: str = "doc_id") -> DataFrame:
    """Scores that reach their document's floor: its best less 0.15 (0.05 at least) if the best reaches the threshold, else the best (0.05 at least)."""
    best = scored.groupBy(per).agg(F.max("score").alias("_top"))
    floor = F.when(F.col("_top") >= threshold, F.greatest(F.col("_top") - 0.15, F.lit(0.05))).otherwise(F.greatest(F.lit(0.05), F.col("_top")))
    return scored.join(best, per).where(F.col("score") >= floor).drop("_top")


def cosine_top(vectors: DataFrame, query: list[float], key: str = "draft_id", top_k: int = INTENT_TOP_K, per: str | None = None) -> DataFrame:
    """The ``top_k`` by cosine, of all rows or within each ``per``; vectors of another length don't count; ties go by key."""
    fit = vectors.where(F.size("embedding") == len(query)).withColumn("score", cosine(F.col("embedding"), query))
    if per is None:
        return fit.orderBy(F.desc("score"), key).limit(top_k)
    w = Window.partitionBy(per).orderBy(F.desc("score"), key)
    return fit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")


def mean_pool(vectors: DataFrame, per: str = "doc_id", digits: int = 6) -> DataFrame:
    """per, position, value: the element-wise mean of a group's vectors, rounded. Combines before the shuffle."""
    flat = vectors.select(per, F.posexplode(F.col("embedding").cast("array<double>")).alias("position", "value"))
    return flat.groupBy(per, "position").agg((F.round(F.avg("value"), digits) + 0.0).alias("value"))
