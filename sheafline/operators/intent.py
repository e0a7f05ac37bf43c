"""Intent filter: the parts of each document that an intent asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.documents import nested
from sheafline.operators.search import INTENT_THRESHOLD, INTENT_TOP_K, average_words, cosine_top, dynamic_floor, query_keywords
from sheafline.operators.structure import neighbour_links, section_runs


def matches(chunks: DataFrame, intent: str, query_vector: list[float] | None = None, top_k: int = INTENT_TOP_K, threshold: float = INTENT_THRESHOLD) -> DataFrame:
    """doc_id, chunk_id, score, score_kind, selected_by of every selected chunk.

    A document with chunks over its cosine floor goes by vectors: its matches, their
    neighbours, text matches and the children of sections whose title matches are
    selected, and matches alone carry a score. Others go by keywords: text matches
    and children of matching sections, with the lexical score where it is over 0.
    A blank intent selects nothing.
    """
    kws = query_keywords(intent)
    rows = chunks.withColumn("_text", T.contains_any(kws, F.col("text"))).withColumn("_title", T.contains_any(kws, F.col("section_path")))
    rows = rows.join(average_words(chunks), "doc_id").withColumn("_bm25", F.round(T.bm25_lite(kws, F.col("text"), F.col("section_path"), F.col("avg_words")), 4))
    if query_vector is not None and "embedding" in chunks.columns:
        best = dynamic_floor(cosine_top(chunks.select("doc_id", "chunk_id", "embedding"), query_vector, "chunk_id", top_k, "doc_id"), threshold).select("doc_id", "chunk_id", F.round("score", 4).alias("_cos"))
        links = neighbour_links(chunks).join(best, ["doc_id", "chunk_id"], "left_semi")
        near = links.select("doc_id", F.explode(F.array_compact(F.array("preceding_chunk_id", "following_chunk_id"))).alias("chunk_id")).distinct().withColumn("_near", F.lit(True))
        by_vector = best.select("doc_id").distinct().withColumn("_vector", F.lit(True))
        rows = rows.join(best, ["doc_id", "chunk_id"], "left").join(near, ["doc_id", "chunk_id"], "left").join(by_vector, "doc_id", "left")
    else:
        rows = rows.withColumn("_cos", F.lit(None).cast("double")).withColumn("_near", F.lit(None).cast("boolean")).withColumn("_vector", F.lit(None).cast("boolean"))
    chosen = rows.where(F.col("_cos").isNotNull() | F.coalesce("_near", F.lit(False)) | F.col("_text") | F.col("_title"))
    vector = F.coalesce("_vector", F.lit(False))
    score = F.when(vector, F.col("_cos")).otherwise(F.when(F.col("_bm25") > 0, F.col("_bm25")))
    kind = F.when(vector & F.col("_cos").isNotNull(), "cosine").when(vector, "selected").when(F.col("_bm25") > 0, "bm25-lite").otherwise("section-lift")
    by = F.when(F.col("_cos").isNotNull(), "cosine").when(F.col("_text"), "text").when(F.col("_title"), "title").otherwise("neighbour")
    return chosen.select("doc_id", "chunk_id", score.alias("score"), kind.alias("score_kind"), by.alias("selected_by"))


def summary(chunks: DataFrame, intent: str, query_vector: list[float] | None = None) -> DataFrame:
    """One row per document: total_chunks, matched_chunks, best, no_match.

    Without a match the whole document is kept, and that counts as one match.
    """
    got = matches(chunks, intent, query_vector).where("score_kind <> 'selected'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    all_ = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    missing = F.col("n").isNull() & F.lit(bool(query_keywords(intent)))
    return all_.join(got, "doc_id", "left").select("doc_id", "total_chunks", F.when(missing, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("matched_chunks"), "best", missing.alias("no_match"))


def composed(chunks: DataFrame, intent: str, query_vector: list[float] | None = None) -> DataFrame:
    """The filtered tree as rows: doc_id, child_no, section_id, chunk_id, chunk_index, score, score_kind, no_match.

    A section whose title matches is kept whole, of others the selected chunks only;
    sections keep their place. A document without a match is kept whole, and so is
    every document under a blank intent.
    """
    asked = bool(query_keywords(intent))
    got = matches(chunks, intent, query_vector).select("doc_id", "chunk_id", "score", "score_kind")
    some = got.select("doc_id").distinct().withColumn("_some", F.lit(True))
    rows = section_runs(chunks).join(got, ["doc_id", "chunk_id"], "left").join(some, "doc_id", "left")
    whole = F.col("_some").isNull()
    kept = rows.where(whole | F.col("score_kind").isNotNull())
    kind = F.when(whole & F.lit(asked), "no_match_fallback").otherwise(F.col("score_kind"))
    return kept.select("doc_id", "child_no", "section_id", "chunk_id", "chunk_index", "score", kind.alias("score_kind"), (whole & F.lit(asked)).alias("no_match"))


def filtered_documents(chunks: DataFrame, intent: str, query_vector: list[float] | None = None) -> DataFrame:
    """doc_id and payload: every document as JSON with the filtered tree only, its chunks with their scores."""
    kept = composed(chunks, intent, query_vector).select("doc_id", "chunk_id", "score", "score_kind")
    return nested(chunks.join(kept, ["doc_id", "chunk_id"]), [F.col("score"), F.col("score_kind")])


def topics_hit(intent: str, topics: Column) -> Column:
    """The intent's keywords, of three letters or more, that a topic's words hold, or that one of four letters or more begins or ends with."""
    words = F.array_distinct(F.flatten(F.transform(topics, lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9][a-z0-9-]*)"), 1))))
    words = F.filter(words, lambda w: F.length(w) >= 2)
    kws = F.array(*[F.lit(k) for k in query_keywords(intent) if len(k) >= 3]).cast("array<string>")
    return F.filter(kws, lambda k: F.exists(words, lambda w: (w == k) | ((F.length(w) >= 4) & (F.startswith(w, k) | F.endswith(w, k)))))


def scoring(vector: Column, hits: Column) -> Column:
    """How a document was scored, as its summary says it."""
    base = F.when(vector, "cosine").otherwise("keyword")
    return F.when(F.size(hits) > 0, F.concat(base, F.lit("+topic-widen"))).otherwise(base)
