"""Whole documents: nodes put together into one nested record each, for sinks that keep a file per document.

A document is one row of the result by definition, so its nodes are gathered, section
by section first; everything else works on flat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import ids
from sheafline.operators.structure import section_runs
from sheafline.schema import VERSION

#: What a sink gets where a document couldn't be rendered.
PLACEHOLDER = "# Untitled document\n\n_No content._\n"


def nested(chunks: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """doc_id and payload: every document as JSON, sections and bare chunks in order below its root.

    ``extra`` are further columns for the chunk nodes. ``operators.shred`` reads the
    payloads back into the same nodes. Documents without chunks have no row.
    """
    runs = section_runs(chunks)
    node = F.struct(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), "text", "page", F.col("bounding_box"), *(extra or []))
    parts = runs.groupBy("doc_id", "child_no", "section_id").agg(
        F.max("section_path").alias("title"), F.min("page").alias("page"), F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", node.alias("node")))).alias("kids")
    )
    kids = F.transform("kids", lambda k: k["node"])
    section = F.struct(F.col("section_id").alias("id"), F.lit("section").alias("type"), "title", "page", kids.alias("children"))
    # bare chunks and sections are of two types, so each is written on its own and the list is joined as text
    one = F.when(F.col("section_id").isNotNull(), F.to_json(section)).otherwise(F.to_json(kids[0]))
    docs = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("child_no", one.alias("json")))).alias("nodes"))
    root = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.col("doc_id").alias("id"), F.struct(F.struct(F.col("doc_id").alias("id"), F.lit("document").alias("type")).alias("root")).alias("structure")))
    # the root's object ends the text, so its children go before the closing braces
    opened = F.regexp_replace(root, r"\}\}\}$", "")
    return docs.select("doc_id", F.concat(opened, F.lit(',"children":['), F.array_join(F.col("nodes.json"), ","), F.lit("]}}}")).alias("payload"))


def media_nodes(chunks: DataFrame, title: str = "Transcription") -> DataFrame:
    """Chunk nodes of recordings: doc_id, node_id, parent_id, chunk_no, preceding_chunk_id, following_chunk_id, text.

    chunks: doc_id, chunk_no, text. All stand below one figure node named ``title``.
    """
    own = ids.node_id("chunk", F.concat_ws("|", "doc_id", F.col("chunk_no").cast("string"), F.substring(F.coalesce("text", F.lit("")), 1, 64)))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")  # some hundred bytes a chunk of one recording
    rows = chunks.select("doc_id", "chunk_no", "text", own.alias("node_id"))
    return rows.select(
        "doc_id", "node_id", ids.node_id("figure", F.concat_ws("|", "doc_id", F.lit(title))).alias("parent_id"), "chunk_no",
        F.lag("node_id").over(w).alias("preceding_chunk_id"), F.lead("node_id").over(w).alias("following_chunk_id"), "text",
    )


def rendered(documents: DataFrame, markdown: DataFrame) -> DataFrame:
    """doc_id and markdown of every document; those without a rendering get a placeholder."""
    return documents.select("doc_id").distinct().join(markdown, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit(PLACEHOLDER)).alias("markdown"))
