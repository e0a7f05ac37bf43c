"""Sections, neighbours and islands in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import ids
from sheafline.functions import text as T
from sheafline.operators.ordered import HOT_ROWS, ordered_scan

_NUMBERED = r"^\s*(\d+(?:\.\d+)*)[\.\s]+(\S.{2,})$"


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Place from 1 within the key."""
    return ordered_scan(rows, keys, order, sums={name: F.lit(1).cast("long")}, hot_rows=hot_rows)


def neighbour_links(chunks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, chunk_id, preceding_chunk_id, following_chunk_id in document order."""
    slim, own = chunks.select("doc_id", "chunk_index", "chunk_id"), F.struct("chunk_id")
    p = ordered_scan(slim, ["doc_id"], ["chunk_index", "chunk_id"], prevs={"_before": own}, nexts={"_after": own}, hot_rows=hot_rows)
    return p.select("doc_id", "chunk_id", F.col("_before.chunk_id").alias("preceding_chunk_id"), F.col("_after.chunk_id").alias("following_chunk_id"))


def section_path_of(heading: Column) -> Column:
    """The number of a numbered heading, else its text without a final full stop."""
    number = F.regexp_extract(heading, _NUMBERED, 1)
    return F.when(number != "", number).otherwise(F.regexp_replace(T.strip(heading), r"\.+$", ""))


def carried_sections(regions: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Regions with section_path carried from the last heading, is_first (a heading) and is_last (before one, or the end).

    Regions before the first heading have an empty path.
    """
    heading = F.coalesce(F.col("label") == "heading", F.lit(False))
    rows = regions.withColumn("_heading", heading)
    path = F.when(F.col("_heading"), section_path_of(F.coalesce("text", F.lit(""))))
    rows = ordered_scan(rows, ["doc_id"], order, lasts={"section_path": path}, nexts={"_next": F.struct("_heading")}, hot_rows=hot_rows)
    return rows.select(*regions.columns, F.coalesce("section_path", F.lit("")).alias("section_path"), F.col("_heading").alias("is_first"), F.coalesce("_next._heading", F.lit(True)).alias("is_last"))


def section_runs(chunks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Chunks lifted into sections: each run of equal, non-empty section paths is one section.

    Adds child_no (how many root children were opened up to here, from 0: sections
    and bare chunks) and section_id (null for a bare chunk). An empty path ends a run.
    """
    path = F.coalesce("section_path", F.lit(""))
    rows = ordered_scan(chunks.withColumn("_path", path), ["doc_id"], ["chunk_index", "chunk_id"], prevs={"_before": F.struct("_path")}, hot_rows=hot_rows)
    opens = (F.col("_path") == "") | F.col("_before").isNull() | (F.col("_before._path") != F.col("_path"))
    rows = ordered_scan(rows.withColumn("_open", opens.cast("long")), ["doc_id"], ["chunk_index", "chunk_id"], sums={"_n": F.col("_open")}, hot_rows=hot_rows)
    section = F.when(F.col("_path") != "", ids.node_id("section", F.col("doc_id"), F.col("_n") - 1, F.col("_path")))
    return rows.select(*chunks.columns, (F.col("_n") - 1).alias("child_no"), section.alias("section_id"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """The deterministic id of each chunk: document, place and the first 64 characters."""
    return chunks.withColumn("node_id", ids.node_id("chunk", F.col("doc_id"), F.col("chunk_index"), F.substring(F.coalesce("text", F.lit("")), 1, 64)))


def assembled(chunks: DataFrame, nested: bool = False) -> DataFrame:
    """Document trees as rows: one per section with the number and places of its chunks, one per bare chunk.

    With ``nested`` the chunks themselves are collected into their section, in order,
    for a sink that writes whole documents.
    """
    runs = section_runs(chunks)
    group = runs.groupBy("doc_id", "child_no", "section_id")
    cols = [F.max("section_path").alias("title"), F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.min("page").alias("page")]
    if nested:
        cols.append(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text", "page", "token_count"))).alias("children"))
    return group.agg(*cols)
