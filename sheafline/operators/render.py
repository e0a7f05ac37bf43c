"""Documents as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.search import query_keywords
from sheafline.operators.structure import section_runs

TOC_ENTRIES = 50


def eyebrow(metadata: DataFrame) -> DataFrame:
    """doc_id and eyebrow, the line of what is known of a document: author, pages, domain and language, as far as ``metadata`` has them.

    A document comes once; null, blank and zero values are left out, and so is an empty line.
    """

    def part(name: str, column: str) -> Column:
        if column not in metadata.columns:
            return F.lit(None).cast("string")
        value = F.when(F.col(column) > 0, F.col(column)).cast("string") if column == "page_count" else T.none_if_blank(F.col(column))
        return F.concat(F.lit(f"{name}: "), value)

    line = F.concat_ws(" · ", *[part(n, c) for n, c in (("author", "author"), ("pages", "page_count"), ("domain", "domain"), ("language", "language"))])
    return metadata.select("doc_id", line.alias("eyebrow")).where("eyebrow <> ''").groupBy("doc_id").agg(F.min("eyebrow").alias("eyebrow"))


def banner(intent: str) -> str:
    """The line that says that a rendering is narrowed to an intent."""
    words = query_keywords(intent)
    return f'*Filtered view: matches for intent "{intent.strip() or "(intent)"}"' + (f"; keywords: {', '.join(words)}" if words else "") + ".*\n\n"


def markdown(chunks: DataFrame, matches: DataFrame | None = None, metadata: DataFrame | None = None, intent: str = "") -> DataFrame:
    """doc_id and markdown: title, contents of up to 50 sections, sections with their chunks.

    ``matches`` (doc_id, chunk_id) keeps those chunks and drops sections left empty;
    documents without any stay whole. ``metadata`` adds a line below the title, and
    ``intent`` one that tells of the narrowing.
    Documents without chunks have no row. One document is one row of the result, so
    its text is gathered; the gathering is by section first.
    """
    runs = section_runs(chunks.where(F.col("text").isNotNull()))
    if matches is not None:
        kept = matches.select("doc_id", "chunk_id").distinct()
        whole = runs.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_narrowed", F.lit(False))
        runs = runs.join(kept, ["doc_id", "chunk_id"], "left_semi").withColumn("_narrowed", F.lit(True)).unionByName(whole)
    else:
        runs = runs.withColumn("_narrowed", F.lit(False))
    body = F.rtrim(F.regexp_replace("text", r"(?m)[ \t]+$", ""))
    marker = F.concat(F.lit("<!-- chunk: "), F.col("chunk_id"), F.lit(", page: "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" -->"))
    part = F.concat(marker, F.lit("\n"), body)
    sections = runs.groupBy("doc_id", "child_no", "section_id").agg(F.max(T.none_if_blank(F.col("section_path"))).alias("title"), F.max("_narrowed").alias("narrowed"), F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    block = F.when(F.col("section_id").isNotNull(), F.concat(F.lit("## "), F.coalesce("title", F.lit("(unnamed section)")), F.lit("\n\n"), text)).otherwise(text)
    docs = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("child_no", "title", (F.col("section_id").isNotNull()).alias("is_section"), block.alias("block")))).alias("blocks"), F.max("narrowed").alias("narrowed"))
    named = F.filter("blocks", lambda b: b["is_section"])
    entries = F.transform(F.slice(named, 1, TOC_ENTRIES), lambda b: F.concat(F.lit("- "), F.coalesce(b["title"], F.lit("(unnamed section)"))))
    more = F.when(F.size(named) > TOC_ENTRIES, F.array(F.concat(F.lit("- …("), (F.size(named) - TOC_ENTRIES).cast("string"), F.lit(" more sections)")))).otherwise(F.array().cast("array<string>"))
    toc = F.when(F.size(named) > 0, F.concat(F.lit("**Contents:**\n\n"), F.array_join(F.concat(entries, more), "\n"), F.lit("\n---\n\n"))).otherwise("")
    title = F.coalesce(F.try_element_at(F.transform(named, lambda b: b["title"]), F.lit(1)), F.lit("Untitled document"))
    told = F.when(F.col("narrowed"), F.lit(banner(intent))).otherwise("") if intent else F.lit("")
    if metadata is not None:
        docs = docs.join(eyebrow(metadata), "doc_id", "left")
        told = F.concat(F.coalesce(F.concat(F.lit("*"), F.col("eyebrow"), F.lit("*\n\n")), F.lit("")), told)
    return docs.select("doc_id", F.concat(F.lit("# "), title, F.lit("\n\n"), told, toc, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("markdown"))
