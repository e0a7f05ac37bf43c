"""What follows a layout, OCR or document model: labels, tables, pictures, scans, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

# Labels of extractors and the region labels that they become; others are paragraphs.
LABELS = {
    "title": "heading", "section_header": "heading", "heading": "heading", "subtitle": "heading", "table": "table", "list_item": "list", "list": "list", "picture": "figure", "figure": "figure",
    "caption": "caption", "page_header": "header", "header": "header", "page_footer": "footer", "footer": "footer", "formula": "paragraph", "equation": "paragraph", "code": "paragraph", "text": "paragraph",
}
SCANNED_CHARS = 50


def region_label(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(T.strip(label))), F.lit("paragraph"))


def first_of_each(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_tables(tables: DataFrame, order: list[str]) -> DataFrame:
    """Tables once per page and first 120 characters (doc_id, page, markdown)."""
    return first_of_each(tables, [F.col("doc_id"), F.col("page"), F.substring(F.coalesce("markdown", F.lit("")), 1, 120)], order)


def distinct_pictures(pictures: DataFrame, order: list[str]) -> DataFrame:
    """Pictures once per page and box; those without area are dropped."""
    b = F.col("bounding_box")
    sized = pictures.where(F.coalesce((b[2] > b[0]) & (b[3] > b[1]), F.lit(False)))
    return first_of_each(sized, [F.col("doc_id"), F.col("page"), b], order)


def scanned(regions: DataFrame, least: int = SCANNED_CHARS) -> DataFrame:
    """doc_id, n_chars, n_pages, looks_scanned: documents with under ``least`` characters a page go to a second pass with OCR."""
    g = regions.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.countDistinct("page").alias("n_pages"))
    return g.withColumn("looks_scanned", F.col("n_chars") / F.greatest("n_pages", F.lit(1)) < least)


def clean_words(words: DataFrame) -> DataFrame:
    """OCR words with text, confidence within 0..1 (over 1 as percent); blank words and negative confidences are dropped."""
    c = F.coalesce("confidence", F.lit(0.0))
    c = F.when(c > 1, c / 100).otherwise(c)
    return words.where((T.strip(F.col("text")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= 0)).withColumn("confidence", F.least(F.lit(1.0), c))


def polygon_box(points: Column) -> Column:
    """The box around an array of (x, y) arrays."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def frame_rate(rate: Column) -> Column:
    """``num/den`` as a number; null where that isn't one."""
    parts = F.split(rate, "/")
    den = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.try_divide(parts[0].try_cast("double"), F.coalesce(den, F.lit(1.0)))


def document_chunks(regions: DataFrame, tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Chunk drafts in the order regions, tables, captions: doc_id, src_rank, ord, region_kind, text. Texts of under 4 characters are noise."""
    parts = [
        regions.select("doc_id", F.lit(0).alias("src_rank"), "ord", F.col("label").alias("region_kind"), "text"),
        tables.select("doc_id", F.lit(1).alias("src_rank"), "ord", F.lit("table").alias("region_kind"), F.col("markdown").alias("text")),
        captions.select("doc_id", F.lit(2).alias("src_rank"), "ord", F.lit("figure").alias("region_kind"), F.col("caption").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length(T.strip(F.col("text"))) >= 4)


def with_page_texts(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """The drafts, and for documents without any, one of all their page texts, in order, a space between.

    pages: doc_id, page, text.
    """
    bare = pages.where("text is not null").join(drafts.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = bare.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("t"))
    text = F.array_join(F.col("t.text"), " ")
    return drafts.unionByName(whole.select("doc_id", F.lit(0).alias("src_rank"), F.lit(0).cast(drafts.schema["ord"].dataType).alias("ord"), F.lit("paragraph").alias("region_kind"), text.alias("text")))
