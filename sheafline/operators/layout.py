"""Lines and regions of a page from detected words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_GAP, REGION_GAP, HEADER, FOOTER, HEADING_WORDS = 12, 24, 80, 80, 6


def word_lines(words: DataFrame) -> DataFrame:
    """Words with line_no (from 0): a new line where the top is 12 or more from that of the word before. Pages are the windows."""
    w = Window.partitionBy("doc_id", "page").orderBy("y1", "x1", "word_id")
    step = F.abs(F.col("y1") - F.lag("y1").over(w))
    marked = words.withColumn("_new", F.coalesce((step >= LINE_GAP).cast("int"), F.lit(0)))
    return marked.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def regions(words: DataFrame) -> DataFrame:
    """Labelled regions: doc_id, page, region_no, label, text, n_words, confidence, x1, y1, x2, y2.

    A region begins 24 or more below the lowest bottom so far. Its text are its words
    by line, then left to right. The first region high on the page is a header, the
    last low one a footer, a short one without end sign a heading.
    """
    lines = word_lines(words)
    per_line = lines.groupBy("doc_id", "page", "line_no").agg(
        F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.max("page_height").alias("page_height"),
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("conf"), F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x1", "word_id", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ").alias("text"),
    )
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    lowest = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = per_line.withColumn("_new", F.coalesce((F.col("y1") - lowest >= REGION_GAP).cast("int"), F.lit(0)))
    marked = marked.withColumn("region_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = marked.groupBy("doc_id", "page", "region_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.sum("n").alias("n_words"), F.sum("conf").alias("conf"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("page_height").alias("page_height"),
    )
    count = F.max("region_no").over(Window.partitionBy("doc_id", "page"))
    label = (
        F.when((F.col("region_no") == 0) & (F.col("y1") < HEADER), "header")
        .when((F.col("region_no") == count) & (F.col("page_height") - F.col("y2") < FOOTER), "footer")
        .when((F.size(F.split("text", r"\s+")) <= HEADING_WORDS) & ~F.col("text").rlike(r"[.!?:;]\s*$"), "heading")
        .otherwise("paragraph")
    )
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / F.col("n_words")))
    return out.select("doc_id", "page", F.col("region_no").cast("long").alias("region_no"), label.alias("label"), "text", "n_words", F.round(mean, 6).alias("confidence"), "x1", "y1", "x2", "y2")
