"""Entities, their pairs, topics, and the boilerplate filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

#: Confidence by entity label; others 0.60.
CONFIDENCE = {
    "PERSON": 0.92, "ORG": 0.90, "GPE": 0.88, "LOC": 0.85, "FAC": 0.85, "EVENT": 0.80, "WORK_OF_ART": 0.78, "LAW": 0.78, "LANGUAGE": 0.85, "NORP": 0.82,
    "PRODUCT": 0.72, "DATE": 0.70, "TIME": 0.70, "MONEY": 0.78, "PERCENT": 0.78, "QUANTITY": 0.72, "ORDINAL": 0.65, "CARDINAL": 0.65,
}
PAIR_CAP, TOPICS = 20, 5
#: The built-in recogniser, one pattern per label; a model hook may stand in for it.
PATTERNS = {
    "ORG": r"\b([A-Z][a-z]+ (?:Institute|Laboratories|Works|Freight|Archive|Cooperative))\b",
    "DATE": r"\b((?:19|20)[0-9]{2})\b",
    "QUANTITY": r"\b([0-9][0-9,]* (?:hours|pages|copies|metres|tonnes|units|crates|letters|readings|samples|visits|entries))\b",
    "LAW": r"\b([A-Z]{2}-[0-9]{4})\b",
}


def confidence_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit(0.60))


def found_in(text: Column) -> Column:
    """The entities of a text as an array of (text, type), label by label in order; blank texts have none."""

    def of(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda x: F.struct(x.alias("text"), F.lit(label).alias("type")))

    return F.concat(*[of(k, p) for k, p in PATTERNS.items()])


def entities(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, pos, text, type, confidence: what the patterns find in each chunk."""
    rows = chunks.select("doc_id", "chunk_id", F.posexplode(found_in(F.col("text"))).alias("pos", "e"))
    return rows.select("doc_id", "chunk_id", "pos", F.col("e.text").alias("text"), F.col("e.type").alias("type"), confidence_of(F.col("e.type")).alias("confidence"))


def distinct_entities(ents: DataFrame, per: str = "doc_id") -> DataFrame:
    """One entity per (lower text, type) and document: the most confident, then the first by chunk and place. Combines before the shuffle."""
    best = F.min_by(F.struct("text", "confidence", "chunk_id", "pos"), F.struct(-F.col("confidence"), F.col("chunk_id"), F.col("pos")))
    g = ents.groupBy(per, F.lower("text").alias("_t"), "type").agg(best.alias("b"))
    return g.select(per, F.col("b.text").alias("text"), "type", F.col("b.confidence").alias("confidence"), F.col("b.chunk_id").alias("chunk_id"), F.col("b.pos").alias("pos"))


def topics(distinct: DataFrame, per: str = "doc_id", top: int = TOPICS) -> DataFrame:
    """The ``top`` surface forms of a document by how many types they have; ties go to the first seen."""
    g = distinct.groupBy(per, F.lower(T.strip(F.col("text"))).alias("topic")).agg(F.count("*").alias("n_types"), F.min(F.struct("chunk_id", "pos")).alias("seen"))
    w = Window.partitionBy(per).orderBy(F.desc("n_types"), "seen", "topic")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(per, "topic", "n_types", "rank")


def pairs_in(found: Column, cap: int = PAIR_CAP) -> Column:
    """Unordered pairs of different texts of an ordered array of (text, confidence), first seen first, at most ``cap``.

    A pair is first seen at the first places of its texts, so no more than the first
    ``cap`` + 1 different texts can be in it.
    """
    texts = F.slice(F.array_distinct(F.transform(found, lambda e: e["text"])), 1, cap + 1)
    first = F.transform(texts, lambda t: F.element_at(F.filter(found, lambda e: e["text"] == t), 1))

    def with_later(e: Column, i: Column) -> Column:
        mean = lambda o: F.round((e["confidence"] + o["confidence"]) / 2, 3)
        return F.transform(F.slice(first, i + 2, cap), lambda o: F.struct(e["text"].alias("from_text"), o["text"].alias("to_text"), mean(o).alias("confidence")))

    return F.slice(F.flatten(F.transform(first, with_later)), 1, cap)


def _paired(rows: DataFrame) -> DataFrame:
    out = rows.select("doc_id", "chunk_id", F.posexplode("pairs").alias("_i", "p"))
    return out.select("doc_id", "chunk_id", "p.from_text", "p.to_text", "p.confidence", (F.col("_i") + 1).alias("rank"))


def pairs(ents: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """Co-occurring entities of each chunk: doc_id, chunk_id, from_text, to_text, confidence (the mean of both, rounded to 3), rank."""
    each = ents.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "confidence"))).alias("found"))
    return _paired(each.select("doc_id", "chunk_id", pairs_in(F.col("found"), cap).alias("pairs")))


def chunk_pairs(chunks: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """The same straight from the chunks, without a shuffle."""
    found = F.transform(found_in(F.col("text")), lambda e: F.struct(e["text"].alias("text"), confidence_of(e["type"]).alias("confidence")))
    return _paired(chunks.select("doc_id", "chunk_id", found.alias("found")).select("doc_id", "chunk_id", pairs_in(F.col("found"), cap).alias("pairs")))


def without_boilerplate(distinct: DataFrame, relations: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Entities that ``drop`` doesn't hold for, and relations both ends of which are, letter for letter, among them."""
    kept = distinct.where(~drop)
    ends = kept.select("doc_id", "text").distinct()
    a = ends.withColumnRenamed("text", "from_text")
    b = ends.withColumnRenamed("text", "to_text")
    return kept, relations.join(a, ["doc_id", "from_text"], "left_semi").join(b, ["doc_id", "to_text"], "left_semi")
