"""One form for texts that look alike but are stored in other characters.

Look-alike letters, full-width and joined forms, blanks and invisible characters
are mapped on the JVM side; composed and combining accents are then equal under
the accent-sensitive ``UNICODE`` collation, by which texts are grouped in SQL.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.filters import maybe_among
from sheafline.session import stored

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = ("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜӀ", "aeopcyxijshdqwlABEKMHOPCTYXIJSGQWI")
GREEK = ("οναιρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaipuABEZHIKMNOPTYX")
#: Hyphens and primes drawn like the plain ones.
SIGNS = ("\u2010\u2011\ufe63", "---")
#: Joined forms and their letters.
JOINED = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
#: Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Blanks within a line.
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Line ends other than a line feed, and controls that show nothing.
_CONTROLS = "[\\x00-\\x08\\x0b-\\x1f\\x7f\u2028\u2029\u0085]"


def letter_table() -> dict[str, str]:
    """Character to character: the fixed pairs, their accented forms by Unicode decomposition, full-width forms by offset."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    base = dict(zip(CYRILLIC[0] + GREEK[0] + SIGNS[0], CYRILLIC[1] + GREEK[1] + SIGNS[1]))
    table.update(base)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in base:
            whole = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
            if len(whole) == 1:
                table[chr(code)] = whole
    for code in range(0x80, 0x3000):  # signs that are the same character to Unicode, such as the Kelvin sign
        whole = unicodedata.normalize("NFC", chr(code))
        if len(whole) == 1 and whole.isascii():
            table.setdefault(chr(code), whole)
    return table


def one_form(text: Column) -> Column:
    """The text with every character as its plain look-alike; accents may still be composed or combining.

    Plain ASCII texts pass unchanged but for tabs and controls. Line ends become line feeds.
    """
    table = letter_table()
    mapped = F.translate(text, "".join(table) + INVISIBLE, "".join(table.values()))
    for joined, letters in JOINED.items():
        mapped = F.replace(mapped, F.lit(joined), F.lit(letters))
    mapped = F.when(text.rlike(r"[^\x00-\x7f]"), mapped).otherwise(text)
    mapped = F.translate(mapped, BLANKS, " " * len(BLANKS))
    odd = mapped.rlike(_CONTROLS)
    clean = F.regexp_replace(F.regexp_replace(mapped, "\r\n?|[\u2028\u2029\u0085]", "\n"), _CONTROLS, "")
    return F.when(odd, clean).otherwise(mapped)


def residue(form: Column) -> Column:
    """A hash of what a text's accents can't change: its ASCII characters without those that carry combining marks.

    Texts that are equal under the collation have equal residues, so only texts that
    share one need be collated.
    """
    return F.xxhash64(F.when(form.rlike(r"[^\x00-\x7f]"), F.regexp_replace(form, r".\p{M}+|[^\x00-\x7f]", "")).otherwise(form))


def classes(documents: DataFrame) -> DataFrame:
    """Classes of two or more documents that look alike and aren't all stored alike.

    doc_id, class_id (the least doc_id among the canonical text's documents),
    variant (a hash of the stored text). The canonical member of a class is the
    one stored most plainly: equal to its mapped text first, then shortest in
    bytes, then least by id. Blank and null texts belong to no class. The grouping
    combines before the shuffle, so a third of all rows in one class is no hot
    task; the join back meets it by splitting.
    """
    docs = documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}]") & F.col("doc_id").isNotNull())
    # texts that are alone in their residue, or have none but copies there, take no further part
    slim = stored(docs.select("doc_id", F.xxhash64("text").alias("stored"), residue(one_form(F.col("text"))).alias("residue")))
    shared = slim.groupBy("residue").agg(F.min("stored").alias("v1"), F.max("stored").alias("v2")).where("v1 <> v2").select("residue")
    needed = stored(slim.join(shared, "residue", "left_semi").select("doc_id").distinct())
    docs = maybe_among(docs, F.col("doc_id"), needed).join(needed, "doc_id", "left_semi").withColumn("mapped", one_form(F.col("text")))
    docs = docs.select("doc_id", "mapped", F.md5(F.col("text").cast("binary")).alias("variant"), F.struct((F.col("mapped") != F.col("text")).alias("changed"), F.octet_length("text").alias("n"), "doc_id").alias("plainness"))
    docs = docs.withColumn("look", F.collate("mapped", "UNICODE")).drop("mapped")
    groups = docs.groupBy("look").agg(F.min("plainness").alias("best"), F.min("variant").alias("v1"), F.max("variant").alias("v2")).where("v1 <> v2")
    return docs.join(groups, "look").select("doc_id", F.col("best.doc_id").alias("class_id"), "variant")


def canonical(documents: DataFrame) -> DataFrame:
    """Every document with its canonical text: doc_id, class_id, canonical_text, changed.

    A document outside the classes is its own class and gets its mapped text; the
    members of a class get the mapped text of the canonical member. Null stays null.
    """
    c = classes(documents)
    docs = documents.select("doc_id", "text")
    tagged = docs.join(c.select("doc_id", "class_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    texts = docs.join(c.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("class_id"), F.col("text").alias("best"))
    form = one_form(F.coalesce("best", "text"))
    return tagged.join(texts, "class_id", "left").select("doc_id", "class_id", form.alias("canonical_text"), F.coalesce(form != F.col("text"), F.lit(False)).alias("changed"))


def found(documents: DataFrame) -> DataFrame:
    """p10_found: pairs of documents that look alike but are stored differently."""
    c = stored(classes(documents))
    # variants of a class meet, not its members: a thousand copies of one variant are one row here
    each = c.select("class_id", "variant").distinct()
    met = each.withColumnRenamed("variant", "va").join(each.withColumnRenamed("variant", "vb"), "class_id").where("va < vb")
    a = c.select(F.col("doc_id").alias("x"), "class_id", F.col("variant").alias("va"))
    b = c.select(F.col("doc_id").alias("y"), "class_id", F.col("variant").alias("vb"))
    pairs = met.join(a, ["class_id", "va"]).join(b, ["class_id", "vb"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
