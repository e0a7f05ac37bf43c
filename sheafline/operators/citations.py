"""Bracketed citations in replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.text import strip

_MARK = r"(?<![\w\]])\[(\d{1,9})\]"


def cited(reply: Column) -> Column:
    """Numbers cited as [n], in order of first appearance; not those of subscripts such as ``a[0]``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(_MARK), 1), lambda x: x.cast("long")))


def validated(reply: Column, n: Column) -> Column:
    """struct(cleaned, cited, invalid): citations outside 1..n are taken out, and only then spaces are tidied."""
    found = cited(reply)
    bad = F.array_sort(F.filter(found, lambda x: (x < 1) | (x > n)))
    good = F.filter(found, lambda x: (x >= 1) & (x <= n))
    # each invalid number is removed by its own pattern; the marks' number is small
    raw = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(?<![\w\]])(\[\d{1,9}\])"), 1), lambda m: F.array_contains(bad, F.regexp_replace(m, r"\D", "").cast("long"))))
    gone = F.aggregate(raw, F.coalesce(reply, F.lit("")), lambda s, m: F.regexp_replace(s, F.concat(F.lit(r"(?<![\w\]])\Q"), m, F.lit(r"\E")), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(gone, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1")
    return F.struct(F.when(F.size(bad) > 0, strip(tidy)).otherwise(reply).alias("cleaned"), good.alias("cited"), bad.alias("invalid"))


def context_block(passages: Column, start: int = 1) -> Column:
    """Passages (structs of title, page, text) as ``[i] (title, p. N)`` and the text, numbered from ``start``."""
    parts = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + start).cast("string"), F.lit("] ("), p["title"], F.lit(", p. "), p["page"].cast("string"), F.lit(")\n"), p["text"]))
    return F.array_join(parts, "\n\n")
