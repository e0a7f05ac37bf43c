"""Deterministic node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("doc", "section", "table", "figure", "list", "chunk", "entity")
#: Fixed value: the URL namespace of name-based UUIDs.
_URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
NODE_ID = r"^(doc|section|table|figure|list|chunk|entity)_[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def node_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the version 5 UUID of ``prefix|part|part...``."""
    if prefix not in PREFIXES:
        raise ValueError(f"unknown prefix {prefix!r}")
    seed = F.concat_ws("|", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_SPACE)), F.encode(seed, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.lit(prefix + "_"),
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant.substr(nibble + 1, F.lit(1)),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def without_prefix(node: Column) -> Column:
    return F.regexp_replace(node, "^[^_]*_", "")


def id_fits(node: Column, kind: Column) -> Column:
    """Whether an id is well formed and its prefix fits the node's type (``document`` has ``doc``)."""
    want = F.when(kind == "document", "doc").otherwise(kind)
    return F.coalesce(node.rlike(NODE_ID) & (F.substring_index(node, "_", 1) == want), F.lit(False))
