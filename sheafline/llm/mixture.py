"""A mixture of sources with target shares of tokens, by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens of its source up
to and with it, in shuffled order, divided by the source's weight. Read in order
of finish time and cut at a total, the sources have their shares at any cut.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.ordered import ordered_scan
from sheafline.session import materialize

#: Folder of public tokenizer files, and the rank file used.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern that belongs to the rank file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a source, or of all finish times, from which on they are sorted by range into several tasks.
RANGE_ROWS = 50_000
#: Characters from which on a text is encoded in pieces, and where the split pattern always splits.
_PIECE = 20_000
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Targets are sent to all tasks up to this many.
TARGETS = 10_000


def token_counts(texts: DataFrame, column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Add n_tokens, the length of the column in tokens of a public byte-level BPE; null counts 0.

    The tokenizer is read once per worker. Very long texts are encoded in pieces cut
    before a single space between two other characters, where the split pattern
    begins a new part in any text, so no count changes.
    """
    schema = texts.drop(column).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def count(t: str | None) -> int:
            if not t:
                return 0
            n, at = 0, 0
            while len(t) - at > 2 * _PIECE and (seam := _SEAM.search(t, at + _PIECE)):
                n += len(enc.encode_ordinary(t[at : seam.start()]))
                at = seam.start()
            return n + len(enc.encode_ordinary(t[at:] if at else t))

        for pdf in batches:
            pdf["n_tokens"] = [count(t) for t in pdf.pop(column)]
            yield pdf

    return texts.mapInPandas(run, schema)


def plain_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, range_rows: int = RANGE_ROWS, folder: str = TOKENIZERS) -> DataFrame:
    """The documents of the mixture: doc_id, source, epoch (from 1), n_tokens, finish, position.

    Sources are compared without case and outer blanks; documents of null or
    unlisted sources, and those without tokens, take no part, and neither do
    targets whose share isn't over 0 or that have no documents (the others' shares
    are kept in proportion). A source is read at most ``max_repeats`` times, each time
    in another order. The total is the largest at which every source can reach its
    share, or less if ``total`` says so. All finish times are sorted by range and cut
    where ``position``, the tokens up to and with a document, passes the total.
    Documents are told by doc_id; equal ids count as separate documents.
    """
    goal = targets.select(plain_source(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats")).where("target_share > 0 and repeats > 0")
    docs = token_counts(documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where("source is not null and text is not null").select("doc_id", "source", "text"), folder=folder)
    if goal.limit(TARGETS + 1).count() <= TARGETS:
        goal = F.broadcast(goal)
    # doc_id, source and size are all that is kept: tokens are counted once
    sized = materialize(docs.where("n_tokens > 0").join(goal, "source"))
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.first("target_share").alias("share"), F.first("repeats").alias("repeats"), F.max("n_tokens").alias("largest"))
    limit = supply.agg(F.sum("share").alias("all"), F.min(F.col("tokens") * F.col("repeats") / F.col("share")).alias("least"), F.sum("largest").alias("jumps"), F.max("share").alias("top")).first()
    if limit["all"] is None:
        return sized.select("doc_id", "source", F.lit(1).alias("epoch"), "n_tokens", F.lit(0.0).alias("finish"), F.col("n_tokens").alias("position"))
    budget = limit["least"] * limit["all"]
    budget = float(budget if total is None else min(total, budget))
    copies = sized.select("doc_id", "source", "n_tokens", (F.col("target_share") / limit["all"]).alias("weight"), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("epoch"))
    draw = (F.xxhash64(F.lit(seed), "epoch", "doc_id").cast("double") + 2.0**63) / 2.0**64
    copies = copies.withColumn("draw", F.col("epoch") + draw)
    queued = ordered_scan(copies, ["source"], ["draw", "doc_id"], sums={"tokens": F.col("n_tokens")}, hot_rows=range_rows).withColumn("finish", F.col("tokens") / F.col("weight"))
    # by this time the sources that aren't used up have filled the total, even if each has its largest document still open
    rest = 1.0 - limit["top"] / limit["all"]
    horizon = budget + limit["jumps"] / rest if rest > 1e-9 else float("inf")
    queued = queued.where(F.col("finish") <= horizon).select(F.lit(0).alias("all"), "doc_id", "source", "epoch", "n_tokens", "finish")
    ranked = ordered_scan(queued, ["all"], ["finish", "source", "epoch", "doc_id"], sums={"position": F.col("n_tokens")}, hot_rows=range_rows)
    return ranked.where(F.col("position") <= budget).drop("all")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached: source, target_share, actual_share, tokens, documents, max_epoch; one row per target."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("epoch").alias("max_epoch"))
    got = got.withColumn("whole", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    goal = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    return (
        goal.join(got, "source", "left")
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_epoch", F.lit(0)).alias("max_epoch"), "max_repeats")
    )
