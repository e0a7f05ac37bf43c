"""Timelines: speakers to segments, frames to chunks, transcript chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

#: Width of the time buckets by which intervals meet, in seconds.
BUCKET = 30.0


def frame_interval(duration: Column) -> Column:
    """Seconds between sampled frames: 5 up to a minute, 10 up to five, else a twentieth but 30 at least."""
    return F.when(duration <= 60, 5.0).when(duration <= 300, 10.0).otherwise(F.greatest(F.lit(30.0), duration / 20))


def frames(recordings: DataFrame) -> DataFrame:
    """doc_id, frame_no, timestamp of the frames sampled from (doc_id, duration); the first is at 0."""
    step = frame_interval(F.col("duration"))
    n = F.floor(F.col("duration") / step).cast("int")
    return recordings.where("duration >= 0").select("doc_id", step.alias("_s"), F.explode(F.sequence(F.lit(0), n)).alias("frame_no")).select("doc_id", "frame_no", F.round(F.col("frame_no") * F.col("_s"), 3).alias("timestamp"))


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end) / width).cast("long"))


def align_speakers(segments: DataFrame, speakers: DataFrame, width: float = BUCKET) -> DataFrame:
    """Each segment's speaker: the one whose turn overlaps it longest, the first turn on ties, else UNKNOWN.

    segments: doc_id, seq, start, end; speakers: doc_id, seq, start, end, speaker.
    Intervals meet by (document, time bucket), so neither side is held against all of
    a recording. Segments with null times keep UNKNOWN.
    """
    s = segments.where("start is not null and `end` is not null").select("doc_id", "seq", F.col("start").alias("a"), F.col("end").alias("b"))
    t = speakers.where("start is not null and `end` is not null").select("doc_id", F.col("seq").alias("turn"), F.col("start").alias("c"), F.col("end").alias("d"), "speaker")
    s = s.withColumn("w", F.explode(_buckets(F.col("a"), F.col("b"), width)))
    t = t.withColumn("w", F.explode(_buckets(F.col("c"), F.col("d"), width)))
    met = s.join(t, ["doc_id", "w"]).where("c < b and d > a")
    overlap = F.least("b", "d") - F.greatest("a", "c")
    best = met.groupBy("doc_id", "seq").agg(F.min_by("speaker", F.struct(-overlap, F.col("turn"))).alias("speaker"), F.max(overlap).alias("overlap"))
    return segments.join(best, ["doc_id", "seq"], "left").select(*segments.columns, F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def frames_in_chunks(chunks: DataFrame, frames_: DataFrame, width: float = BUCKET) -> DataFrame:
    """doc_id, chunk_no, timestamp for every frame within a chunk's closed interval; a frame may be in several."""
    c = chunks.where("start is not null and `end` is not null").select("doc_id", "chunk_no", "start", "end", F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("w"))
    f = frames_.select("doc_id", "timestamp", F.floor(F.col("timestamp") / width).cast("long").alias("w"))
    return c.join(f, ["doc_id", "w"]).where("timestamp between start and `end`").select("doc_id", "chunk_no", "timestamp")


def trailing_frames(chunks: DataFrame, frames_: DataFrame) -> DataFrame:
    """One further chunk per recording with frames after its last chunk's end: doc_id, n_frames, first, last, speaker UNKNOWN."""
    ends = chunks.groupBy("doc_id").agg(F.max("end").alias("stop"))
    late = frames_.join(ends, "doc_id").where(F.col("timestamp") > F.col("stop"))
    return late.groupBy("doc_id").agg(F.count("*").alias("n_frames"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.lit("UNKNOWN").alias("speaker"))


def _numbered(rows: DataFrame, order: list[str], step: Callable[[int, int], tuple[bool, bool]]) -> DataFrame:
    """Adds chunk_no (from 0) in order within doc_id. ``step(held, n)`` tells whether a chunk ends before a row of n tokens, and after it.

    A recording's rows stream through one task in order, a few numbers held at a time;
    such rules are sequential, so a recording can't be cut further.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chunk, held = None, -1, 0
        for pdf in batches:
            out = []
            for d, n in zip(pdf["doc_id"], pdf["n_tokens"].fillna(0).astype(int)):
                if d != doc:
                    doc, chunk, held = d, 0, 0
                before, after = step(held, n)
                if before:
                    chunk, held = chunk + 1, 0
                out.append(chunk)
                held += n
                if after:
                    chunk, held = chunk + 1, 0
            yield pdf.assign(chunk_no=pd.Series(out, dtype="int32"))

    schema = rows.withColumn("chunk_no", F.lit(0)).schema
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInPandas(run, schema)


def visual_chunks(frames_: DataFrame, most: int = 512) -> DataFrame:
    """Chunks of a recording without speech: doc_id, chunk_no, start, end, n_frames, speaker, text.

    frames: doc_id, timestamp, description, n_tokens. Frames are grouped in order of
    time while they fit ``most`` tokens; one that is over it stands alone.
    """
    grouped = _numbered(frames_, ["timestamp", "description"], lambda held, n: (held > 0 and held + n > most, n > most))
    line = F.struct("timestamp", F.concat(F.lit("[Visual "), T.clock(F.col("timestamp")), F.lit("] "), F.coalesce("description", F.lit(""))).alias("line"))
    each = grouped.groupBy("doc_id", "chunk_no").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("n_frames"), F.sort_array(F.collect_list(line)).alias("lines"))
    return each.select("doc_id", "chunk_no", "start", "end", "n_frames", F.lit("UNKNOWN").alias("speaker"), F.array_join(F.col("lines.line"), "\n\n").alias("text"))


def chunk_texts(bundled: DataFrame) -> DataFrame:
    """doc_id, chunk_no and text of bundled segments: their stripped texts in order, a blank line between; chunks without any are left out."""
    said = bundled.select("doc_id", "chunk_no", "seq", T.strip(F.col("text")).alias("text")).where("text <> ''")
    parts = said.groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return parts.select("doc_id", "chunk_no", F.array_join(F.col("parts.text"), "\n\n").alias("text"))


def transcript_chunks(segments: DataFrame, target: int = 384, most: int = 512) -> DataFrame:
    """Adds chunk_no (from 0): consecutive segments bundled up to ``target``, never over ``most`` tokens but for a segment that is alone over it.

    segments: doc_id, seq, start, end, n_tokens and others.
    """

    def step(held: int, n: int) -> tuple[bool, bool]:
        before = held > 0 and held + n > most
        return before, (0 if before else held) + n >= target

    return _numbered(segments, ["seq"], step)


def with_overlap(bundled: DataFrame, most: int = 512) -> DataFrame:
    """The bundled segments, and each chunk's last segment in the next chunk too if both have ``most`` tokens or fewer."""
    n = F.coalesce("n_tokens", F.lit(0))
    by = bundled.groupBy("doc_id", "chunk_no").agg(F.sum(n).alias("_held"), F.max_by(F.struct(*bundled.columns), "seq").alias("_tail"))
    tails = by.select("doc_id", (F.col("chunk_no") + 1).alias("chunk_no"), "_tail")
    fit = by.select("doc_id", "chunk_no", "_held").join(tails, ["doc_id", "chunk_no"]).where(F.col("_held") + F.coalesce("_tail.n_tokens", F.lit(0)) <= most)
    return bundled.unionByName(fit.select(*[F.col(c) if c == "chunk_no" else F.col("_tail")[c].alias(c) for c in bundled.columns]))


def chunk_summary(bundled: DataFrame) -> DataFrame:
    """doc_id, chunk_no, start, end, n_segments, n_tokens and the dominant speaker (most segments, first seen on ties).

    Counts per speaker come first, so nothing but counts is gathered per chunk.
    """
    by = bundled.groupBy("doc_id", "chunk_no", "speaker").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_tokens").alias("tokens"))
    return by.groupBy("doc_id", "chunk_no").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_segments"), F.sum("tokens").alias("n_tokens"), F.min_by("speaker", F.struct(-F.col("n"), F.col("first"))).alias("speaker")
    )


def speaker_counts(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each recording."""
    return segments.groupBy("doc_id").agg(F.countDistinct("speaker").alias("n_speakers"))
