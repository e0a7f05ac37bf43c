"""Incremental counterparts of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sheafline.functions import formats
from sheafline.operators.throttle import step

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files as they arrive, routed like ``sources.files.scan``."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    fmt = formats.format_of_file(F.col("path"), F.col("content"))
    return raw.withColumn("format", fmt).withColumn("route", formats.route_of(F.col("format")))


def table_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def message_rates(messages: DataFrame, at: str = "created_at", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Messages per role and window; rows later than the watermark don't count."""
    stamped = messages.withColumn("at", F.timestamp_seconds(F.col(at)))
    return stamped.withWatermark("at", late).groupBy(F.window("at", window), "role").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "role", "n")


def upsert_stream(changes: DataFrame, target: str, key: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Insert or replace by key into a Parquet table, each batch once.

    The table is partitioned by a hash bucket of the key; a batch rewrites only the
    buckets it touches, under a version of its own, and readers take each bucket's
    latest version (``read_upserted``).
    """

    def apply(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        try:
            old = latest(spark.read.parquet(target).where(F.col("_version") < version)).drop("_version")
            touched = old.join(F.broadcast(new.select("_bucket").distinct()), "_bucket", "left_semi").join(new.select(key), key, "left_anti")
            new = touched.unionByName(new)
        except Exception as e:  # noqa: BLE001 - the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("_version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version", "_bucket").parquet(target)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """Of each bucket the rows of its latest version."""
    top = rows.groupBy("_bucket").agg(F.max("_version").alias("_top"))
    return rows.join(F.broadcast(top), "_bucket").where(F.col("_version") == F.col("_top")).drop("_top")


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    return latest(spark.read.parquet(target)).drop("_version", "_bucket")


def throttle_stream(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """``operators.throttle`` over a stream of (key, event_id, at, failed): key, event_id, refused; state is three numbers per account."""
    import pandas as pd

    kind = attempts.schema[key].dataType.simpleString()

    def fold(k, batches, state):
        now = tuple(state.get) if state.exists else (0, 0.0, 0.0)
        for pdf in batches:
            pdf, out = pdf.sort_values(["at", "event_id"]), []
            for at, failed in zip(pdf["at"], pdf["failed"]):
                now, no = step(now, float(at), bool(failed))
                out.append(no)
            yield pd.DataFrame({key: [k[0]] * len(pdf), "event_id": pdf["event_id"].to_numpy(), "refused": out})
        state.update(now)

    return attempts.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, event_id long, refused boolean", "failures int, began double, until double", "append", "NoTimeout")
