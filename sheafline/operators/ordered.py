"""Ordered scans per key that don't put a hot key into one task.

A window ordered within a key runs each key in one task. Where a key has more rows
than ``hot_rows``, the whole frame is sorted by range of (keys, order) instead: a
range holds part of a hot key or many cold ones, each range is scanned on its own,
and the ranges' totals, a row per key and range, are scanned in turn and added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import stored

HOT_ROWS = 500_000


def in_runs(df: DataFrame, keys: list[str], order: list[str], runs: int) -> DataFrame:
    """The frame sorted by range of (keys, order) into ``runs`` ranges, whose number is ``_run``.

    Ranges are cut by the whole order, so rows equal in its first columns can be parted.
    The frame is written, as another run of the plan would sample other ranges.
    """
    return stored(df.repartitionByRange(runs, *keys, *order).withColumn("_run", F.spark_partition_id()))


def with_run(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add ``_run``, which grows with ``order`` within a key and splits keys of over ``hot_rows`` rows.

    Returns the frame and whether any key is hot. ``counted`` may name a frame that is
    cheaper to count and has no fewer rows of any key.
    """
    count = (df if counted is None else counted).groupBy(*keys).count()
    seen = count.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (seen["most"] or 0) <= hot_rows:
        return df.withColumn("_run", F.lit(0)), False
    spark = df.sparkSession
    return in_runs(df, keys, order, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * seen["all"] / hot_rows))), True


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Running values per key in the given order (nulls first, ascending).

    sums: running total, this row included. lasts: the last non-null value, this
    row included. prevs and nexts: the value of the row before and after (null at the
    first and last row); they must not be null for a row that exists, so wrap them in a struct.
    Give a total order: among rows equal in ``order`` the result is any of theirs.
    An empty frame gives an empty frame with the added columns.
    """
    sums, lasts, prevs, nexts = sums or {}, lasts or {}, prevs or {}, nexts or {}
    df, hot = with_run(df, keys, order, hot_rows, counted)
    w = Window.partitionBy(*keys, "_run").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select(
        "*",
        *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()],
        *[F.lag(c).over(w).alias(n) for n, c in prevs.items()],
        *[F.lead(c).over(w).alias(n) for n, c in nexts.items()],
        *[c.alias(f"_v_{n}") for n, c in {**sums, **lasts, **prevs, **nexts}.items()] if hot else [],
    )
    if not hot:
        return df.drop("_run")
    stamp = F.struct(*order)
    totals = df.groupBy(*keys, "_run").agg(
        *[F.sum(f"_v_{n}").alias(n) for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), stamp)).alias(n) for n in lasts],
        *[F.max_by(f"_v_{n}", stamp).alias(n) for n in prevs],
        *[F.min_by(f"_v_{n}", stamp).alias(n) for n in nexts],
    )
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy("_run")
    carry = totals.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_run").alias("_c_run"),
        *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in {**lasts, **prevs}],
        *[F.lead(n).over(behind).alias(f"_c_{n}") for n in nexts],
    )
    on = F.col("_run") == F.col("_c_run")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    out = df.join(carry, on, "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in {**lasts, **prevs, **nexts}:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_c_{n}")))
    return out.drop("_run", *[c for c in out.columns if c.startswith(("_v_", "_c_"))])
