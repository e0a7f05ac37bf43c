"""Login throttle: a stateful fold over each account's attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.ordered import HOT_ROWS, ordered_scan

FAILURES, WINDOW_S, LOCK_S = 5, 900.0, 900.0


def step(state: tuple[int, float, float], at: float, failed: bool) -> tuple[tuple[int, float, float], bool]:
    """The state (failures, window start, locked until) after one attempt, and whether it was refused."""
    count, began, until = state
    if at < until:
        return state, True
    if not failed:
        return (0, at, 0.0), False
    if count == 0 or at - began > WINDOW_S:
        count, began = 0, at
    count += 1
    return ((0, at, at + LOCK_S) if count >= FAILURES else (count, began, 0.0)), False


def refused(attempts: DataFrame, key: str = "user_id", order: str = "event_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """attempts (key, at in seconds, failed, order) with ``refused``.

    Five failures within 900 s lock an account for 900 s; a window begins at its
    first failure and is dropped when older; success clears it. After a pause longer
    than both, an account's state is as at its first attempt, so its bursts between
    pauses are independent: each streams through one task in time order with three
    numbers as state.
    """
    rows = attempts.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    rows = ordered_scan(rows, [key], ["at", order], prevs={"_before": F.struct("at")}, hot_rows=hot_rows)
    opens = F.coalesce((F.col("at") - F.col("_before.at") > max(WINDOW_S, LOCK_S)).cast("long"), F.lit(0))
    rows = ordered_scan(rows.withColumn("_opens", opens).drop("_before"), [key], ["at", order], sums={"_burst": F.col("_opens")}, hot_rows=hot_rows).drop("_opens")
    schema = attempts.withColumn("refused", F.lit(False)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (0, 0.0, 0.0)
        for pdf in batches:
            out = []
            for k, burst, at, failed in zip(pdf[key], pdf["_burst"], pdf["at"], pdf["failed"]):
                if (k, burst) != now:
                    now, state = (k, burst), (0, 0.0, 0.0)
                state, no = step(state, at, bool(failed))
                out.append(no)
            yield pdf.drop(columns="_burst").assign(refused=out)

    return rows.repartition(key, "_burst").sortWithinPartitions(key, "_burst", "at", order).mapInPandas(run, schema)
