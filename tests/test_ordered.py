import random

from pyspark.sql import functions as F

from sheafline.operators.ordered import ordered_scan, with_run


def fold(rows):
    out, state = {}, {}
    for k, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, last, prev = state.get(k, (0, None, None))
        total += v or 0
        out[k, at] = (total, v if v is not None else last, prev)
        state[k] = (total, out[k, at][1], v if v is not None else -1)
    return out


def check(spark, rows, hot_rows):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = ordered_scan(df, ["k"], ["at"], sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")}, prevs={"p": F.coalesce("v", F.lit(-1))}, hot_rows=hot_rows)
    assert {(r["k"], r["at"]): (r["s"], r["l"], r["p"]) for r in got.collect()} == fold(rows)


def test_plain_and_hot(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(800)]
    check(spark, rows, 10**6)
    check(spark, rows, 40)


def test_equal_and_null_first_columns_are_cut(spark):
    rows = [("a", None if i % 2 else 7, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, no long")
    scan = lambda hot: ordered_scan(df, ["k"], ["at", "no"], sums={"s": F.lit(1)}, nexts={"n": F.struct("no")}, hot_rows=hot)
    want = {r["no"]: (r["s"], r["n"]) for r in scan(10**6).collect()}
    assert want == {r["no"]: (r["s"], r["n"]) for r in scan(50).collect()}
    runs, hot = with_run(df, ["k"], ["at", "no"], 50)
    assert hot and runs.groupBy("_run").count().agg(F.max("count")).first()[0] < 150


def test_empty(spark):
    assert ordered_scan(spark.createDataFrame([], "k string, at long"), ["k"], ["at"], sums={"s": F.lit(1)}).collect() == []
