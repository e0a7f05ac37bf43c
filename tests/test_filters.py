from pyspark.sql import functions as F

from sheafline.operators.filters import maybe_among


def test_keys_pass_and_most_others_do_not(spark):
    df = spark.range(20_000).withColumn("word", F.concat(F.lit("k"), "id"))
    keys = df.where("id % 100 = 0").select("word")
    got = {r["id"] for r in maybe_among(df, F.col("word"), keys).collect()}
    assert set(range(0, 20_000, 100)) <= got and len(got) < 260
    few = maybe_among(df, F.col("id"), spark.range(7), bits=3).count()  # a map that fills up lets more pass
    assert 7 <= few <= 20_000
    assert maybe_among(df, F.col("word"), keys.limit(0)).count() == 0
    assert maybe_among(spark.createDataFrame([(None,)], "a string"), F.col("a"), spark.createDataFrame([(None,)], "b string")).count() == 0
