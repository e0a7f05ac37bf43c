from sheafline import hooks, schema
from sheafline.operators import answer, extract, library, search


def test_answer_loop(spark):
    rows = [("d", f"c{i}", i, t, 1, "Notes") for i, t in enumerate(["solar power", "wind power", "tidal"])]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, text string, page int, section_path string")
    seen = []

    def model(question, context):
        seen.append(context)
        return {"search": "solar"} if len(seen) == 1 else {"search": "wind"} if len(seen) == 2 else {"answer": "Sun [1], wind [2] , myth [7]."}

    got = answer.answer(chunks, "what gives power", model)
    assert (got["answer"], got["cited"], got["invalid"]) == ("Sun [1], wind [2], myth.", [1, 2], [7])
    assert [p["chunk_id"] for p in got["passages"]] == ["c0", "c1"] and "[2] (Notes, p. 1)\nwind power" in seen[2]
    endless = answer.answer(chunks, "q", lambda q, c: {"search": "solar"}, iterations=1)
    assert endless["answer"] == "" and len(endless["passages"]) == 1


def test_default_embedding(spark):
    df = hooks.embedded(spark.createDataFrame([(1, "solar power plant"), (2, "solar power"), (3, "tea"), (4, None), (5, " ")], "id int, text string"), dim=128)
    got = {r["id"]: r["embedding"] for r in df.collect()}
    assert all(len(v) == 128 for v in got.values()) and not any(got[4]) and not any(got[5])
    best = df.where("id < 4").withColumn("score", search.cosine(df["embedding"], hooks.query_vector("solar power", 128))).orderBy("score", ascending=False).first()
    assert best["id"] == 2 and abs(best["score"] - 1) < 1e-3


def test_texts_without_a_word_have_no_vector(spark):
    df = hooks.embedded(spark.createDataFrame([(1, "..."), (2, "\u2022"), (3, " \u2014\n"), (4, "_"), (5, "\u00b2")], "id int, text string"), dim=64)
    assert {r["id"]: any(r["embedding"]) for r in df.collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert hooks.query_vector_or_reason("...") == (None, "empty vector")


def test_extractor_output(spark):
    t = spark.createDataFrame([("d", 1, "| a |", 1), ("d", 1, "| a |", 2), ("d", 2, "| a |", 3), ("d", 2, None, 4)], "doc_id string, page int, markdown string, ord int")
    assert sorted(r["ord"] for r in extract.distinct_tables(t, ["ord"]).collect()) == [1, 3, 4]
    p = spark.createDataFrame([("d", 1, [0, 0, 5, 5], 1), ("d", 1, [0, 0, 5, 5], 2), ("d", 1, [3, 3, 3, 9], 3), ("d", 1, None, 4)], "doc_id string, page int, bounding_box array<int>, ord int")
    assert [r["ord"] for r in extract.distinct_pictures(p, ["ord"]).collect()] == [1]
    w = spark.createDataFrame([("a", 87.0), (" ", 0.5), ("b", -1.0), ("c", None)], "text string, confidence double")
    assert sorted((r["text"], r["confidence"]) for r in extract.clean_words(w).collect()) == [("a", 0.87), ("c", 0.0)]
    row = spark.range(1).select(extract.frame_rate(__import__("pyspark").sql.functions.lit("30000/1001")).alias("r")).first()
    assert round(row["r"], 3) == 29.97


def test_endpoints_and_schema(spark):
    df = spark.createDataFrame([("https://host/x",), ("http://h:8080",), (None,)], "u string").select("u", library.endpoint(__import__("pyspark").sql.functions.col("u")).alias("e"))
    got = {r["u"]: tuple(r["e"]) for r in df.collect()}
    assert got == {"https://host/x": ("host", 443, True), "http://h:8080": ("h", 8080, False), None: ("localhost", 80, False)}
    assert '"schema_version"' in schema.exported()
