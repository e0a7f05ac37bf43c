"""Nulls, empty tables, repeated rows, very long texts and clashing columns, for every operator."""

import pytest

from sheafline.llm import conversations, emails, knn, leaks, lookalike, mixture, neardup, ocr, transcripts

CHUNKS = "chunk_id string, doc_id string, chunk_index int, text string, page int"
VECTORS = "draft_id long, doc_id string, modal_features struct<vector: struct<dim int, model string, chunk_index int, embedding array<float>>, text: struct<token_count int, chunk_strategy string>>"
MESSAGES = "id long, conversation_id long, sender_email string, role string, content string, created_at double"
DRAFTS = "draft_id long, doc_id string, text string, modal_features struct<audio_segment: struct<start_s double, end_s double, speaker string>>"
MAILS = "mail_id long, text string"
WORDS = "word_id long, doc_id string, page int, text string, confidence double, x1 int, y1 int, x2 int, y2 int, page_height int"
KNOWN = "word string"
DOCS = "doc_id long, text string, source string"
ITEMS = "item_id long, text string"
TARGETS = "source string, target_share double, max_repeats int"

LONG = " ".join(f"word{i % 997} again{i % 89}" for i in range(60_000))


def run(spark, name, rows, extra=None):
    """The operator's rows over the given rows, as a sorted list."""

    def table(schema, data, clash=True):
        df = spark.createDataFrame(data, schema)
        if clash:  # columns that operators use inside
            for c in ("position", "list", "home", "key", "class", "_n", "_run", "kind", "label", "rep", "side"):
                if c not in df.columns:
                    from pyspark.sql import functions as F

                    df = df.withColumn(c, F.lit("x"))
        return df

    out = {
        "p1": lambda: neardup.found(table(CHUNKS, rows)),
        "p2": lambda: knn.found(table(VECTORS, rows)),
        "p3": lambda: conversations.found(table(MESSAGES, rows)),
        "p4": lambda: transcripts.found(table(DRAFTS, rows)),
        "p6": lambda: emails.found(table(MAILS, rows)),
        "p7": lambda: ocr.found(table(WORDS, rows), table(KNOWN, extra or [])),
        "p8": lambda: leaks.found(table(DOCS, rows), table(ITEMS, extra or [])),
        "p9": lambda: mixture.mixture(table(DOCS, rows), table(TARGETS, extra or [])),
        "p10": lambda: lookalike.found(table(DOCS, rows)),
    }[name]()
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("name", ["p1", "p2", "p3", "p4", "p6", "p7", "p8", "p9", "p10"])
def test_empty_tables(spark, name):
    assert run(spark, name, []) == []


NULLS = {
    "p1": [(None, None, None, None, None), ("c1", None, None, None, None), ("c2", "d", 1, "", 1), ("c3", "d", 2, " \n ", 1)],
    "p2": [(None, None, None), (1, None, None), (2, "d", (None, None)), (3, "d", ((64, None, None, None), None)), (4, "d", ((64, "m", 1, [None] * 64), None)), (5, "d", ((64, "m", 1, [0.0] * 64), None)), (6, "d", ((64, "m", 1, [float("nan")] * 64), None)), (7, "d", ((64, "m", 1, [1.0] * 63), None))],
    "p3": [(None, None, None, None, None, None), (1, None, None, "user", "hello", 1.0), (2, 5, None, None, None, None)],
    "p4": [(None, None, None, None), (1, None, None, None), (2, "d", "", None), (3, "d", "um, [noise]", ((None, None, None),))],
    "p6": [(None, None), (1, None), (2, ""), (3, " \r\n \n")],
    "p7": [(None,) * 10, (1, "d", 1, None, None, 1, 1, 2, 2, 1000), (2, None, None, "known", None, None, None, None, None, None)],
    "p8": [(None, None, None), (1, None, None), (2, "", ""), (3, "few words only", "s")],
    "p9": [(None, None, None), (1, None, "text"), (2, "", "text"), (3, "some text", None)],
    "p10": [(None, None, None), (1, None, None), (2, "", ""), (3, " ​ ", "s"), (4, " ", "s")],
}


@pytest.mark.parametrize("name", sorted(NULLS))
def test_nulls_and_blanks(spark, name):
    extra = {"p7": [("known",), (None,)], "p8": [(1, None), (2, "")], "p9": [("text", 1.0, None)]}.get(name)
    got = run(spark, name, NULLS[name], extra)
    assert got == ([] if name != "p7" else got)
    assert name != "p7" or all(r[0] in (1, 2) for r in got)


def test_very_long_texts(spark):
    assert run(spark, "p1", [("a", "d", 1, LONG, 1), ("b", "d", 2, LONG + " tail", 1)]) == [("a", "b")]
    assert run(spark, "p8", [(1, "start " + LONG, "s")], [(7, " ".join(LONG.split()[:50_000]))]) == [(1, 7)]
    assert run(spark, "p10", [(1, LONG, "s"), (2, LONG.replace(" ", "\u00a0", 1), "s")]) == [(1, 2)]
    lines = "\n".join("A line of text that someone wrote down here." for _ in range(5000))
    assert len(run(spark, "p6", [(1, lines)])) == 5000
    assert run(spark, "p4", [(1, "d", lines, ((0.0, 1.0, "SPEAKER_01"),))]) == [("d", 1, "SPEAKER_01", 45_000)]
    assert run(spark, "p9", [(1, LONG, "text")], [("text", 1.0, 1)])[0][0] == 1


def test_repeated_rows_count_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    assert run(spark, "p1", [("a", "d", 1, text, 1), ("a", "d", 1, text, 1), ("b", "d", 2, text, 1)]) == [("a", "b")]
    talk = [(1, 9, None, "user", "hi", 1.0), (2, 9, None, "bot", "hello", 2000.0)]
    assert run(spark, "p3", talk + talk) == [(9, 1, 1), (9, 2, 2)]
    mail = [(1, "Hi Bo,\n\nSome words here.\n\nRegards\nAl")]
    assert run(spark, "p6", mail + mail) == [(1, 1), (1, 3)]
    draft = [(1, "d", "S1 - Three plain words", ((0.0, 1.0, None),))]
    assert run(spark, "p4", draft + draft) == [("d", 1, "SPEAKER_01", 3)]
    v = [float(i + 1) for i in range(64)]
    row = (1, "d", ((64, "m", 1, v), None))
    assert run(spark, "p2", [row, row, (2, "d", ((64, "m", 1, [2 * x for x in v]), None))]) == [(1, 2)]
