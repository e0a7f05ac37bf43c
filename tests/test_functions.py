import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline.functions import boxes, formats, ids
from sheafline.functions import text as T
from sheafline.operators import citations


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_keywords(spark):
    assert one(spark, T.keywords(F.col("t")), t="Show me the 6Li BGE-512 of AI and ai, x for Li6!") == ["6li", "bge-512", "ai", "li6"]
    assert one(spark, T.keywords(F.lit(None).cast("string"))) == []


def test_node_ids(spark):
    seed = "chunk|doc_1|3|Ünïcode text"
    want = "chunk_" + str(uuid.uuid5(uuid.NAMESPACE_URL, seed))
    got = one(spark, ids.node_id("chunk", F.lit("doc_1"), F.lit(3), F.lit("Ünïcode text")))
    assert got == want
    assert one(spark, ids.without_prefix(F.lit(want))) == want[6:]
    assert one(spark, ids.id_fits(F.lit(want), F.lit("chunk"))) and not one(spark, ids.id_fits(F.lit(want), F.lit("section")))
    with pytest.raises(ValueError):
        ids.node_id("page", F.lit("x"))


def test_fences(spark):
    text = "# A\n\npara one\nstill\n\n```py\nx = 1\n\ny = 2\n```\nafter\n\n\nend"
    assert one(spark, T.fenced_paragraphs(F.lit(text))) == ["# A", "para one\nstill", "```py\nx = 1\n\ny = 2\n```", "after", "end"]


def test_small_text_functions(spark):
    assert one(spark, T.strip_html(F.lit("<p>a &amp; b&nbsp;<b>c</b> &lt;</p>"))) == "a & b c <"
    assert one(spark, T.join_split_decimals(F.lit("3 . 14 and 2. 5"))) == "3.14 and 2. 5"
    assert one(spark, T.clock(F.lit(125.7))) == "2:05"
    assert one(spark, T.preview(F.lit("  a \n b  "))) == "a b"
    assert one(spark, T.sentences(F.lit("One. Two! three? (Four). end"))) == ["One.", "Two! three?", "(Four). end"]
    assert one(spark, T.is_boilerplate(F.lit("Copyright (c) 2017 by X"))) and not one(spark, T.is_boilerplate(F.lit("a mountain viewpoint")))
    row = one(spark, T.markdown_table_size(F.lit("| a | b |\n|---|---|\n| 1 | 2 |")))
    assert (row["rows"], row["cols"]) == (2, 2)


def test_boxes(spark):
    scale = boxes.to_canvas(F.lit(10), F.lit(700), F.lit(-5), F.lit(20), F.lit(200), F.lit(500))
    assert one(spark, scale) == [0, 40, 50, 1000]
    assert one(spark, boxes.is_box(F.array(F.lit(0), F.lit(0), F.lit(5), F.lit(5)))) and not one(spark, boxes.is_box(F.array(F.lit(6), F.lit(0), F.lit(5), F.lit(5))))
    assert not one(spark, boxes.is_box(F.lit(None).cast("array<int>")))


def test_formats(spark):
    for name, fmt, route in [("a/b.PDF", "PDF", "PDF"), ("x.doc", "DOC", "SKIP"), ("x.pptx", "PPTX", "PPTX_NATIVE"), ("x.md", "MD", "TEXT"), ("x.heic", "IMAGE", "IMAGE"), ("x.mkv", "VIDEO", "VIDEO"), ("x.unknown", "", "SKIP"), ("noext", "", "SKIP")]:
        assert one(spark, formats.format_of_name(F.lit(name))) == fmt
        assert one(spark, formats.route_of(F.lit(fmt))) == route
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "x")
    assert one(spark, formats.format_of_file(F.lit("x.zip"), F.lit(bytearray(held.getvalue())))) == "DOCX"
    # a container that can't be read goes by its extension, whatever its bytes hold
    assert one(spark, formats.format_of_file(F.lit("x.zip"), F.lit(bytearray(b"PK\x03\x04....word/document.xml")))) == ""
    assert one(spark, formats.format_of_file(F.lit("x.txt"), F.lit(bytearray(b"%PDF-1.7")))) == "PDF"
    assert "doc" not in formats.convertible() and "pdf" in formats.convertible()


def test_citations(spark):
    v = one(spark, citations.validated(F.lit("As said [1], and [9] , arr[0] too [2]."), F.lit(2)))
    assert (v["cleaned"], v["cited"], v["invalid"]) == ("As said [1], and, arr[0] too [2].", [1, 2], [9])
    v = one(spark, citations.validated(F.lit("all  fine [1]"), F.lit(1)))
    assert (v["cleaned"], v["invalid"]) == ("all  fine [1]", [])
    block = citations.context_block(F.array(F.struct(F.lit("T").alias("title"), F.lit(3).alias("page"), F.lit("body").alias("text"))), 5)
    assert one(spark, block) == "[5] (T, p. 3)\nbody"
