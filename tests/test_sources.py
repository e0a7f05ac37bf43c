import io
import json
import zipfile

from sheafline.sources import files
from sheafline.streaming import ingest

RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 First {\b bold} para.\par Second \'e9 \u8364? one.\par{\*\generator x;}}"
MAIL = b"Subject: Hello\r\nFrom: a@x.org\r\nTo: b@x.org\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nContent-Type: text/html\r\n\r\n<p>a &amp; b</p>"


def slides():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="500"/><a:ext cx="500" cy="500"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldSz cx="1000" cy="1000"/></p:presentation>')
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {ns}>{shape("<p:ph type=\"title\"/>", "Head")}{shape("", "Body")}</p:sld>')
    return out.getvalue()


def test_lanes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.rtf": RTF, "sub/b.md": b"# Top\n\ntext\n\n#!x", "c.eml": MAIL, "d.bin": b"x", "e.pptx": slides(), "f.txt": b"bad \xff byte", "g.ipynb": json.dumps({"metadata": {"kernelspec": {"language": "r"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "y <- 1"}, {"cell_type": "code", "source": " "}]}).encode(), "h.ipynb": b"{"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path)).cache()
    assert {r["path"].rsplit("/", 1)[-1]: (r["format"], r["route"]) for r in found.collect()}["e.pptx"] == ("PPTX", "PPTX_NATIVE")
    assert found.count() == 7
    texts = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in files.texts(found).collect()}
    assert texts["a.rtf"][0] == "First bold para.\n\nSecond é € one."
    assert texts["c.eml"][0] == "a & b"
    assert texts["g.ipynb"][0] == "# T\nx\n\n```r\ny <- 1\n```"
    assert texts["h.ipynb"][0] is None and texts["h.ipynb"][1]
    assert texts["f.txt"][0] == "bad � byte"
    regions = [(r["label"], r["text"]) for r in files.regions(files.texts(found)).where("path like '%b.md'").orderBy("reading_order").collect()]
    assert regions == [("heading", "# Top"), ("paragraph", "text"), ("paragraph", "#!x")]
    assert files.mails(found).first()["subject"] == "Hello"
    assert [(r["label"], r["text"], r["box"]) for r in files.slides(found).orderBy("reading_order").collect()] == [("heading", "Head", [0, 500, 500, 1000]), ("paragraph", "Body", [0, 500, 500, 1000])]


def test_document_sink(spark, tmp_path):
    docs = spark.createDataFrame([("doc/1", "text"), ("doc_2", None)], "doc_id string, markdown string")
    rows = files.write_documents(docs, str(tmp_path / "out")).collect()
    assert sorted((tmp_path / "out").glob("*")) == sorted(tmp_path / "out" / n for n in ("doc_1.md", "doc_2.md")) and sum(r["n_bytes"] for r in rows) == 4


def test_streams(spark, tmp_path):
    schema = "k long, v string"
    for i, data in enumerate([[(1, "a"), (2, "b")], [(2, "B"), (3, "c")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = ingest.table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        ingest.upsert_stream(changes, str(tmp_path / "out"), "k", str(tmp_path / "cp"), buckets=3).awaitTermination(120)
    assert sorted(map(tuple, ingest.read_upserted(spark, str(tmp_path / "out")).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.md").write_bytes(b"# a")
    q = ingest.file_stream(spark, str(tmp_path / "files")).select("path", "route").writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["route"] for r in spark.table("routed").collect()] == ["TEXT"]


def test_throttle_stream(spark, tmp_path):
    schema = "user_id string, event_id long, at double, failed boolean"
    spark.createDataFrame([("u", i, float(i), True) for i in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    attempts = ingest.table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = ingest.throttle_stream(attempts).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["refused"] for r in spark.table("throttled").collect()} == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}
