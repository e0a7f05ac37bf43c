import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline import hooks
from sheafline.functions import formats
from sheafline.operators import documents, extract, intent, library, media, shred
from sheafline.sources import files

CHUNK = "doc_id string, chunk_id string, chunk_index int, text string, page int, section_path string, bounding_box array<int>"


def chunks(spark):
    rows = [("d\"1", "c0", 0, "bare \\ text", 1, None, [1, 2, 3, 4]), ("d\"1", "c1", 1, "solar \"cell\"", 1, "Power", None), ("d\"1", "c2", 2, "other\nline", 2, "Power", None), ("d\"1", "c3", 3, "end", None, "Misc", None), ("e", "x", 0, "nothing", 1, "A", None)]
    return spark.createDataFrame(rows, CHUNK)


def test_nested_documents_are_json_and_read_back(spark):
    docs = {r["doc_id"]: json.loads(r["payload"]) for r in documents.nested(chunks(spark)).collect()}
    root = docs['d"1']["structure"]["root"]
    assert root["id"] == 'd"1' and [k["type"] for k in root["children"]] == ["chunk", "section", "section"]
    assert [c["text"] for c in root["children"][1]["children"]] == ['solar "cell"', "other\nline"]
    back = {(r["node_id"], r["child_no"], r["box"]) for r in shred.found(documents.nested(chunks(spark))).where("doc_id = 'd\"1'").collect()}
    assert {("c0", 0, "1,2,3,4"), ("c1", 0, ""), ("c2", 1, ""), ("c3", 0, "")} <= back and len(back) == 6
    assert documents.nested(chunks(spark).limit(0)).collect() == []


def test_filtered_tree(spark):
    c = chunks(spark)
    got = {r["chunk_id"]: (r["score_kind"], r["no_match"]) for r in intent.composed(c, "solar").collect()}
    assert got == {"c1": ("bm25-lite", False), "x": ("no_match_fallback", True)}
    whole = {r["chunk_id"] for r in intent.composed(c, "power").where("not no_match").collect()}
    assert whole == {"c1", "c2"}  # the section's title matches
    assert intent.composed(c, " ").where("no_match").count() == 0 and intent.composed(c, " ").count() == 5
    payload = json.loads(intent.filtered_documents(c, "solar").where("doc_id <> 'e'").first()["payload"])
    assert payload["structure"]["root"]["children"][0]["children"][0]["score_kind"] == "bm25-lite"


def test_topics(spark):
    df = spark.createDataFrame([(["Stellar nucleosynthesis", "main sail"],), ([],)], "topics array<string>")
    hits = [r[0] for r in df.select(intent.topics_hit("stellar nucleo ai sail main2", F.col("topics"))).collect()]
    assert hits == [["stellar", "nucleo", "sail"], []]


def container(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "see word/ and xl/ within")
    return out.getvalue()


def test_formats_of_containers(spark):
    rows = [("a.epub", container("OEBPS/word/one.xhtml", "META-INF/container.xml")), ("b.bin", container("word/document.xml", "xl/x")), ("c.xlsx", container("other")), ("d.docx", b"PK\x03\x04broken"), ("e.png", b"\x89PNG"), ("f.mp3", b""), ("g.pdf", b"%PDF-1.7 x"), ("h.txt", b"{\\rtf1 x}"), ("i", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r["f"] for r in df.select("path", formats.format_of_file(F.col("path"), F.col("content")).alias("f")).collect()}
    assert got == {"a.epub": "EPUB", "b.bin": "DOCX", "c.xlsx": "XLSX", "d.docx": "DOCX", "e.png": "IMAGE", "f.mp3": "AUDIO", "g.pdf": "PDF", "h.txt": "RTF", "i": ""}
    assert [r[0] for r in df.where("path in ('g.pdf', 'e.png')").orderBy("path").select(formats.is_pdf(F.col("content"))).collect()] == [False, True]


def test_bad_files_leave_an_error(spark):
    df = spark.createDataFrame([("a.pptx", "PPTX", b"no"), ("b.eml", "EML", b"Subject: s\n\nbody")], "path string, format string, content binary")
    bad = files.slides(df).first()
    assert bad["path"] == "a.pptx" and bad["text"] is None and "BadZipFile" in bad["error"]
    ok = files.mails(df).first()
    assert (ok["subject"], ok["text"], ok["error"]) == ("s", "body", None)


def test_many_wrappers():
    node = {"type": "document", "id": "r", "children": [{"id": "k", "type": "chunk"}]}
    for _ in range(40):
        node = {"data": json.dumps(node)} if _ < 4 else {"data": node}
    assert [s[4] for s in shred.stripes_of(json.dumps(node)) if s[4]] == ["r", "k"]


def test_query_vector_reasons():
    assert hooks.query_vector_or_reason(" ") == (None, "blank query")
    assert hooks.query_vector_or_reason("solar", dim=16)[1] is None

    def broken():
        raise RuntimeError("no model")

    assert hooks.query_vector_or_reason("solar", broken) == (None, "RuntimeError: no model")
    assert hooks.query_vector("solar", 32) != hooks.query_vector("solar", 32, "")


def test_page_texts_stand_in(spark):
    drafts = spark.createDataFrame([("a", 0, 1, "paragraph", "x")], "doc_id string, src_rank int, ord int, region_kind string, text string")
    pages = spark.createDataFrame([("a", 1, "no"), ("b", 2, "two"), ("b", 1, "one"), ("c", 1, None)], "doc_id string, page int, text string")
    assert [tuple(r) for r in extract.with_page_texts(drafts, pages).orderBy("doc_id").collect()] == [("a", 0, 1, "paragraph", "x"), ("b", 0, 0, "paragraph", "one two")]


def test_visual_chunks(spark):
    rows = [("d", 0.0, "a", 300), ("d", 65.0, "b", 200), ("d", 70.0, "c", 600), ("d", 80.0, None, 10)]
    got = media.visual_chunks(spark.createDataFrame(rows, "doc_id string, timestamp double, description string, n_tokens int")).orderBy("chunk_no").collect()
    assert [r["text"] for r in got] == ["[Visual 0:00] a\n\n[Visual 1:05] b", "[Visual 1:10] c", "[Visual 1:20] "]


def test_small_changes(spark):
    folders = spark.createDataFrame([(1,), (2,)], "folder_id long")
    assert {r["folder_id"]: r["name"] for r in library.renamed_folder(folders, 2, "n").collect()} == {1: None, 2: "n"}
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    assert [r[0] for r in library.without_jobs(jobs, spark.createDataFrame([(2,), (2,)], "job_id long")).collect()] == [1]
    threads = spark.createDataFrame([(1, "a@x"), (2, None)], "conversation_id long, peer_email string")
    assert {r[1]: r["peer_registered"] for r in library.with_registered_peer(threads, spark.createDataFrame([(" A@x ",)], "email string")).select("peer_email", "conversation_id", "peer_registered").select("conversation_id", "conversation_id", "peer_registered").collect()} == {1: True, 2: False}
    c = spark.createDataFrame([('[{"title": "t", "page": 3}]',), ("{broken",), (None,)], "c string").select(F.size(library.citation_list(F.col("c"))).alias("n"))
    assert [r["n"] for r in c.collect()] == [1, 0, 0]


@pytest.mark.parametrize("have", [True, False])
def test_rendered_or_placeholder(spark, have):
    docs = spark.createDataFrame([("a",)], "doc_id string")
    md = spark.createDataFrame([("a", "# A")], "doc_id string, markdown string").where(F.lit(have))
    assert documents.rendered(docs, md).first()["markdown"] == ("# A" if have else documents.PLACEHOLDER)
