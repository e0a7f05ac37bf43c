import random

from pyspark.sql import functions as F

from sheafline.operators import chunking, enrich, intent, library, media, render, search, structure, throttle

CHUNK = "doc_id string, chunk_id string, chunk_index int, text string, page int, section_path string, embedding array<double>, token_count int"


def chunks(spark, rows):
    return spark.createDataFrame([(d, c, i, t, 1, s, e, 1) for d, c, i, t, s, e in rows], CHUNK)


def test_title_beats_equal_content(spark):
    df = chunks(spark, [("d1", "a", 0, "x", "Plain", [1.0, 0.0, 0.0]), ("d2", "b", 0, "x", "Solar report", [1.0, 0.0, 0.0]), ("d3", "c", 0, "x", "Solar", [0.0, 1.0, 0.0]), ("d4", "d", 0, "x", "Other", [0.0, 1.0, 0.0])])
    got = [(r["chunk_id"], r["score"], r["title_match"]) for r in search.search(df, "solar", [1.0, 0.0, 0.0]).collect()]
    assert got == [("b", 1.3, True), ("a", 1.0, False), ("c", 0.3, True)]
    assert search.search(df, "  ", [1.0, 0.0, 0.0]).collect() == []
    assert search.search(df.limit(0), "solar").collect() == []


def test_lexical_score(spark):
    df = chunks(spark, [("d", "a", 0, "solar solar wind", "Top", None), ("d", "b", 1, "water", None, None), ("d", "c", 2, None, "x", None)])
    got = {r["chunk_id"]: r["score"] for r in search.search(df, "solar power").collect()}
    norm = 0.25 + 0.75 * (3 / (4 / 3))
    assert got == {"a": round(2 * 2.2 / (2 + 1.2 * norm), 6)}


def test_retrieve_never_mixes(spark):
    df = chunks(spark, [("d", "a", 0, "solar", "s", [0.6, 0.8]), ("d", "b", 1, "solar", "s", [0.5, 0.5]), ("d", "c", 2, "solar", "s", None)])
    assert [r["chunk_id"] for r in search.retrieve(df, "solar", [1.0, 0.0]).collect()] == ["a"]
    assert {r["chunk_id"] for r in search.retrieve(df, "solar", None).collect()} == {"a", "b", "c"}


def test_dynamic_floor(spark):
    df = spark.createDataFrame([("x", 0.9), ("x", 0.76), ("x", 0.7), ("y", 0.1), ("y", 0.1), ("y", 0.09), ("z", 0.01)], "doc_id string, score double")
    got = sorted((r["doc_id"], r["score"]) for r in search.dynamic_floor(df).collect())
    assert got == [("x", 0.76), ("x", 0.9), ("y", 0.1), ("y", 0.1)]


def test_intent(spark):
    df = chunks(spark, [("d", f"c{i}", i, t, s, e) for i, (t, s, e) in enumerate([("solar cell", "Power", [1.0, 0.0]), ("other", "Power", [0.0, 1.0]), ("far", "Misc", [0.0, 1.0]), ("plain", "Solar notes", [0.0, 1.0])])])
    by_text = {r["chunk_id"]: (r["score_kind"], r["selected_by"]) for r in intent.matches(df, "solar").collect()}
    assert by_text["c0"][1] == "text" and by_text["c3"][1] == "title" and set(by_text) == {"c0", "c3"}
    by_vector = {r["chunk_id"]: (r["score_kind"], r["selected_by"]) for r in intent.matches(df, "solar", [1.0, 0.0]).collect()}
    assert by_vector == {"c0": ("cosine", "cosine"), "c1": ("selected", "neighbour"), "c3": ("selected", "title")}
    s = intent.summary(df, "nothing here").first()
    assert (s["total_chunks"], s["matched_chunks"], s["no_match"]) == (4, 1, True)


def test_sections(spark):
    df = chunks(spark, [("d", f"c{i}", i, "t", s, None) for i, s in enumerate(["A", "A", "", "A", None, "B"])])
    got = [(r["chunk_id"], r["child_no"], r["section_id"] is not None) for r in structure.section_runs(df).orderBy("chunk_index").collect()]
    assert got == [("c0", 0, True), ("c1", 0, True), ("c2", 1, False), ("c3", 2, True), ("c4", 3, False), ("c5", 4, True)]
    hot = structure.section_runs(df, hot_rows=2).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["child_no"]) for r in hot] == [(a, b) for a, b, _ in got]
    links = {r["chunk_id"]: (r["preceding_chunk_id"], r["following_chunk_id"]) for r in structure.neighbour_links(df).collect()}
    assert links["c0"] == (None, "c1") and links["c5"] == ("c4", None)
    nested = structure.assembled(df, nested=True).orderBy("child_no").first()
    assert [c["chunk_id"] for c in nested["children"]] == ["c0", "c1"]


def test_heading_carry(spark):
    rows = [(0, "paragraph", "intro"), (1, "heading", "1.2 The start"), (2, "paragraph", "x"), (3, "heading", "Plain."), (4, "paragraph", "y")]
    df = spark.createDataFrame([("d", o, lab, t) for o, lab, t in rows], "doc_id string, ord int, label string, text string")
    got = [(r["section_path"], r["is_first"], r["is_last"]) for r in structure.carried_sections(df, ["ord"]).orderBy("ord").collect()]
    assert got == [("", False, True), ("1.2", True, False), ("1.2", False, True), ("Plain", True, False), ("Plain", False, True)]


def test_render(spark):
    df = chunks(spark, [("d", "c0", 0, "bare  ", "", None), ("d", "c1", 1, "one", "A", None), ("d", "c2", 2, "two", "A", None)])
    want = "# A\n\n**Contents:**\n\n- A\n---\n\n<!-- chunk: c0, page: 1 -->\nbare\n\n## A\n\n<!-- chunk: c1, page: 1 -->\none\n\n<!-- chunk: c2, page: 1 -->\ntwo\n"
    assert render.markdown(df).first()["markdown"] == want
    kept = render.markdown(df, df.where("chunk_id = 'c2'")).first()["markdown"]
    assert "one" not in kept and "two" in kept


def test_entities(spark):
    df = spark.createDataFrame([("d", "c", "Alpha Works sold 12 pages in 1999 to Alpha Works, ref AB-1234."), ("d", "e", None)], "doc_id string, chunk_id string, text string")
    ents = enrich.entities(df)
    assert {(r["text"], r["type"], r["confidence"]) for r in ents.collect()} == {("Alpha Works", "ORG", 0.9), ("1999", "DATE", 0.7), ("12 pages", "QUANTITY", 0.72), ("AB-1234", "LAW", 0.78)}
    distinct = enrich.distinct_entities(ents)
    assert distinct.count() == 4
    pairs = enrich.pairs(ents)
    assert pairs.count() == 6 and pairs.where("from_text = to_text").count() == 0
    kept, rel = enrich.without_boilerplate(distinct, pairs, F.col("type") == "ORG")
    assert kept.count() == 3 and rel.count() == 3


def test_pair_cap(spark):
    text = " ".join(f"{i} pages" for i in range(10, 22))
    df = spark.createDataFrame([("d", "c", text)], "doc_id string, chunk_id string, text string")
    assert enrich.pairs(enrich.entities(df)).count() == 20


def test_alignment(spark):
    seg = spark.createDataFrame([("d", 1, 0.0, 10.0), ("d", 2, 50.0, 55.0), ("d", 3, 10.0, 20.0), ("d", 4, None, None)], "doc_id string, seq int, start double, end double")
    spk = spark.createDataFrame([("d", 1, 0.0, 3.0, "A"), ("d", 2, 3.0, 10.0, "B"), ("d", 3, 10.0, 15.0, "C"), ("d", 4, 15.0, 20.0, "D")], "doc_id string, seq int, start double, end double, speaker string")
    for width in (1.0, 30.0):
        got = {r["seq"]: r["speaker"] for r in media.align_speakers(seg, spk, width).collect()}
        assert got == {1: "B", 2: "UNKNOWN", 3: "C", 4: "UNKNOWN"}


def test_frames(spark):
    c = spark.createDataFrame([("d", 0, 0.0, 20.0), ("d", 1, 20.0, 30.0)], "doc_id string, chunk_no int, start double, end double")
    f = spark.createDataFrame([("d", 2.0), ("d", 20.0), ("d", 35.0)], "doc_id string, timestamp double")
    assert sorted((r["chunk_no"], r["timestamp"]) for r in media.frames_in_chunks(c, f, 7.0).collect()) == [(0, 2.0), (0, 20.0), (1, 20.0)]
    assert tuple(media.trailing_frames(c, f).first())[:2] == ("d", 1)


def test_transcript_chunks(spark):
    rows = [("d", i, float(i), i + 1.0, s, n) for i, (s, n) in enumerate([("A", 100), ("B", 200), ("B", 100), ("A", 600), ("A", 10)])]
    df = spark.createDataFrame(rows, "doc_id string, seq int, start double, end double, speaker string, n_tokens int")
    got = [tuple(r) for r in media.chunk_summary(media.transcript_chunks(df)).orderBy("chunk_no").select("chunk_no", "start", "end", "n_segments", "speaker").collect()]
    assert got == [(0, 0.0, 3.0, 3, "B"), (1, 3.0, 4.0, 1, "A"), (2, 4.0, 5.0, 1, "A")]


def test_throttle(spark):
    attempts = [("u", i, t, f) for i, (t, f) in enumerate([(0.0, True)] * 4 + [(10.0, True), (20.0, False), (909.0, False), (911.0, True), (2000.0, True)])] + [("v", 99, 5.0, True)]
    df = spark.createDataFrame(attempts, "user_id string, event_id int, at double, failed boolean")
    assert sorted(r["event_id"] for r in throttle.refused(df).where("refused").collect()) == [5, 6]


def test_throttle_of_a_hot_account(spark):
    rng = random.Random(7)
    at, data = 0.0, []
    for i in range(600):
        at += rng.choice([1.0, 30.0, 400.0, 900.0, 901.0, 5000.0])
        data.append(("u", i, at, rng.random() < 0.8))
    state, want = (0, 0.0, 0.0), set()
    for _, i, t, failed in data:
        state, no = throttle.step(state, t, failed)
        want |= {i} if no else set()
    df = spark.createDataFrame(data, "user_id string, event_id int, at double, failed boolean")
    for hot in (10**6, 50):
        assert {r["event_id"] for r in throttle.refused(df, hot_rows=hot).where("refused").collect()} == want
    assert want


def test_chunk_invariants():
    rng = random.Random(0)
    for _ in range(30):
        paras = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([3, 40, 200, 700]))) for _ in range(rng.randrange(1, 12))]
        out = chunking.chunk("\n\n".join(paras))
        assert all(chunking.count_tokens(c) <= chunking.MAX for c in out)
        bare = chunking.chunk("\n\n".join(paras), pct=0)
        assert "".join("".join(bare).split()) == "".join("".join(paras).split())
        pages = chunking.paginate("\n\n".join(paras), 500)
        assert "\n\n".join(pages) == "\n\n".join(paras)
    assert chunking.chunk(None) == chunking.chunk(" \n\n ") == [] and chunking.paginate("") == []
    assert all(chunking.count_tokens(x) <= 100 for x in chunking.halves("a" * 50 + " " + ". " * 900, 100, chunking.count_tokens))


def test_library(spark):
    jobs = spark.createDataFrame([(1, 10, "A.pdf"), (2, None, "b.txt"), (3, 10, "a.PDF")], "job_id long, folder_id long, filename string")
    folders = spark.createDataFrame([(10,), (11,)], "folder_id long")
    assert {r["folder_id"]: r["n_jobs"] for r in library.folder_counts(folders, jobs).collect()} == {10: 2, 11: 0}
    f, j = library.delete_folder(folders, jobs, 10)
    assert f.count() == 1 and j.where("folder_id is null").count() == 3
    moved = library.set_folder(jobs, folders, spark.createDataFrame([(2, 11), (1, 99)], "job_id long, to_folder long"))
    assert {r["job_id"]: r["folder_id"] for r in moved.collect()} == {1: 10, 2: 11, 3: 10}
    m = spark.createDataFrame([(7, "see @a.pdf and @none")], "id long, content string")
    assert [tuple(r) for r in library.mentioned_files(m, jobs).collect()] == [(7, 1)]
    members = spark.createDataFrame([(1, "Al@x"), (1, "bo@x"), (2, "al@x")], "conversation_id long, email string")
    assert library.leave(members, 2, " AL@x ").count() == 2
    new = library.upsert(jobs, spark.createDataFrame([(2, 11, "n"), (9, None, "z")], jobs.schema), "job_id")
    assert {r["job_id"]: r["filename"] for r in new.collect()} == {1: "A.pdf", 2: "n", 3: "a.PDF", 9: "z"}


def test_transcript_overlap(spark):
    rows = [("d", i, float(i), i + 1.0, s, n) for i, (s, n) in enumerate([("A", 300), ("B", 100), ("C", 200), ("C", 200), ("A", 450), ("A", 10)])]
    df = spark.createDataFrame(rows, "doc_id string, seq int, start double, end double, speaker string, n_tokens int")
    bundled = media.with_overlap(media.transcript_chunks(df))
    got = [tuple(r) for r in media.chunk_summary(bundled).orderBy("chunk_no").select("chunk_no", "start", "end", "n_segments", "n_tokens", "speaker").collect()]
    assert got == [(0, 0.0, 2.0, 2, 400, "A"), (1, 1.0, 4.0, 3, 500, "C"), (2, 4.0, 5.0, 1, 450, "A"), (3, 4.0, 6.0, 2, 460, "A")]
