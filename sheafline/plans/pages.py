"""Chunks, layout, structure and enrichment queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import boxes, formats, ids
from sheafline.functions import text as T
from sheafline.operators import enrich, layout, structure
from sheafline.plans.tables import CHUNKS_SQL, REGIONS_SQL, WORDS_SQL, chunks, regions, words
from sheafline.session import read

_UUID = "6ba7b8119dad11d180b400c04fd430c8"


def node_id_sql(prefix: str, seed: str) -> str:
    h = f"sha1(unhex('{_UUID}') || encode({seed}))"
    nib = f"substr('89ab', ((('0x' || substr(h, 17, 1))::int) % 4) + 1, 1)"
    return f"(select '{prefix}_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || {nib} || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select {h} as h))"


#: Entities dropped as boilerplate in the test queries: two kinds of organisations.
_DROPPED = " (?:Institute|Archive)$"


def _documents(s, d):
    return read(s, d, "documents")


def _kept(s, d):
    ents = enrich.entities(chunks(s, d))
    return enrich.without_boilerplate(enrich.distinct_entities(ents), enrich.chunk_pairs(chunks(s, d)), F.col("text").rlike(_DROPPED))


QUERIES = {
    "noise_filter": lambda s, d: chunks(s, d).where(F.length(T.strip(F.col("text"))) >= 4).select("chunk_id"),
    "boilerplate_filter": lambda s, d: chunks(s, d).select("chunk_id", T.is_boilerplate(F.col("text")).alias("boilerplate")),
    "range_quarantine": lambda s, d: chunks(s, d)
    .select("chunk_id", boxes.is_box(F.col("bounding_box")).alias("box_ok"), F.coalesce(F.col("confidence").between(0, 1) & (F.col("page") >= 0) & (F.col("token_count") >= 0), F.lit(False)).alias("range_ok"))
    .where("not box_ok or not range_ok"),
    "figure_filter": lambda s, d: chunks(s, d).where(boxes.is_box(F.col("bounding_box")) & (boxes.short_side(F.col("bounding_box")) >= 50)).select("chunk_id", boxes.short_side(F.col("bounding_box")).cast("long").alias("short_side")),
    "page_box_union": lambda s, d: chunks(s, d).where(boxes.is_box(F.col("bounding_box"))).groupBy("doc_id", "page").agg(boxes.union_of(F.col("bounding_box")).alias("b")).select("doc_id", "page", *[F.col("b")[i].cast("long").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]),
    "preview": lambda s, d: chunks(s, d).select("chunk_id", T.preview(F.col("text")).alias("preview")),
    "token_counts": lambda s, d: chunks(s, d).select("chunk_id", T.token_count(F.col("text")).cast("long").alias("n_tokens")),
    "sentence_counts": lambda s, d: _documents(s, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences")),
    "paragraph_counts": lambda s, d: _documents(s, d).select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs")),
    "markdown_tables": lambda s, d: _documents(s, d).select("doc_id", T.markdown_table_size(F.col("text")).alias("t")).where("t.rows > 0").select("doc_id", F.col("t.rows").cast("long").alias("n_rows"), F.col("t.cols").cast("long").alias("n_cols")),
    "split_decimals": lambda s, d: _documents(s, d).where("text is not null").select("doc_id", F.length(T.join_split_decimals(F.regexp_replace("text", r"(\d),(\d)", "$1 . $2"))).cast("long").alias("n_chars")),
    "deterministic_ids": lambda s, d: structure.chunk_ids(chunks(s, d)).select("chunk_id", "node_id"),
    "document_ids": lambda s, d: read(s, d, "uir_raw").select("uri", ids.node_id("doc", F.col("uri")).alias("doc_node")).distinct(),
    "id_validation": lambda s, d: chunks(s, d).select("chunk_id", ids.id_fits(F.col("chunk_id"), F.lit("chunk")).alias("ok")),
    "format_route": lambda s, d: read(s, d, "uir_raw").select("uri").distinct().select("uri", formats.format_of_name(F.col("uri")).alias("format"), formats.route_of(formats.format_of_name(F.col("uri"))).alias("route"), formats.mime_of(formats.format_of_name(F.col("uri"))).alias("mime_type")),
    "route_counts": lambda s, d: read(s, d, "uir_raw").select("uri").distinct().groupBy(formats.route_of(formats.format_of_name(F.col("uri"))).alias("route")).agg(F.count("*").alias("n_files")),
    "chunk_neighbours": lambda s, d: structure.neighbour_links(chunks(s, d)),
    "section_islands": lambda s, d: structure.section_runs(chunks(s, d)).select("doc_id", "chunk_id", "child_no", "section_id"),
    "assembled_sections": lambda s, d: structure.assembled(chunks(s, d)).select("doc_id", "child_no", "title", "n_chunks", "first_index", "last_index", "page"),
    "section_carry": lambda s, d: structure.carried_sections(regions(s, d), ["page", "reading_order", "region_id"]).select("region_id", "section_path", "is_first", "is_last"),
    "page_texts": lambda s, d: regions(s, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "region_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text")),
    "layout_lines": lambda s, d: layout.word_lines(words(s, d)).select("word_id", F.col("line_no").cast("long").alias("line_no")),
    "layout_regions": lambda s, d: layout.regions(words(s, d)).select("doc_id", "page", "region_no", "label", "text", "n_words", "confidence", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]),
    "entities": lambda s, d: enrich.entities(chunks(s, d)).select("chunk_id", F.col("pos").cast("long").alias("pos"), "text", "type", "confidence"),
    "entity_dedupe": lambda s, d: enrich.distinct_entities(enrich.entities(chunks(s, d))).select("doc_id", "text", "type", "confidence"),
    "topic_top5": lambda s, d: enrich.topics(enrich.distinct_entities(enrich.entities(chunks(s, d)))).select("doc_id", "topic", "n_types", F.col("rank").cast("long").alias("rank")),
    "cooccurrence_pairs": lambda s, d: enrich.chunk_pairs(chunks(s, d)).select("chunk_id", "from_text", "to_text", "confidence", F.col("rank").cast("long").alias("rank")),
    "boilerplate_entities": lambda s, d: _kept(s, d)[0].select("doc_id", "text", "type"),
    "boilerplate_relations": lambda s, d: _kept(s, d)[1].select("doc_id", "chunk_id", "from_text", "to_text"),
}

_STOP = "'^\\s+|\\s+$'"
_ROUTE = "case " + " ".join(f"when format in ({', '.join(repr(x.upper()) for x in exts)}) then '{route}'" for route, exts in formats.EXTENSIONS.items()) + " " + " ".join(f"when format = '{k}' then '{k}'" for k in formats.KINDS) + " else 'SKIP' end"
_MIME = "case format " + " ".join(f"when '{k}' then '{v}'" for k, v in formats.MIME.items()) + " else 'application/octet-stream' end"
_KNOWN = ", ".join(repr(x) for x in sorted(formats.ROUTE_OF))
_KIND = "case " + " ".join(f"when ext in ({', '.join(repr(x.upper()) for x in formats.EXTENSIONS[k])}) then '{k}'" for k in formats.KINDS) + f" when ext in ({_KNOWN}) then ext else '' end"
_FORMATS = f"f as (select uri, {_KIND} as format from (select uri, upper(regexp_extract(uri, '\\.([A-Za-z0-9]+)$', 1)) as ext from (select distinct uri from uir_raw)))"
_BOX = "coalesce(len(bounding_box) = 4 and len(list_filter(bounding_box, lambda v: v is not null and v >= 0 and v <= 1000)) = 4 and bounding_box[1] <= bounding_box[3] and bounding_box[2] <= bounding_box[4], false)"
RUNS_SQL = f"""{CHUNKS_SQL}, p as (select *, coalesce(section_path, '') as sp, lag(coalesce(section_path, '')) over (partition by doc_id order by chunk_index, chunk_id) as before from c),
o as (select *, sum(case when sp = '' or before is null or before <> sp then 1 else 0 end) over (partition by doc_id order by chunk_index, chunk_id rows unbounded preceding)::bigint - 1 as child_no from p)"""
_LINES = f"""{WORDS_SQL}, l0 as (select *, case when abs(y1 - lag(y1) over (partition by doc_id, page order by y1, x1, word_id)) >= 12 then 1 else 0 end as nl from w),
l as (select *, sum(nl) over (partition by doc_id, page order by y1, x1, word_id rows unbounded preceding)::bigint as line_no from l0)"""
_ENT = f"""{CHUNKS_SQL}, x as (select doc_id, chunk_id, {" || ".join(f"list_transform(regexp_extract_all(coalesce(text, ''), '{p}', 1), lambda t: {{'text': t, 'type': '{k}'}})" for k, p in enrich.PATTERNS.items())} as es from c),
e as (select doc_id, chunk_id, pos, es[pos + 1].text as text, es[pos + 1].type as type, case es[pos + 1].type when 'ORG' then 0.90::double when 'DATE' then 0.70::double when 'QUANTITY' then 0.72::double when 'LAW' then 0.78::double end as confidence
  from (select doc_id, chunk_id, es, unnest(range(len(es))) as pos from x))"""
ENTITY_SQL = f"{_ENT}, u as (select * from e qualify row_number() over (partition by doc_id, lower(text), type order by confidence desc, chunk_id, pos) = 1)"
_PAIRS = f"""{_ENT}, q as (select a.doc_id, a.chunk_id, a.pos as i, b.pos as j, a.text as from_text, b.text as to_text, a.confidence as ca, b.confidence as cb from e a join e b on a.chunk_id = b.chunk_id and a.pos < b.pos and a.text <> b.text),
q1 as (select * from q qualify row_number() over (partition by chunk_id, least(from_text, to_text), greatest(from_text, to_text) order by i, j) = 1),
q2 as (select *, row_number() over (partition by chunk_id order by i, j) as rank from q1 qualify rank <= 20)"""
SQL = {
    "noise_filter": f"with {CHUNKS_SQL} select chunk_id from c where length(regexp_replace(text, {_STOP}, '', 'g')) >= 4",
    "boilerplate_filter": f"with {CHUNKS_SQL} select chunk_id, coalesce(regexp_matches(text, '(?i)" + "|".join(T.BOILERPLATE) + "'), false) as boilerplate from c",
    "range_quarantine": f"with {CHUNKS_SQL}, k as (select chunk_id, {_BOX} as box_ok, coalesce(confidence between 0 and 1 and page >= 0 and token_count >= 0, false) as range_ok from c) select * from k where not box_ok or not range_ok",
    "figure_filter": f"with {CHUNKS_SQL} select chunk_id, least(bounding_box[3] - bounding_box[1], bounding_box[4] - bounding_box[2])::bigint as short_side from c where {_BOX} and least(bounding_box[3] - bounding_box[1], bounding_box[4] - bounding_box[2]) >= 50",
    "page_box_union": f"with {CHUNKS_SQL} select doc_id, page, min(bounding_box[1])::bigint as x1, min(bounding_box[2])::bigint as y1, max(bounding_box[3])::bigint as x2, max(bounding_box[4])::bigint as y2 from c where {_BOX} group by doc_id, page",
    "preview": f"with {CHUNKS_SQL} select chunk_id, substring(regexp_replace(regexp_replace(coalesce(text, ''), {_STOP}, '', 'g'), '\\s+', ' ', 'g'), 1, 120) as preview from c",
    "token_counts": f"with {CHUNKS_SQL} select chunk_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) as n_tokens from c",
    "sentence_counts": "select doc_id, case when regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]', '', 'g') = '' then 0 else 1 + len(regexp_extract_all(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[.!?]\\s+[A-Z(\\[\"''“]')) end as n_sentences from documents",
    "paragraph_counts": "select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\n\\s*\\n+'), lambda p: regexp_replace(p, '[\\s\\p{Z}]', '', 'g') <> '')) as n_paragraphs from documents",
    "markdown_tables": "with t as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: starts_with(ltrim(l), '|') and not contains(l, '---')) as ls from documents) select doc_id, len(ls) as n_rows, greatest(length(ls[1]) - length(replace(ls[1], '|', '')) - 1, 0) as n_cols from t where len(ls) > 0",
    "split_decimals": r"""with n as (select doc_id, regexp_replace(text, '(\d),(\d)', '\1 . \2', 'g') as text from documents where text is not null)
        select doc_id, length(regexp_replace(regexp_replace(text, '(\d)\s+\.\s*(\d)', '\1.\2', 'g'), '(\d)\s+\.\s*(\d)', '\1.\2', 'g')) as n_chars from n""",
    "deterministic_ids": f"with {CHUNKS_SQL} select chunk_id, {node_id_sql('chunk', chr(39) + 'chunk|' + chr(39) + ' || doc_id || ' + chr(39) + '|' + chr(39) + ' || chunk_index || ' + chr(39) + '|' + chr(39) + ' || substring(coalesce(text, ' + chr(39) * 2 + '), 1, 64)')} as node_id from c",
    "document_ids": f"select uri, {node_id_sql('doc', chr(39) + 'doc|' + chr(39) + ' || uri')} as doc_node from (select distinct uri from uir_raw)",
    "id_validation": f"with {CHUNKS_SQL} select chunk_id, coalesce(regexp_matches(chunk_id, '^chunk_[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$'), false) as ok from c",
    "format_route": f"with {_FORMATS} select uri, format, {_ROUTE} as route, {_MIME} as mime_type from f",
    "route_counts": f"with {_FORMATS} select {_ROUTE} as route, count(*) as n_files from f group by 1",
    "chunk_neighbours": f"with {CHUNKS_SQL} select doc_id, chunk_id, lag(chunk_id) over o as preceding_chunk_id, lead(chunk_id) over o as following_chunk_id from c window o as (partition by doc_id order by chunk_index, chunk_id)",
    "section_islands": f"with {RUNS_SQL} select doc_id, chunk_id, child_no, case when sp <> '' then {node_id_sql('section', chr(39) + 'section|' + chr(39) + ' || doc_id || ' + chr(39) + '|' + chr(39) + ' || child_no || ' + chr(39) + '|' + chr(39) + ' || sp')} end as section_id from o",
    "assembled_sections": f"with {RUNS_SQL} select doc_id, child_no, max(section_path) as title, count(*) as n_chunks, min(chunk_index) as first_index, max(chunk_index) as last_index, min(page) as page from o group by doc_id, child_no",
    "section_carry": f"""with {REGIONS_SQL}, h as (select *, coalesce(label = 'heading', false) as is_first, case when label = 'heading' then case when regexp_matches(coalesce(text, ''), '^\\s*(\\d+(?:\\.\\d+)*)[\\.\\s]+(\\S.{{2,}})$') then regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)[\\.\\s]+(\\S.{{2,}})$', 1)
        else regexp_replace(regexp_replace(coalesce(text, ''), {_STOP}, '', 'g'), '\\.+$', '') end end as path from r)
        select region_id, coalesce(last_value(path ignore nulls) over o, '') as section_path, is_first, coalesce(lead(is_first) over (partition by doc_id order by page, reading_order, region_id), true) as is_last from h
        window o as (partition by doc_id order by page, reading_order, region_id rows unbounded preceding)""",
    "page_texts": f"with {REGIONS_SQL} select doc_id, page, string_agg(coalesce(text, ''), chr(10) order by reading_order, region_id) as text from r group by doc_id, page",
    "layout_lines": f"with {_LINES} select word_id, line_no from l",
    "layout_regions": f"""with {_LINES}, n as (select doc_id, page, line_no, min(y1) as y1, max(y2) as y2, min(x1) as x1, max(x2) as x2, max(page_height) as ph, sum(coalesce(confidence, 0)) as conf, count(*) as n, string_agg(coalesce(text, ''), ' ' order by x1, word_id) as text from l group by all),
        g0 as (select *, case when y1 - max(y2) over (partition by doc_id, page order by line_no rows between unbounded preceding and 1 preceding) >= 24 then 1 else 0 end as ng from n),
        g as (select *, sum(ng) over (partition by doc_id, page order by line_no rows unbounded preceding)::bigint as region_no from g0),
        z as (select doc_id, page, region_no, string_agg(text, ' ' order by line_no) as text, sum(n)::bigint as n_words, sum(conf) as conf, min(x1)::bigint as x1, min(y1)::bigint as y1, max(x2)::bigint as x2, max(y2)::bigint as y2, max(ph) as ph from g group by all)
        select doc_id, page, region_no, case when region_no = 0 and y1 < 80 then 'header' when region_no = max(region_no) over (partition by doc_id, page) and ph - y2 < 80 then 'footer'
          when len(string_split_regex(text, '\\s+')) <= 6 and not regexp_matches(text, '[.!?:;]\\s*$') then 'heading' else 'paragraph' end as label,
          text, n_words, round(greatest(0.0, least(1.0, conf / n_words)), 6) as confidence, x1, y1, x2, y2 from z""",
    "entities": f"with {_ENT} select chunk_id, pos, text, type, confidence from e",
    "entity_dedupe": f"with {ENTITY_SQL} select doc_id, text, type, confidence from u",
    "topic_top5": f"with {ENTITY_SQL}, t as (select doc_id, lower(trim(text)) as topic, count(*) as n_types, min((chunk_id, pos)) as seen from u group by 1, 2) select doc_id, topic, n_types, row_number() over (partition by doc_id order by n_types desc, seen, topic) as rank from t qualify rank <= 5",
    "cooccurrence_pairs": f"with {_PAIRS} select chunk_id, from_text, to_text, round((ca + cb) / 2, 3) as confidence, rank from q2",
    "boilerplate_entities": f"with {ENTITY_SQL} select doc_id, text, type from u where not regexp_matches(text, '{_DROPPED}')",
    "boilerplate_relations": f"with {_PAIRS}, u as (select * from e qualify row_number() over (partition by doc_id, lower(text), type order by confidence desc, chunk_id, pos) = 1), k as (select distinct doc_id, text from u where not regexp_matches(text, '{_DROPPED}')) select doc_id, chunk_id, from_text, to_text from q2 semi join k k1 on q2.doc_id = k1.doc_id and q2.from_text = k1.text semi join k k2 on q2.doc_id = k2.doc_id and q2.to_text = k2.text",
}
