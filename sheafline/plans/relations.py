"""Thread, folder, timeline and throttle queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators import chunking, citations, documents, library, media, render, throttle
from sheafline.plans.pages import node_id_sql
from sheafline.plans.tables import CHUNKS_SQL, MESSAGES_SQL, SEGMENTS_SQL, chunks, messages, segments
from sheafline.session import read


def _busiest(s: SparkSession, d: str) -> str:
    row = library.members_of(messages(s, d)).groupBy("email").count().orderBy(F.desc("count"), "email").first()
    return row["email"] if row else ""


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("job_id"), "folder_id", F.col("title").alias("filename"), F.col("created_at").alias("submitted_at"))


def _folders(s: SparkSession, d: str) -> DataFrame:
    return _jobs(s, d).where("folder_id is not null").select("folder_id").distinct()


def _fullest(s: SparkSession, d: str) -> int:
    """The folder with the most jobs."""
    row = _jobs(s, d).where("folder_id is not null").groupBy("folder_id").count().orderBy(F.desc("count"), "folder_id").first()
    return row["folder_id"] if row else -1


def _moves(s: SparkSession, d: str) -> DataFrame:
    return _jobs(s, d).where("folder_id is null").select("job_id", (F.col("job_id") % 120).alias("to_folder"))


def _speakers(s: SparkSession, d: str) -> DataFrame:
    """Diarised turns that lag the segments by a second and a half, as a second timeline."""
    return segments(s, d).select("doc_id", "seq", (F.col("start") + 1.5).alias("start"), (F.col("end") + 1.5).alias("end"), "speaker")


def _chunk_times(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d).select("doc_id", F.col("seq").alias("chunk_no"), "start", "end")


def _frames(s: SparkSession, d: str) -> DataFrame:
    return media.frames(segments(s, d).groupBy("doc_id").agg((F.max("end") + 45).alias("duration")))


def _bundled(s: SparkSession, d: str) -> DataFrame:
    return media.chunk_summary(media.transcript_chunks(segments(s, d).drop("text")))


def _overlapped(s: SparkSession, d: str) -> DataFrame:
    return media.chunk_summary(media.with_overlap(media.transcript_chunks(segments(s, d).drop("text"))))


def _described(s: SparkSession, d: str) -> DataFrame:
    """Segments taken for frames with a description."""
    return segments(s, d).select("doc_id", F.col("start").alias("timestamp"), "text", "seq", (F.coalesce("n_tokens", F.lit(0)) * 4).alias("n_tokens")).where("timestamp is not null").withColumn("description", F.concat_ws(" ", F.col("seq").cast("string"), "text"))


def _filtered(s: SparkSession, d: str) -> DataFrame:
    """Chunks of tables and headings only, with what is known of the documents."""
    meta = chunks(s, d).groupBy("doc_id").agg(F.max("page").alias("page_count"), F.lit("en").alias("language"))
    return render.markdown(chunks(s, d), chunks(s, d).where("region_kind in ('table', 'heading')").select("doc_id", "chunk_id"), meta, "tables and headings")


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Assistant messages whose stored citations are written into the text."""
    pages = F.regexp_extract_all(F.coalesce("citations", F.lit("")), F.lit(r'"page": ?(\d+)'), 1)
    marks = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("["), p, F.lit("]"))), " ")
    return messages(s, d).where("content is not null").select("id", F.concat("content", F.lit(" "), marks).alias("reply"), F.lit(15).cast("long").alias("n"))


def _mentioning(s: SparkSession, d: str) -> DataFrame:
    """Messages in which every word is a mention."""
    return messages(s, d).select("id", F.regexp_replace("content", r"(\S+)", "@$1").alias("content"))


def _events(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "purchase").alias("failed"))


QUERIES = {
    "thread_summaries": lambda s, d: library.thread_summaries(messages(s, d)),
    "thread_list": lambda s, d: library.threads_of(messages(s, d), library.members_of(messages(s, d)), _busiest(s, d)),
    "thread_members": lambda s, d: library.members_of(messages(s, d)),
    "thread_lookup": lambda s, d: library.shared_threads(library.members_of(messages(s, d))),
    "thread_access": lambda s, d: library.accessible(messages(s, d), library.members_of(messages(s, d)), _busiest(s, d)).select("id", "conversation_id"),
    "thread_history": lambda s, d: library.recent_history(messages(s, d)),
    "thread_leave": lambda s, d: library.without_empty_threads(messages(s, d), library.members_of(messages(s, d)).where(F.col("email") != _busiest(s, d))).select("id"),
    "folder_counts": lambda s, d: library.folder_counts(_folders(s, d), _jobs(s, d)),
    "folder_jobs": lambda s, d: library.jobs_in(_jobs(s, d), folder_id=_fullest(s, d)).select("job_id", "filename"),
    "root_jobs": lambda s, d: library.jobs_in(_jobs(s, d), root=True).select("job_id", "filename"),
    "delete_folder": lambda s, d: library.delete_folder(_folders(s, d), _jobs(s, d), _fullest(s, d))[1].select("job_id", "folder_id"),
    "set_folder": lambda s, d: library.set_folder(_jobs(s, d), _folders(s, d), _moves(s, d)).select("job_id", "folder_id"),
    "upsert_chunks": lambda s, d: library.upsert(
        chunks(s, d).select("chunk_id", F.substring(F.coalesce("text", F.lit("")), 1, 256).alias("text_preview"), F.lit(1).alias("version")),
        chunks(s, d).where("region_kind = 'table'").select("chunk_id", F.upper(F.substring(F.coalesce("text", F.lit("")), 1, 256)).alias("text_preview"), F.lit(2).alias("version")),
        "chunk_id",
    ),
    "email_prefix": lambda s, d: library.by_email_prefix(library.members_of(messages(s, d)).select("email").distinct(), "ke"),
    "email_normalize": lambda s, d: read(s, d, "mail_chunks").select("mail_id", T.normal_email(F.concat(F.lit("  "), F.upper("from_addr"), F.lit("\t"))).alias("from_email")).distinct(),
    "file_mentions": lambda s, d: library.mentioned_files(_mentioning(s, d), _jobs(s, d).select("job_id", F.element_at(F.split("filename", " "), -1).alias("filename"))),
    "citations_validate": lambda s, d: _replies(s, d).select("id", citations.validated(F.col("reply"), F.col("n")).alias("v")).select("id", F.col("v.cleaned").alias("cleaned"), F.array_join(F.col("v.cited").cast("array<string>"), ",").alias("cited"), F.array_join(F.col("v.invalid").cast("array<string>"), ",").alias("invalid")),
    "align_speakers": lambda s, d: media.align_speakers(segments(s, d).select("doc_id", "seq", "start", "end"), _speakers(s, d)).select("doc_id", "seq", "speaker", F.round("overlap", 3).alias("overlap")),
    "frame_sampling": lambda s, d: _frames(s, d).select("doc_id", F.col("frame_no").cast("long").alias("frame_no"), "timestamp"),
    "frames_in_chunks": lambda s, d: media.frames_in_chunks(_chunk_times(s, d), _frames(s, d)),
    "trailing_frames": lambda s, d: media.trailing_frames(_chunk_times(s, d), _frames(s, d)),
    "speaker_counts": lambda s, d: media.speaker_counts(segments(s, d)),
    "transcript_chunks": _bundled,
    "transcript_overlap": _overlapped,
    "transcript_texts": lambda s, d: media.chunk_texts(media.transcript_chunks(segments(s, d))),
    "transcript_nodes": lambda s, d: documents.media_nodes(media.chunk_texts(media.transcript_chunks(segments(s, d)))).select("doc_id", "node_id", "preceding_chunk_id", "following_chunk_id"),
    "visual_chunks": lambda s, d: media.visual_chunks(_described(s, d)).drop("speaker"),
    "citation_lists": lambda s, d: messages(s, d).select("id", F.posexplode(library.citation_list(F.col("citations"))).alias("no", "c")).select("id", F.col("no").cast("long").alias("no"), F.col("c.page").cast("long").alias("page"), F.col("c.title").alias("title")),
    "login_throttle": lambda s, d: throttle.refused(_events(s, d)).select("event_id", "refused"),
    "chunk_documents": lambda s, d: chunking.chunked(read(s, d, "documents")),
    "region_chunks": lambda s, d: chunking.region_chunks(read(s, d, "ocr_regions").dropDuplicates(["region_id"]), ["region_id", "doc_id", "page"]),
    "paginate_documents": lambda s, d: chunking.paginated(read(s, d, "documents")),
    "render_markdown": lambda s, d: render.markdown(chunks(s, d)),
    "render_filtered": _filtered,
}

_MEM = f"{MESSAGES_SQL}, mb as (select distinct conversation_id, lower(trim(sender_email)) as email from m where conversation_id is not null and sender_email is not null)"
_BUSY = "(select email from mb group by email order by count(*) desc, email limit 1)"
_SUM = "t as (select conversation_id, substring(regexp_replace(regexp_replace(coalesce(arg_max_null(content, id), ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'), 1, 120) as last_preview, arg_max_null(role, id) as last_role, count(*) as message_count, max(created_at) as updated_at from m where conversation_id is not null group by conversation_id)"
_JOBS = "j as (select doc_id as job_id, folder_id, title as filename, created_at as submitted_at from documents), f as (select distinct folder_id from j where folder_id is not null)"
_BUNDLED = f"""{SEGMENTS_SQL}, o as (select *, coalesce(n_tokens, 0) as n, row_number() over (partition by doc_id order by seq) as rn from s),
        r as (select doc_id, rn, 0 as chunk_no, case when n >= 384 then 1 else 0 end as next, case when n >= 384 then 0 else n end as held from o where rn = 1
          union all select doc_id, rn, c, c + case when h >= 384 then 1 else 0 end, case when h >= 384 then 0 else h end from (
            select o.doc_id, o.rn, r.next + case when r.held > 0 and r.held + o.n > 512 then 1 else 0 end as c, case when r.held > 0 and r.held + o.n > 512 then 0 else r.held end + o.n as h
            from r join o on o.doc_id = r.doc_id and o.rn = r.rn + 1)),
b as (select o.*, r.chunk_no from o join r on o.doc_id = r.doc_id and o.rn = r.rn)"""
_SAID = "said as (select doc_id, chunk_no, string_agg(t, chr(10) || chr(10) order by seq) as text from (select *, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from b) where t <> '' group by 1, 2)"
_FULL = "(select folder_id from j where folder_id is not null group by 1 order by count(*) desc, folder_id limit 1)"
_FRAMES = f"""{SEGMENTS_SQL}, du as (select doc_id, max(stop) + 45 as d from s group by doc_id),
st as (select doc_id, d, case when d <= 60 then 5.0 when d <= 300 then 10.0 else greatest(30.0, d / 20) end::double as k from du where d >= 0),
fr as (select doc_id, frame_no, round(frame_no * k, 3) as "timestamp" from (select doc_id, k, unnest(range(floor(d / k)::bigint + 1)) as frame_no from st))"""
_RENDERED = f"""with {CHUNKS_SQL}, p as (select *, coalesce(section_path, '') as sp, lag(coalesce(section_path, '')) over (partition by doc_id order by chunk_index, chunk_id) as before from c where text is not null),
        o as (select *, sum(case when sp = '' or before is null or before <> sp then 1 else 0 end) over (partition by doc_id order by chunk_index, chunk_id rows unbounded preceding) as child_no from p),
        s as (select doc_id, child_no, max(sp) <> '' as is_section, max(nullif(regexp_replace(sp, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')) as title,
          string_agg('<!-- chunk: ' || chunk_id || ', page: ' || coalesce(page::varchar, '?') || ' -->' || chr(10) || rtrim(regexp_replace(text, '(?m)[ \\t]+$', '', 'g')), chr(10) || chr(10) order by chunk_index, chunk_id) as part from o group by doc_id, child_no),
        b as (select *, case when is_section then '## ' || coalesce(title, '(unnamed section)') || chr(10) || chr(10) || part else part end as block from s),
        d as (select doc_id, string_agg(block, chr(10) || chr(10) order by child_no) as body, count(*) filter (where is_section) as n, first(title order by child_no) filter (where is_section) as head, list('- ' || coalesce(title, '(unnamed section)') order by child_no) filter (where is_section) as entries from b group by doc_id)
        select doc_id, '# ' || coalesce(head, 'Untitled document') || chr(10) || chr(10) || case when n > 0 then '**Contents:**' || chr(10) || chr(10) || array_to_string(entries[1:50] || case when n > 50 then ['- …(' || (n - 50) || ' more sections)'] else [] end, chr(10)) || chr(10) || '---' || chr(10) || chr(10) else '' end || body || chr(10) as markdown from d"""
_KINDS = "region_kind in ('table', 'heading')"
_EYEBROW = (
    "coalesce((select '*' || case when max(page) > 0 then 'pages: ' || max(page) || ' · ' else '' end || 'language: en*' || chr(10) || chr(10) from c where c.doc_id = d.doc_id), '')"
    f" || case when d.doc_id in (select doc_id from c where {_KINDS}) then '{render.banner('tables and headings').rstrip()}' || chr(10) || chr(10) else '' end"
)
_COUNT = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'))"
#: Stripped paragraphs in order, with their tokens.
_PARTS = (
    "p0 as (select {keys}, unnest(string_split_regex(coalesce(text, ''), '\\n\\s*\\n+')) as t, generate_subscripts(string_split_regex(coalesce(text, ''), '\\n\\s*\\n+'), 1) as i from {rows}),"
    " p1 as (select {keys}, i, regexp_replace(t, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as t from p0),"
    " parts as (select *, row_number() over (partition by {keys} order by i) as rn, " + _COUNT.format("t").replace("{", "{{").replace("}", "}}") + " as n from p1 where t <> '')"
)
#: Paragraphs bundled while they fit (no paragraph of these tables has more tokens than fit), and bundles led by the last 16 words before.
_BUNDLES = (
    "r as (select {keys}, rn, 0 as no, case when n >= {target} then 1 else 0 end as next, case when n >= {target} then 0 else n end as held from parts where rn = 1"
    " union all select {keys}, rn, c, c + case when h >= {target} then 1 else 0 end, case when h >= {target} then 0 else h end from ("
    "select parts.* exclude (rn), parts.rn, r.next + case when r.held > 0 and r.held + n > {most} then 1 else 0 end as c, case when r.held > 0 and r.held + n > {most} then 0 else r.held end + n as h"
    " from (select * from r) r(" + "{keys}" + ", rn0, no0, next, held) join parts using ({keys}) where parts.rn = rn0 + 1)),"
    " bundles as (select {keys}, no::int as no, string_agg(t, chr(10) || chr(10) order by rn) as text from parts join r using ({keys}, rn) group by {keys}, no),"
    " led as (select *, array_to_string((regexp_extract_all(lag(text) over (partition by {keys} order by no), '[^\\s\\p{{Z}}]+'))[-16:], ' ') as tail from bundles)"
)
_LED = f"case when tail like '% %' and {_COUNT.format('tail')} + {_COUNT.format('text')} <= 512 then tail || chr(10) || chr(10) || text else text end"
SQL = {
    "thread_summaries": f"with {MESSAGES_SQL}, {_SUM} select * from t",
    "thread_list": f"with {_MEM}, {_SUM}, me as (select {_BUSY} as e) select t.*, (select min(email) from mb p, me where p.conversation_id = t.conversation_id and p.email <> me.e) as peer_email from t where conversation_id in (select conversation_id from mb, me where mb.email = me.e)",
    "thread_members": f"with {_MEM} select * from mb",
    "thread_lookup": f"with {_MEM}, two as (select conversation_id, min(email) as email_a, max(email) as email_b from mb group by 1 having count(*) = 2) select email_a, email_b, min(conversation_id) as conversation_id from two group by 1, 2",
    "thread_access": f"with {_MEM} select id, conversation_id from m where conversation_id in (select conversation_id from mb where email = {_BUSY})",
    "thread_history": f"with {MESSAGES_SQL}, h as (select * from m where conversation_id is not null qualify row_number() over (partition by conversation_id order by id desc) <= 6) select conversation_id, id, role, substring(coalesce(content, ''), 1, 4000) as content from h where role in ('user', 'assistant')",
    "thread_leave": f"with {_MEM} select id from m where conversation_id in (select conversation_id from mb where email <> {_BUSY})",
    "folder_counts": f"with {_JOBS} select f.folder_id, count(j.job_id) as n_jobs from f left join j using (folder_id) group by 1",
    "folder_jobs": f"with {_JOBS} select job_id, filename from j where folder_id = {_FULL}",
    "root_jobs": f"with {_JOBS} select job_id, filename from j where folder_id is null",
    "delete_folder": f"with {_JOBS} select job_id, case when folder_id = {_FULL} then null else folder_id end as folder_id from j",
    "set_folder": f"with {_JOBS} select job_id, case when folder_id is null and job_id % 120 in (select folder_id from f) then job_id % 120 else folder_id end as folder_id from j",
    "upsert_chunks": f"with {CHUNKS_SQL} select chunk_id, case when region_kind = 'table' then upper(substring(coalesce(text, ''), 1, 256)) else substring(coalesce(text, ''), 1, 256) end as text_preview, case when region_kind = 'table' then 2 else 1 end as version from c",
    "email_prefix": f"with {_MEM} select distinct email from mb where email like 'ke%' order by email limit 8",
    "email_normalize": "select distinct mail_id, lower(trim(from_addr)) as from_email from mail_chunks",
    "file_mentions": f"with {MESSAGES_SQL}, n as (select lower(name) as name, min(doc_id) as job_id from (select doc_id, string_split(title, ' ')[-1] as name from documents) where name is not null group by 1) select distinct x.id, n.job_id from (select id, lower(unnest(regexp_extract_all(coalesce(content, ''), '(\\S+)', 1))) as name from m) x join n using (name)",
    "align_speakers": f"""with {SEGMENTS_SQL}, o as (select a.doc_id, a.seq, b.speaker, least(a.stop, b.stop + 1.5) - greatest(a.start, b.start + 1.5) as ov, b.seq as turn from s a join s b on a.doc_id = b.doc_id and b.start + 1.5 < a.stop and b.stop + 1.5 > a.start),
        best as (select * from o qualify row_number() over (partition by doc_id, seq order by ov desc, turn) = 1)
        select s.doc_id, s.seq, coalesce(best.speaker, 'UNKNOWN') as speaker, round(coalesce(ov, 0), 3) as overlap from s left join best on s.doc_id = best.doc_id and s.seq = best.seq""",
    "frame_sampling": f"with {_FRAMES} select * from fr",
    "frames_in_chunks": f'with {_FRAMES} select s.doc_id, s.seq as chunk_no, fr."timestamp" from s join fr on s.doc_id = fr.doc_id and fr."timestamp" between s.start and s.stop',
    "trailing_frames": f"""with {_FRAMES} select fr.doc_id, count(*) as n_frames, min("timestamp") as first, max("timestamp") as last, 'UNKNOWN' as speaker from fr join (select doc_id, max(stop) as stop from s group by 1) x on fr.doc_id = x.doc_id and fr."timestamp" > x.stop group by fr.doc_id""",
    "speaker_counts": f"with {SEGMENTS_SQL} select doc_id, count(distinct speaker) as n_speakers from s group by 1",
    "citations_validate": f"""with {MESSAGES_SQL}, r as (select id, content || ' ' || array_to_string(list_transform(regexp_extract_all(coalesce(citations, ''), '"page": ?(\\d+)', 1), lambda p: '[' || p || ']'), ' ') as reply from m where content is not null),
        f as (select *, list_transform(regexp_extract_all(reply, '(?:^|[^\\w\\]])\\[(\\d{{1,9}})\\]', 1), lambda x: x::bigint) as ns from r),
        g as (select *, list_distinct(list_filter(ns, lambda x: x < 1 or x > 15)) as bad from f)
        select id, case when len(bad) > 0 then regexp_replace(regexp_replace(regexp_replace(list_reduce(list_prepend(reply, list_transform(bad, lambda b: b::varchar)), lambda acc, b: regexp_replace(acc, '(^|[^\\w\\]])\\[' || b || '\\]', '\\1', 'g')), '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') else reply end as cleaned,
          array_to_string(list_transform(list_filter(ns, lambda x, i: x between 1 and 15 and list_position(ns, x) = i), lambda x: x::varchar), ',') as cited,
          array_to_string(list_transform(list_sort(bad), lambda x: x::varchar), ',') as invalid from g""",
    "region_chunks": f"with recursive rg as (select distinct on (region_id) * from ocr_regions), {_PARTS.format(rows='rg', keys='region_id, doc_id, page')}, {_BUNDLES.format(keys='region_id, doc_id, page', most=512, target=384)} select region_id, doc_id, page, no as chunk_index, text, {_COUNT.format('text')}::int as token_count from bundles",
    "chunk_documents": f"with recursive {_PARTS.format(rows='documents', keys='doc_id')}, {_BUNDLES.format(keys='doc_id', most=512, target=384)} select doc_id, no as chunk_index, {_LED} as text, {_COUNT.format(_LED)}::int as token_count from led",
    "paginate_documents": f"with recursive {_PARTS.format(rows='documents', keys='doc_id')}, {_BUNDLES.format(keys='doc_id', most=2000, target=1000000)} select doc_id, no as page, text, {_COUNT.format('text')}::int as token_count from bundles",
    "render_markdown": _RENDERED,
    "render_filtered": _RENDERED.replace("from o group by", f"from (select * from o where {_KINDS} or doc_id not in (select doc_id from c where {_KINDS})) group by")
    .replace("case when n > 0 then '**Contents:**'", f"{_EYEBROW} || case when n > 0 then '**Contents:**'"),
    "transcript_chunks": f"""with recursive {_BUNDLED},
        k as (select doc_id, chunk_no, speaker, count(*) as c, min(seq) as f from b group by doc_id, chunk_no, speaker qualify row_number() over (partition by doc_id, chunk_no order by c desc, f) = 1),
        g as (select doc_id, chunk_no, min(start) as start, max(stop) as "end", count(*) as n_segments, sum(n_tokens)::bigint as n_tokens from b group by all)
        select g.*, k.speaker from g join k on g.doc_id = k.doc_id and g.chunk_no = k.chunk_no""",
    "transcript_overlap": f"""with recursive {_BUNDLED},
        h as (select doc_id, chunk_no, sum(n) as held from b group by 1, 2), tl as (select * from b qualify row_number() over (partition by doc_id, chunk_no order by seq desc) = 1),
        x as (select doc_id, chunk_no, seq, start, stop, speaker, n_tokens from b
          union all select tl.doc_id, h.chunk_no, tl.seq, tl.start, tl.stop, tl.speaker, tl.n_tokens from tl join h on h.doc_id = tl.doc_id and h.chunk_no = tl.chunk_no + 1 where h.held + tl.n <= 512),
        k as (select doc_id, chunk_no, speaker, count(*) as c, min(seq) as f from x group by doc_id, chunk_no, speaker qualify row_number() over (partition by doc_id, chunk_no order by c desc, f) = 1),
        g as (select doc_id, chunk_no, min(start) as start, max(stop) as "end", count(*) as n_segments, sum(n_tokens)::bigint as n_tokens from x group by all)
        select g.*, k.speaker from g join k on g.doc_id = k.doc_id and g.chunk_no = k.chunk_no""",
    "transcript_texts": f"with recursive {_BUNDLED}, {_SAID} select doc_id, chunk_no, text from said",
    "transcript_nodes": f"""with recursive {_BUNDLED}, {_SAID}, n as (select doc_id, chunk_no, {node_id_sql("chunk", "'chunk|' || doc_id || '|' || chunk_no || '|' || substring(text, 1, 64)")} as node_id from said)
        select doc_id, node_id, lag(node_id) over w as preceding_chunk_id, lead(node_id) over w as following_chunk_id from n window w as (partition by doc_id order by chunk_no)""",
    "visual_chunks": f"""with recursive {SEGMENTS_SQL}, o as (select doc_id, start as ts, concat_ws(' ', seq::varchar, text) as line, coalesce(n_tokens, 0) * 4 as n, row_number() over (partition by doc_id order by start, concat_ws(' ', seq::varchar, text)) as rn from s where start is not null),
        r as (select doc_id, rn, 0 as chunk_no, case when n > 512 then 1 else 0 end as next, case when n > 512 then 0 else n end as held from o where rn = 1
          union all select doc_id, rn, c, c + case when n > 512 then 1 else 0 end, case when n > 512 then 0 else h + n end from (
            select o.doc_id, o.rn, o.n, r.next + case when r.held > 0 and r.held + o.n > 512 then 1 else 0 end as c, case when r.held > 0 and r.held + o.n > 512 then 0 else r.held end as h
            from r join o on o.doc_id = r.doc_id and o.rn = r.rn + 1))
        select o.doc_id, r.chunk_no, min(ts) as start, max(ts) as "end", count(*) as n_frames,
          string_agg('[Visual ' || (floor(ts)::int // 60) || ':' || lpad((floor(ts)::int % 60)::varchar, 2, '0') || '] ' || line, chr(10) || chr(10) order by o.rn) as text
        from o join r on o.doc_id = r.doc_id and o.rn = r.rn group by 1, 2""",
    "citation_lists": f"with {MESSAGES_SQL}, j as (select id, from_json(citations, '[{{\"title\":\"VARCHAR\",\"page\":\"BIGINT\"}}]') as c from m where citations is not null and json_valid(citations)) select id, i - 1 as no, c[i].page as page, c[i].title as title from (select id, c, unnest(range(1, len(c) + 1)) as i from j)",
    "login_throttle": """with recursive o as (select event_id, user_id, epoch_us(ts) / 1e6 as t, event_type <> 'purchase' as failed, row_number() over (partition by user_id order by epoch_us(ts) / 1e6, event_id) as rn from events where user_id is not null and ts is not null),
        r as (select event_id, user_id, rn, false as refused, case when failed then 1 else 0 end as c, t as b, 0::double as u from o where rn = 1
          union all select event_id, user_id, rn, no, case when no then c when not failed then 0 when k >= 5 then 0 else k end, case when no then b when not failed then t when k >= 5 then t when fresh then t else b end, case when no then u when failed and k >= 5 then t + 900 else 0 end from (
            select *, case when fresh then 1 else c + 1 end as k from (
              select o.event_id, o.user_id, o.rn, o.t, o.failed, r.c, r.b, r.u, o.t < r.u as no, r.c = 0 or o.t - r.b > 900 as fresh from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)))
        select event_id, refused from r""",
}
