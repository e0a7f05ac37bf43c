"""Search queries over chunks and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators import documents, enrich, intent, search, shred
from sheafline.plans.pages import ENTITY_SQL, RUNS_SQL, node_id_sql
from sheafline.plans.tables import CHUNKS_SQL, VECTORS_SQL, chunks, vectors

QUERY = "where is the frozen satellite survey of the harbour refund"
TOPIC_QUERY = "works of the institute in 1996 with samples and pages"
TOKENS = search.query_keywords(QUERY)
_WORDS = r"'\S+'"
_KEY = "'[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9]'"


def probe_vector(spark: SparkSession, folder: str) -> list[float]:
    """The usable vector with the least draft_id, as the query vector."""
    row = vectors(spark, folder).orderBy("draft_id").first()
    return [float(x) for x in row["embedding"]] if row else [1.0]


def bm25_sql(tokens: list[str], text: str, path: str, avg_words: str) -> str:
    norm = f"(0.25 + 0.75 * (greatest(1.0, len(regexp_extract_all({text}, {_WORDS}))::double) / greatest(1.0, {avg_words})))"
    parts = []
    for t in tokens:
        body, head = (f"((length({x}) - length(replace({x}, '{t}', ''))) / {len(t)}.0)::double" for x in (text, path))
        tf = f"({body} + {head})"
        parts.append(f"case when {tf} > 0 then {tf} * 2.2::double / ({tf} + 1.2::double * {norm}) + 0.30::double * {head} else 0 end")
    return " + ".join(parts)


_DOCS = f"""
w as (select doc_id, avg(len(regexp_extract_all(coalesce(text, ''), {_WORDS}))) as avg_words from c group by doc_id),
t as (select doc_id, coalesce(arg_min(trim(section_path), (chunk_index, chunk_id)) filter (where trim(section_path) <> ''), 'Untitled document') as title from c group by doc_id),
docs as (select w.doc_id, avg_words, title, len(list_intersect(regexp_extract_all(lower(title), {_KEY}), {TOKENS!r})) > 0 as title_match from w join t using (doc_id))
"""
_SCORED = f"""
with {CHUNKS_SQL}, {_DOCS},
s as (select c.*, docs.title, docs.title_match, {bm25_sql(TOKENS, "lower(coalesce(text, ''))", "lower(coalesce(section_path, ''))", "avg_words")} as content from c join docs using (doc_id))
"""
_SCORE = "round(content + case when title_match then 0.30 else 0 end, 6)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    return search.scored_passages(chunks(s, d), QUERY).select("doc_id", "chunk_id", "score", "title_match")


def _intent(s: SparkSession, d: str) -> DataFrame:
    return intent.matches(chunks(s, d), QUERY).select("doc_id", "chunk_id", "score", "score_kind")


def _vector_chunks(s: SparkSession, d: str) -> DataFrame:
    """The vectors as chunks without text or section."""
    none = F.lit(None).cast("string")
    return vectors(s, d).select("doc_id", F.col("draft_id").cast("string").alias("chunk_id"), F.col("draft_id").alias("chunk_index"), "page", none.alias("text"), none.alias("section_path"), "embedding")


def _topics(s: SparkSession, d: str) -> DataFrame:
    """The keywords of an intent that each document's topics hold."""
    top = enrich.topics(enrich.distinct_entities(enrich.entities(chunks(s, d))))
    each = top.groupBy("doc_id").agg(F.collect_list("topic").alias("topics"))
    hits = intent.topics_hit(TOPIC_QUERY, F.col("topics"))
    return each.select("doc_id", F.array_join(hits, ",").alias("hits"), intent.scoring(F.lit(False), hits).alias("scoring"))


def _read_back(docs: DataFrame) -> DataFrame:
    """The nodes of nested documents, as they are read from the JSON."""
    return shred.found(docs).select("doc_id", "node_id", "parent_id", "child_no")


def _dot(v: str) -> str:
    return f"list_dot_product({v}::double[], (select embedding from v order by draft_id limit 1)::double[])"


QUERIES = {
    "search_topk": lambda s, d: search.search(chunks(s, d), QUERY).select("doc_id", "doc_title", "chunk_id", "page", "score", "title_match"),
    "search_scores": _scored,
    "keyword_tokens": lambda s, d: chunks(s, d).select("chunk_id", F.explode(T.keywords(F.col("text"))).alias("keyword")),
    "avg_doc_length": lambda s, d: search.average_words(chunks(s, d)).select("doc_id", F.round("avg_words", 6).alias("avg_words")),
    "title_match": lambda s, d: search.doc_titles(chunks(s, d)).select("doc_id", "title", T.title_matches(TOKENS, F.col("title")).alias("title_match")),
    "cosine_topk": lambda s, d: search.cosine_top(vectors(s, d), probe_vector(s, d)).select("draft_id", F.round("score", 5).alias("score")),
    "cosine_topk_per_doc": lambda s, d: search.cosine_top(vectors(s, d), probe_vector(s, d), top_k=3, per="doc_id").select("doc_id", "draft_id", F.round("score", 5).alias("score")),
    "cosine_dynamic_floor": lambda s, d: search.dynamic_floor(search.cosine_top(vectors(s, d), probe_vector(s, d), per="doc_id")).select("doc_id", "draft_id", F.round("score", 5).alias("score")),
    "retrieve_floor": lambda s, d: search.retrieve(vectors(s, d).select("doc_id", F.col("draft_id").cast("string").alias("chunk_id"), F.col("draft_id").alias("chunk_index"), "page", F.lit("x").alias("text"), "embedding"), QUERY, probe_vector(s, d)).select("doc_id", "chunk_id", "page", "score"),
    "retrieve_text": lambda s, d: search.retrieve(chunks(s, d), QUERY, None).select("doc_id", "chunk_id", "score"),
    "mean_pool": lambda s, d: search.mean_pool(vectors(s, d)).select("doc_id", F.col("position").cast("long").alias("position"), "value"),
    "intent_matches": _intent,
    "intent_summary": lambda s, d: intent.summary(chunks(s, d), QUERY),
    "intent_tree": lambda s, d: intent.composed(chunks(s, d), QUERY).select("doc_id", F.col("child_no").cast("long").alias("child_no"), "chunk_id", "score", "score_kind", "no_match"),
    "intent_vectors": lambda s, d: intent.matches(_vector_chunks(s, d), QUERY, probe_vector(s, d)).select("doc_id", "chunk_id", "score", "score_kind", "selected_by"),
    "intent_topics": _topics,
    "intent_documents": lambda s, d: _read_back(intent.filtered_documents(chunks(s, d), QUERY)),
    "document_round_trip": lambda s, d: _read_back(documents.nested(chunks(s, d))),
}
_HIT = " or ".join("contains({0}, '%s')" % t for t in TOKENS)
_INTENT_SQL = f"""
with {CHUNKS_SQL}, {_DOCS},
s as (select c.doc_id, c.chunk_id, lower(coalesce(text, '')) as lo, lower(coalesce(section_path, '')) as sp, avg_words from c join docs using (doc_id)),
m as (select doc_id, chunk_id, round({bm25_sql(TOKENS, "lo", "sp", "avg_words")}, 4) as b from s where {_HIT.format("lo")} or {_HIT.format("sp")}),
k as (select doc_id, chunk_id, case when b > 0 then b end as score, case when b > 0 then 'bm25-lite' else 'section-lift' end as score_kind from m)
"""
_TREE = RUNS_SQL[len(CHUNKS_SQL) + 1 :].strip()
_KEPT = "kept as (select c.* from c left join k using (doc_id, chunk_id) left join (select distinct doc_id from k) y on y.doc_id = c.doc_id where y.doc_id is null or k.chunk_id is not null)"
_SECTION = node_id_sql("section", "'section|' || doc_id || '|' || child_no || '|' || sp")
#: Chunks below their sections, and sections and bare chunks below the root.
_NODES = f"""select doc_id, chunk_id as node_id, case when sp <> '' then {_SECTION} else doc_id end as parent_id,
  case when sp <> '' then row_number() over (partition by doc_id, child_no order by chunk_index, chunk_id) - 1 else child_no end as child_no from o
  union all select distinct doc_id, {_SECTION}, doc_id, child_no from o where sp <> ''"""
SQL = {
    "search_topk": f"{_SCORED} select doc_id, title as doc_title, chunk_id, page, {_SCORE} as score, title_match from s where content <> 0 or title_match order by score desc, doc_id, chunk_index, chunk_id limit 8",
    "search_scores": f"{_SCORED} select doc_id, chunk_id, {_SCORE} as score, title_match from s where content <> 0 or title_match",
    "keyword_tokens": f"with {CHUNKS_SQL} select distinct chunk_id, keyword from (select chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_KEY})) as keyword from c) where length(keyword) >= 2 and keyword not in {tuple(T.STOPWORDS)!r}",
    "avg_doc_length": f"with {CHUNKS_SQL}, {_DOCS} select doc_id, round(avg_words, 6) as avg_words from w",
    "title_match": f"with {CHUNKS_SQL}, {_DOCS} select doc_id, title, title_match from docs",
    "cosine_topk": f"with {VECTORS_SQL}, s as (select draft_id, {_dot('embedding')} as x from v) select draft_id, round(x, 5) as score from s order by x desc, draft_id limit 20",
    "cosine_topk_per_doc": f"with {VECTORS_SQL}, s as (select doc_id, draft_id, {_dot('embedding')} as x from v) select doc_id, draft_id, round(x, 5) as score from s qualify row_number() over (partition by doc_id order by x desc, draft_id) <= 3",
    "cosine_dynamic_floor": f"""with {VECTORS_SQL}, s as (select doc_id, draft_id, {_dot('embedding')} as x from v qualify row_number() over (partition by doc_id order by x desc, draft_id) <= 20)
        select doc_id, draft_id, round(x, 5) as score from s
        qualify x >= case when max(x) over (partition by doc_id) >= 0.20 then greatest(max(x) over (partition by doc_id) - 0.15, 0.05) else greatest(0.05, max(x) over (partition by doc_id)) end""",
    "retrieve_floor": f"with {VECTORS_SQL} select doc_id, draft_id::varchar as chunk_id, page, round({_dot('embedding')}, 4) as score from v where round({_dot('embedding')}, 4) >= 0.58 order by score desc, doc_id, draft_id limit 6",
    "retrieve_text": f"""with {CHUNKS_SQL}, r as (select * from c where trim(text) <> ''), p as (select avg(len(regexp_extract_all(text, {_WORDS}))) as avg_words from r),
        s as (select doc_id, chunk_id, chunk_index, round({bm25_sql(TOKENS, "lower(coalesce(text, ''))", "lower(coalesce(section_path, ''))", "avg_words")}, 4) as score from r, p)
        select doc_id, chunk_id, score from s where score > 0 order by score desc, doc_id, chunk_index limit 6""",
    "mean_pool": f"with {VECTORS_SQL}, f as (select doc_id, unnest(embedding::double[]) as value, unnest(range(len(embedding))) as position from v) select doc_id, position, round(avg(value), 6) + 0.0 as value from f group by doc_id, position",
    "intent_matches": f"{_INTENT_SQL} select * from k",
    "intent_summary": f"{_INTENT_SQL}, g as (select doc_id, count(*) as n, max(score) as best from k group by doc_id) select c.doc_id, count(*) as total_chunks, coalesce(any_value(n), 1) as matched_chunks, any_value(best) as best, any_value(n) is null as no_match from c left join g using (doc_id) group by c.doc_id",
    "intent_tree": f"""{_INTENT_SQL}, {_TREE}
        select o.doc_id, o.child_no, o.chunk_id, k.score, case when y.doc_id is null then 'no_match_fallback' else k.score_kind end as score_kind, y.doc_id is null as no_match
        from o left join k using (doc_id, chunk_id) left join (select distinct doc_id from k) y on y.doc_id = o.doc_id where y.doc_id is null or k.chunk_id is not null""",
    "intent_vectors": f"""with {VECTORS_SQL}, s as (select doc_id, draft_id, {_dot('embedding')} as x from v qualify row_number() over (partition by doc_id order by x desc, draft_id) <= 20),
        b as (select doc_id, draft_id, x from s qualify x >= case when max(x) over (partition by doc_id) >= 0.20 then greatest(max(x) over (partition by doc_id) - 0.15, 0.05) else greatest(0.05, max(x) over (partition by doc_id)) end),
        n as (select doc_id, draft_id, lag(draft_id) over w as p, lead(draft_id) over w as q from v window w as (partition by doc_id order by draft_id)),
        near as (select distinct doc_id, unnest([p, q]) as draft_id from n semi join b on b.doc_id = n.doc_id and b.draft_id = n.draft_id)
        select doc_id, draft_id::varchar as chunk_id, round(x, 4) as score, 'cosine' as score_kind, 'cosine' as selected_by from b
        union all select doc_id, draft_id::varchar, null, 'selected', 'neighbour' from near where draft_id is not null and not exists (from b where b.doc_id = near.doc_id and b.draft_id = near.draft_id)""",
    "intent_topics": f"""with {ENTITY_SQL}, t as (select doc_id, lower(trim(text)) as topic, count(*) as n_types, min((chunk_id, pos)) as seen from u group by 1, 2 qualify row_number() over (partition by doc_id order by n_types desc, seen, topic) <= 5),
        w as (select distinct doc_id, unnest(regexp_extract_all(topic, '[a-z0-9][a-z0-9-]*')) as w from t),
        q as (select unnest({[x for x in search.query_keywords(TOPIC_QUERY) if len(x) >= 3]!r}) as kw, generate_subscripts({[x for x in search.query_keywords(TOPIC_QUERY) if len(x) >= 3]!r}, 1) as i),
        h as (select distinct doc_id, kw, i from w join q on length(w) >= 2 and (w = kw or length(w) >= 4 and (starts_with(w, kw) or ends_with(w, kw))))
        select d.doc_id, coalesce(string_agg(kw, ',' order by i), '') as hits, case when count(kw) > 0 then 'keyword+topic-widen' else 'keyword' end as scoring from (select distinct doc_id from t) d left join h using (doc_id) group by 1""",
    "intent_documents": f"""{_INTENT_SQL}, {_KEPT}, {_TREE.replace("from c)", "from kept)")} {_NODES}""",
    "document_round_trip": f"with {RUNS_SQL} {_NODES}",
}
