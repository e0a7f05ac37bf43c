"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import conversations, emails, knn, leaks, lookalike, mixture, neardup, ocr, transcripts
from sheafline.session import read

P3_SQL = r"""
with once as (select distinct on (id) * from conversation_messages where id is not null and conversation_id is not null),
m as (
  select conversation_id, id,
    case when created_at > 1e14 then created_at / 1e6 when created_at > 1e11 then created_at / 1e3 else created_at end as at_s,
    case when lower(trim(role)) in ('user','human','member') then 'user'
         when lower(trim(role)) in ('assistant','bot','fireworks') then 'assistant' end as side, content
  from once),
p as (select *, row_number() over (partition by conversation_id order by at_s nulls first, id) as turn from m),
ok as (
  select conversation_id from p group by conversation_id
  having count(*) % 2 = 0
     and count_if(at_s is null or side is null or not coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false)
                  or side <> case when turn % 2 = 1 then 'user' else 'assistant' end) = 0)
select conversation_id, turn, id as message_id from p semi join ok using (conversation_id)
"""

P1_SQL = r"""
with once as (select distinct on (chunk_id) chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks where text is not null),
s as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select chunk_id, w, unnest(range(1, len(w) - 1)) as i from once where len(w) >= 20)),
n as (select chunk_id, count(*) as n from s group by 1),
m as (select a.chunk_id as chunk_a, b.chunk_id as chunk_b, count(*) as c from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select chunk_a, chunk_b from m join n x on x.chunk_id = chunk_a join n y on y.chunk_id = chunk_b where 2.0 * c / (x.n + y.n) >= 0.5
"""

P2_SQL = """
with v as (select distinct on (draft_id) draft_id as id, modal_features.vector.embedding::double[] as e from vector_drafts
  where modal_features.vector.dim = 64 and len(modal_features.vector.embedding) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x is not null and isfinite(x))) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x <> 0)) > 0),
s as (select a.id as q, b.id as t, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.id <> b.id),
k as (select q, t, c from s where c >= 0.9 qualify row_number() over (partition by q order by round(c, 12) desc, t) <= 10)
select distinct least(q, t) as draft_a, greatest(q, t) as draft_b from k where c >= 0.94
"""


P1_GROUPS_SQL = r"""
with w as (select doc_id as key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
s as (select distinct key, list_aggregate(w[i:i + 4], 'string_agg', ' ') as g from (select key, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
c as (select key, min(key) over (partition by gs) as class, n from (select key, list_sort(list(g)) as gs, count(*) as n from s group by 1)),
r as (select class, any_value(n) as n from c group by 1),
sr as (select key, g from s where key in (select class from r)),
m as (select a.key as x, b.key as y, count(*) as n_both from sr a join sr b on a.g = b.g and a.key < b.key group by 1, 2),
l as (select x, y from m join r p on p.class = x join r q on q.class = y where n_both / (p.n + q.n - n_both) >= 0.8),
e as (select class, count(*) as n_links from (select x as class from l union all select y from l) group by 1)
select key, class, coalesce(n_links, 0) as n_links from c left join e using (class)
"""

P2_MOST_SQL = """
with v as (select distinct on (draft_id) draft_id as id, modal_features.vector.embedding::double[] as e from vector_drafts
  where modal_features.vector.dim = 64 and len(modal_features.vector.embedding) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x is not null and isfinite(x))) = 64
    and len(list_filter(modal_features.vector.embedding, lambda x: x <> 0)) > 0),
s as (select a.id as query, b.id as neighbour, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.id <> b.id where a.id % 20 = 0)
select query, neighbour, row_number() over (partition by query order by round(c, 12) desc, neighbour) as rank, round(c, 6) as similarity
from s qualify rank <= 10
"""


def _mapped_sql(text: str) -> str:
    """``lookalike.one_form`` in SQL, but for controls and line ends."""
    table = lookalike.letter_table()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({text}, {quote(''.join(table) + lookalike.INVISIBLE)}, {quote(''.join(table.values()))})"
    for joined, letters in lookalike.JOINED.items():
        out = f"replace({out}, '{joined}', '{letters}')"
    return f"translate({out}, {quote(lookalike.BLANKS)}, {quote(' ' * len(lookalike.BLANKS))})"


def _one_form_sql(text: str) -> str:
    """The same with composed accents."""
    return f"nfc_normalize({_mapped_sql(text)})"


def _p10_canonical_sql() -> str:
    clean = rf"regexp_replace(regexp_replace({_mapped_sql('text')}, '\r\n?|[\x{{2028}}\x{{2029}}\x{{85}}]', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')"
    return rf"""with k as (select doc_id, text, {clean} as form, coalesce(regexp_matches(text, '[^\s\p{{Z}}\p{{Cf}}]'), false) as shows from documents),
        g as (select nfc_normalize(form) as look, arg_min({{'id': doc_id, 'form': form}}, (form <> text, strlen(text), doc_id)) as best from k where shows group by 1 having count(distinct text) > 1)
        select doc_id, coalesce(g.best.id, doc_id) as class_id, coalesce(g.best.form, form) as canonical_text, coalesce(coalesce(g.best.form, form) <> text, false) as changed
        from k left join g on shows and nfc_normalize(form) = look"""


def _p4_sql() -> str:
    """The stated rule of turns. Looking ahead is written as reading on, and phrases in a row are met by a second pass."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    label = transcripts.LABEL.replace(r"-(?=\s)", r"-\s").replace(r"(?=\s|$)", r"(?:\s|$)")
    body = "line"
    for pattern in (transcripts._TIMING, label, transcripts._MARK, transcripts._NOTE):
        body = f"regexp_replace({body}, {quote(pattern)}, ' ', 'g')"
    phrase = quote(r"(?i)(^|[^\p{L}\p{N}])(?:you know|i mean)(?:[,.…]+|([^\p{L}\p{N}'’,.…-])|$)")
    body = f"regexp_replace(regexp_replace({body}, {phrase}, '\\1 \\2', 'g'), {phrase}, '\\1 \\2', 'g')"
    given = quote(r"(?i)^\s*(?:speaker|spkr|spk|s)?[\s_.\-#]*0*(\d{1,3})\s*$")
    return f"""with once as (select distinct on (draft_id) draft_id, doc_id, coalesce(text, '') as text, coalesce(modal_features.audio_segment.start_s, 'inf'::double) as begin_s, modal_features.audio_segment.speaker as given from transcript_drafts where draft_id is not null),
        ln as (select draft_id, doc_id, begin_s, given, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select *, string_split_regex(text, '\\r\\n|\\n|\\r') as ls from once)),
        lb as (select *, nullif(regexp_extract(line, {quote(label)}, 1), '')::int as own, nullif(regexp_extract(given, {given}, 1), '')::int as given_no,
          case when regexp_matches(line, {quote(transcripts._CUE)}) then 0 else len(list_filter(string_split_regex({body}, '[\\s\\p{{Z}}]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') and not regexp_matches(x, {quote(transcripts.HESITATION)}))) end as n from ln),
        sp as (select *, coalesce(last_value(own ignore nulls) over (partition by draft_id order by line_no rows unbounded preceding), given_no) as who from lb),
        nm as (select doc_id, begin_s, draft_id, line_no, n, case when who is null then 'UNKNOWN' else 'SPEAKER_' || case when who < 10 then '0' else '' end || who end as speaker from sp where n > 0),
        nw as (select *, case when speaker is distinct from lag(speaker) over (partition by doc_id order by begin_s, draft_id, line_no) then 1 else 0 end as opens from nm),
        tn as (select *, sum(opens) over (partition by doc_id order by begin_s, draft_id, line_no rows unbounded preceding)::bigint as turn from nw)
        select doc_id, turn, any_value(speaker) as speaker, sum(n)::bigint as n_words from tn group by doc_id, turn"""


def _p8_sql() -> str:
    grams = "select {0}, list_aggregate(w[i:i + 19], 'string_agg', ' ') as g from (select {0}, w, unnest(range(1, len(w) - 18)) as i from {1} where len(w) >= 20)"
    words = "(select {0}, regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{N}}]+') as w from {2} where text is not null)"
    form = _one_form_sql("regexp_replace(text, '</?[A-Za-z][^<>\\n]*>', ' ', 'g')")
    docs, items = words.format("doc_id", form, "documents"), words.format("item_id", form, "eval_items")
    return f"with a as ({grams.format('doc_id', docs)}), b as ({grams.format('item_id', items)}) select distinct doc_id, item_id from a join b using (g)"


def _p10_sql() -> str:
    return f"""with k as (select doc_id, text, {_one_form_sql('text')} as look from documents where regexp_matches(text, '[^\\s\\p{{Z}}\\p{{Cf}}]'))
        select a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: neardup.found(read(s, d, "chunks")),
        "p1_groups": lambda s, d: neardup.groups(read(s, d, "documents"), "doc_id", "text"),
        "p2_found": lambda s, d: knn.found(read(s, d, "vector_drafts")),
        "p2_most_similar": lambda s, d: knn.most_similar(read(s, d, "vector_drafts")),
        "p3_found": lambda s, d: conversations.found(read(s, d, "conversation_messages")),
        "p3_conversations": lambda s, d: conversations.conversations(read(s, d, "conversation_messages")),
        "p3_threads": lambda s, d: conversations.threads(read(s, d, "conversation_messages"), F.coalesce(F.col("conversation_id").cast("string"), F.col("sender_email"))),
        "p4_found": lambda s, d: transcripts.found(read(s, d, "transcript_drafts")),
        "p4_turns": lambda s, d: transcripts.turns(read(s, d, "transcript_drafts")),
        "p6_found": lambda s, d: emails.found(read(s, d, "mail_chunks")),
        "p7_found": lambda s, d: ocr.found(read(s, d, "ocr_words"), read(s, d, "known_words")),
        "p7_paragraphs": lambda s, d: ocr.repaired_paragraphs(read(s, d, "ocr_regions"), read(s, d, "known_words")),
        "p8_found": lambda s, d: leaks.found(read(s, d, "documents"), read(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leaks.leaks(read(s, d, "documents"), read(s, d, "eval_items")),
        "p9_mixture": lambda s, d: mixture.mixture(read(s, d, "documents"), read(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixture.shares(mixture.mixture(read(s, d, "documents"), read(s, d, "mix_targets")), read(s, d, "mix_targets")),
        "p10_found": lambda s, d: lookalike.found(read(s, d, "documents")),
        "p10_canonical": lambda s, d: lookalike.canonical(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p1_groups": P1_GROUPS_SQL,
        "p2_found": P2_SQL,
        "p2_most_similar": P2_MOST_SQL,
        "p3_found": P3_SQL,
        "p4_found": _p4_sql(),
        "p8_found": _p8_sql(),
        "p10_found": _p10_sql(),
        "p10_canonical": _p10_canonical_sql(),
    }
