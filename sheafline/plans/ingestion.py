"""Queries over raw documents, mails and extractor output, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline import hooks
from sheafline.functions import text as T
from sheafline.operators import extract, library
from sheafline.plans.tables import CHUNKS_SQL, MESSAGES_SQL, REGIONS_SQL, WORDS_SQL, chunks, messages, regions, words
from sheafline.session import read
from sheafline.sources.files import mail_parts


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    """Documents that parse, once each, with title and language; F.try_parse_json tells what is complete."""
    raw = read(s, d, "uir_raw").where(F.try_parse_json("payload").isNotNull())
    one = raw.groupBy("doc_id").agg(F.min_by("payload", F.length("payload")).alias("payload"))
    title = F.get_json_object("payload", "$.metadata.title")
    return one.select("doc_id", F.coalesce(T.none_if_blank(title), F.lit("Untitled document")).alias("title"), F.coalesce(F.get_json_object("payload", "$.metadata.language"), F.lit("en")).alias("language"))


def _mail_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Mails written as messages and read again: the mail lane over the given rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email.message import EmailMessage

        for pdf in batches:
            rows = []
            for i, subject, sender, text in zip(pdf["mail_id"], pdf["subject"], pdf["from_addr"], pdf["text"]):
                m = EmailMessage()
                m["Subject"], m["From"] = subject or "", sender or ""
                m.set_content(text or "")
                p = mail_parts(bytes(m))
                rows.append((i, p["subject"], p["from"], len(p["text"].split())))
            yield pd.DataFrame(rows, columns=["mail_id", "subject", "sender", "n_words"])

    return read(s, d, "mail_chunks").select("mail_id", "subject", "from_addr", "text").mapInPandas(run, "mail_id long, subject string, sender string, n_words long").distinct()


def _tables(s: SparkSession, d: str) -> DataFrame:
    t = chunks(s, d).where("region_kind = 'table'")
    return extract.distinct_tables(t.select("doc_id", "page", F.col("text").alias("markdown"), "chunk_index", "chunk_id"), ["chunk_index", "chunk_id"]).select("chunk_id", "page")


def _drafts(s: SparkSession, d: str) -> DataFrame:
    """Regions of chunks: tables as tables, headings as captions of figures."""
    r = chunks(s, d).select("doc_id", F.col("chunk_index").alias("ord"), F.col("region_kind").alias("label"), "text")
    t = r.where("label = 'table'").select("doc_id", "ord", F.col("text").alias("markdown"))
    c = r.where("label = 'heading'").select("doc_id", "ord", F.col("text").alias("caption"))
    return extract.document_chunks(r.where("label is null or label not in ('table', 'heading')"), t, c).select("doc_id", "src_rank", "ord", "region_kind", "text")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    e = hooks.embedded(chunks(s, d).select("chunk_id", "text"), dim=64)
    return e.select("chunk_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


QUERIES = {
    "document_envelopes": _envelopes,
    "mail_round_trip": _mail_round_trip,
    "region_labels": lambda s, d: regions(s, d).select("region_id", extract.region_label(F.col("label")).alias("label")),
    "label_counts": lambda s, d: regions(s, d).groupBy(extract.region_label(F.col("label")).alias("label")).agg(F.count("*").alias("n"), F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "").alias("n_empty")),
    "table_dedupe": _tables,
    "scanned_documents": lambda s, d: extract.scanned(regions(s, d)),
    "clean_words": lambda s, d: extract.clean_words(words(s, d)).select("word_id", F.round("confidence", 6).alias("confidence")),
    "document_drafts": _drafts,
    "embedded_chunks": _embedded,
    "command_questions": lambda s, d: messages(s, d).select("id", library.command_question(F.col("content")).alias("question")).where("question is not null"),
    "without_mentions": lambda s, d: messages(s, d).where("content is not null").select("id", library.without_mentions(F.col("content")).alias("content")),
}
SQL = {
    "mail_round_trip": "select distinct mail_id, coalesce(subject, '') as subject, coalesce(from_addr, '') as sender, len(regexp_extract_all(coalesce(text, ''), '\\S+')) as n_words from mail_chunks",
    "document_envelopes": "with p as (select distinct on (doc_id) doc_id, payload::json as j from uir_raw where json_valid(payload)) select doc_id, coalesce(nullif(trim(j->>'$.metadata.title'), ''), 'Untitled document') as title, coalesce(j->>'$.metadata.language', 'en') as language from p",
    "region_labels": f"with {REGIONS_SQL} select region_id, case lower(trim(label)) " + " ".join(f"when '{k}' then '{v}'" for k, v in extract.LABELS.items()) + " else 'paragraph' end as label from r",
    "label_counts": f"with {REGIONS_SQL} select case lower(trim(label)) " + " ".join(f"when '{k}' then '{v}'" for k, v in extract.LABELS.items()) + " else 'paragraph' end as label, count(*) as n, count_if(trim(coalesce(text, '')) = '')::bigint as n_empty from r group by 1",
    "table_dedupe": f"with {CHUNKS_SQL} select chunk_id, page from c where region_kind = 'table' qualify row_number() over (partition by doc_id, page, substring(coalesce(text, ''), 1, 120) order by chunk_index, chunk_id) = 1",
    "scanned_documents": f"with {REGIONS_SQL} select doc_id, sum(length(coalesce(text, '')))::bigint as n_chars, count(distinct page) as n_pages, sum(length(coalesce(text, ''))) / greatest(count(distinct page), 1) < 50 as looks_scanned from r group by 1",
    "clean_words": f"with {WORDS_SQL} select word_id, round(least(1.0, case when coalesce(confidence, 0) > 1 then confidence / 100 else coalesce(confidence, 0) end), 6) as confidence from w where trim(text) <> '' and coalesce(confidence, 0) >= 0",
    "document_drafts": f"with {CHUNKS_SQL} select doc_id, case region_kind when 'table' then 1 when 'heading' then 2 else 0 end as src_rank, chunk_index as ord, case region_kind when 'heading' then 'figure' else region_kind end as region_kind, text from c where length(trim(text)) >= 4",
    "embedded_chunks": f"with {CHUNKS_SQL} select chunk_id, 64::bigint as dim, case when regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]') then 1.0 else 0.0 end::double as norm from c",
    "command_questions": f"with {MESSAGES_SQL} select id, trim(substring(trim(content), 11)) as question from m where starts_with(lower(trim(content)), '@fireworks')",
    "without_mentions": f"with {MESSAGES_SQL} select id, trim(regexp_replace(regexp_replace(content, '@\\S+', '', 'g'), '\\s{{2,}}', ' ', 'g')) as content from m where content is not null",
}
