"""Threads, folders and jobs: the relational queries and their changes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T


def threads_of(messages: DataFrame, members: DataFrame, email: str) -> DataFrame:
    """The threads of a member: conversation_id, peer_email, last_content, last_role, message_count, updated_at.

    The preview is the last message by id; the peer the least other member. Latest first.
    """
    email = email.strip().lower()
    m = members.withColumn("email", T.normal_email(F.col("email")))
    mine = m.where(F.col("email") == email).select("conversation_id").distinct()
    peers = m.where(F.col("email") != email).groupBy("conversation_id").agg(F.min("email").alias("peer_email"))
    return mine.join(thread_summaries(messages), "conversation_id").join(peers, "conversation_id", "left").orderBy(F.desc("updated_at"), F.desc("conversation_id"))


def thread_summaries(messages: DataFrame) -> DataFrame:
    """conversation_id, last_preview, last_role, message_count, updated_at; counts combine before the shuffle."""
    g = messages.where("conversation_id is not null").groupBy("conversation_id").agg(F.max_by(F.struct("content", "role"), "id").alias("last"), F.count("*").alias("message_count"), F.max("created_at").alias("updated_at"))
    return g.select("conversation_id", T.preview(F.col("last.content")).alias("last_preview"), F.col("last.role").alias("last_role"), "message_count", "updated_at")


def members_of(messages: DataFrame) -> DataFrame:
    """conversation_id and email of everyone who wrote in a thread."""
    return messages.where("conversation_id is not null and sender_email is not null").select("conversation_id", T.normal_email(F.col("sender_email")).alias("email")).distinct()


def shared_threads(members: DataFrame) -> DataFrame:
    """Threads of exactly two members, the earliest for each two: email_a, email_b, conversation_id."""
    two = members.groupBy("conversation_id").agg(F.count("*").alias("n"), F.min("email").alias("email_a"), F.max("email").alias("email_b")).where("n = 2")
    return two.groupBy("email_a", "email_b").agg(F.min("conversation_id").alias("conversation_id"))


def accessible(messages: DataFrame, members: DataFrame, email: str) -> DataFrame:
    """Messages of the threads that someone is a member of, by id."""
    mine = members.where(T.normal_email(F.col("email")) == email.strip().lower()).select("conversation_id").distinct()
    return messages.join(mine, "conversation_id", "left_semi").orderBy("id")


def recent_history(messages: DataFrame, turns: int = 6, chars: int = 4000) -> DataFrame:
    """The last ``turns`` messages of each thread, of these the user's and assistant's, contents cut to ``chars``."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    last = messages.where("conversation_id is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= turns)
    return last.where(F.col("role").isin("user", "assistant")).select("conversation_id", "id", "role", F.substring(F.coalesce("content", F.lit("")), 1, chars).alias("content"))


def leave(members: DataFrame, conversation_id: int, email: str) -> DataFrame:
    """The members after someone left a thread; a thread without members has no rows."""
    gone = (F.col("conversation_id") == conversation_id) & (T.normal_email(F.col("email")) == email.strip().lower())
    return members.where(~F.coalesce(gone, F.lit(False)))


def without_empty_threads(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Messages of the threads that still have a member."""
    return messages.join(members.select("conversation_id").distinct(), "conversation_id", "left_semi")


def folder_counts(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders with their number of jobs, 0 for empty ones."""
    n = jobs.where("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("n_jobs"))
    return folders.join(n, "folder_id", "left").withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)))


def jobs_in(jobs: DataFrame, folder_id: int | None = None, root: bool = False, ids: list | None = None) -> DataFrame:
    """Jobs of a folder, or of none (``root``), or all; and of a list of ids if given. Filters reach the scan."""
    out = jobs
    if root:
        out = out.where(F.col("folder_id").isNull())
    elif folder_id is not None:
        out = out.where(F.col("folder_id") == folder_id)
    return out if ids is None else out.where(F.col("job_id").isin(ids))


def delete_folder(folders: DataFrame, jobs: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    """Folders without one, and jobs with its jobs in none."""
    hit = F.coalesce(F.col("folder_id") == folder_id, F.lit(False))
    return folders.where(~hit), jobs.withColumn("folder_id", F.when(~hit, F.col("folder_id")))


def set_folder(jobs: DataFrame, folders: DataFrame, moves: DataFrame) -> DataFrame:
    """Jobs with the folders that ``moves`` (job_id, to_folder) gives them; moves to folders that don't exist are left out."""
    ok = moves.join(folders.select(F.col("folder_id").alias("to_folder")), "to_folder", "left_semi")
    return jobs.join(ok.select("job_id", "to_folder"), "job_id", "left").withColumn("folder_id", F.coalesce("to_folder", "folder_id")).drop("to_folder")


def upsert(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key: the changed rows, and the existing ones without a change."""
    return existing.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def by_email_prefix(users: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Users whose e-mail begins with the prefix (two characters at least), in order. LIKE signs in the prefix work as such."""
    p = (prefix or "").strip().lower()
    if len(p) < 2:
        return users.limit(0)
    return users.where(F.lower("email").like(p + "%")).orderBy("email").limit(max(1, limit))


def mentioned_files(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """id and job_id of the files that a message mentions as @name, whatever the case; the first job of a name counts."""
    named = jobs.where("filename is not null").groupBy(F.lower("filename").alias("name")).agg(F.min("job_id").alias("job_id"))
    said = messages.select("id", F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"@(\S+)"), 1)).alias("m")).select("id", F.lower("m").alias("name"))
    return said.join(named, "name").select("id", "job_id").distinct()


def visible(jobs: DataFrame, status: Column) -> DataFrame:
    """Jobs that can be searched: done, with a document."""
    return jobs.where((status == "done") & F.col("document_path").isNotNull())


def add_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and conversations with updated_at of their latest; contents are cut to 8000 characters."""
    fresh = new.withColumn("content", F.substring("content", 1, 8000))
    last = fresh.groupBy("conversation_id").agg(F.max("created_at").alias("_at"))
    bumped = conversations.join(last, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("_at", "updated_at"))).drop("_at")
    return bumped, messages.unionByName(fresh, allowMissingColumns=True)


def command_question(content: Column, command: str = "@fireworks") -> Column:
    """What follows the command at the start of a message, whatever its case; null if it isn't one."""
    q = T.strip(F.regexp_extract(T.strip(content), rf"(?is)^\Q{command}\E(?:\s+(.*))?$", 1))
    return F.when(F.lower(T.strip(content)).startswith(command.lower()), q)


def without_mentions(content: Column) -> Column:
    """The text without @names, white space collapsed."""
    return T.strip(F.regexp_replace(F.regexp_replace(content, r"@\S+", ""), r"\s{2,}", " "))


def public_fields(meta: Column, allowed: list[str]) -> Column:
    """A map with the allowed keys only."""
    return F.map_filter(meta, lambda k, v: k.isin(allowed))


def endpoint(url: Column) -> Column:
    """struct(host, port, secure) of a service address; the port by scheme where none is given."""
    secure = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False))
    authority = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    return F.struct(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("localhost")).alias("host"), F.when(port != "", port.try_cast("int")).otherwise(F.when(secure, 443).otherwise(80)).alias("port"), secure.alias("secure"))


def renamed_folder(folders: DataFrame, folder_id: int, name: str) -> DataFrame:
    """The folders, one of them under another name (a ``name`` column is added where there is none)."""
    old = F.col("name") if "name" in folders.columns else F.lit(None).cast("string")
    return folders.withColumn("name", F.when(F.col("folder_id") == folder_id, F.lit(name)).otherwise(old))


def without_jobs(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """The jobs that ``gone`` (job_id) doesn't name."""
    return jobs.join(gone.select("job_id").distinct(), "job_id", "left_anti")


def citation_list(citations: Column) -> Column:
    """Stored citations as an array of (title, page, chunk_id); null, blank and broken JSON as an empty one."""
    return F.coalesce(F.from_json(citations, "array<struct<title: string, page: int, chunk_id: string>>"), F.array().cast("array<struct<title: string, page: int, chunk_id: string>>"))


def with_registered_peer(threads: DataFrame, users: DataFrame) -> DataFrame:
    """Threads with ``peer_registered``: whether their peer_email is a user's."""
    known = users.select(T.normal_email(F.col("email")).alias("peer_email")).distinct().withColumn("_known", F.lit(True))
    return threads.join(known, "peer_email", "left").withColumn("peer_registered", F.coalesce("_known", F.lit(False))).drop("_known")


def jobs_asked(job_ids: Column, mentioned: Column) -> Column:
    """The jobs that a question names and mentions, each once."""
    return F.array_union(F.coalesce(job_ids, F.array().cast("array<bigint>")), F.coalesce(mentioned, F.array().cast("array<bigint>")))
