"""Annotations, collections, chat threads and sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import ANNOTATION, COLLECTION, conform

# What annotations may be.
TYPES = ("highlight", "bookmark", "note", "tag")
COLORS = ("yellow", "green", "blue", "red", "purple", "orange")


class AnnotationError(ValueError):
    """An annotation that breaks a rule."""


def check(annotation: dict) -> dict:
    """The annotation, if its type, color and target are valid."""
    if annotation.get("type") not in TYPES:
        raise AnnotationError(f"type must be one of {TYPES}")
    if annotation.get("color") is not None and annotation["color"] not in COLORS:
        raise AnnotationError(f"color must be one of {COLORS}")
    target = annotation.get("target") or {}
    need = {"file": "file_path", "node": "node_id"}.get(target.get("type"))
    if need is None or not target.get(need):
        raise AnnotationError("target must be a file with file_path or a node with node_id")
    return annotation


def add(notes: DataFrame, new: list[dict]) -> DataFrame:
    made = notes.sparkSession.createDataFrame([check(a) for a in new], ANNOTATION)
    return conform(notes, ANNOTATION).unionByName(made)


def update(notes: DataFrame, note_id: str, changes: dict, now: datetime) -> DataFrame:
    mine = F.col("id") == note_id
    out = notes
    for name, value in {**changes, "last_modified_at": now}.items():
        kind = ANNOTATION[name].dataType
        v = F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)
        out = out.withColumn(name, F.when(mine, v.cast(kind)).otherwise(F.col(name)))
    return out


def delete(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") != note_id)


def by_type(notes: DataFrame, kind: str) -> DataFrame:
    return notes.where(F.col("type") == kind)


def by_target(notes: DataFrame, file_path: str | None = None, node_id: str | None = None) -> DataFrame:
    out = notes.where(F.col("target.file_path") == file_path) if file_path else notes
    return out.where(F.col("target.node_id") == node_id) if node_id else out


def by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag))


def latest(notes: DataFrame, limit: int = 25) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), "id").limit(limit)


def without_member(collections: DataFrame, note_id: str) -> DataFrame:
    """Collections without a deleted annotation."""
    return collections.withColumn("annotation_ids", F.filter("annotation_ids", lambda x: x != note_id))


def new_collection(collections: DataFrame, collection_id: str, name: str, members: list[str], now: datetime) -> DataFrame:
    made = collections.sparkSession.createDataFrame([(collection_id, name, members, now)], COLLECTION)
    return conform(collections, COLLECTION).unionByName(made)


def delete_collection(collections: DataFrame, collection_id: str) -> DataFrame:
    return collections.where(F.col("id") != collection_id)


def retarget(notes: DataFrame, moves: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after files moved (old, new) and nodes were renamed (old, new; null: gone, the note is stale); and how many
    were remapped and how many went stale."""
    told = (
        notes.join(moves.select(F.col("old").alias("_f"), F.col("new").alias("_file")), F.col("target.file_path") == F.col("_f"), "left")
        .join(
            remap.select(F.col("old").alias("_n"), F.col("new").alias("_node"), F.lit(True).alias("_known")),
            F.col("target.node_id") == F.col("_n"),
            "left",
        )
    )
    file = (F.col("target.type") == "file") & F.col("_file").isNotNull()
    node = (F.col("target.type") == "node") & F.coalesce("_known", F.lit(False))
    gone = node & F.col("_node").isNull()
    moved = node & F.col("_node").isNotNull()
    told = told.withColumns(
        {
            "target": F.when(
                file, F.struct(F.lit("file").alias("type"), F.col("_file").alias("file_path"), F.lit(None).cast("string").alias("node_id"))
            )
            .when(moved, F.struct(F.lit("node").alias("type"), F.lit(None).cast("string").alias("file_path"), F.col("_node").alias("node_id")))
            .otherwise(F.col("target")),
            "stale": F.when(gone, True).when(moved, False).otherwise(F.col("stale")),
            "_remapped": F.coalesce(file | moved, F.lit(False)),
            "_gone": F.coalesce(gone, F.lit(False)),
        }
    )
    counts = told.agg(F.count_if("_remapped").alias("remapped"), F.count_if("_gone").alias("stale"))
    return told.select(*notes.columns), counts


def validate_files(notes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes on files with stale set by whether the file (path) exists; and how many are newly stale."""
    there = files.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    told = notes.join(there, F.col("target.file_path") == F.col("_p"), "left")
    on_file = F.col("target.type") == "file"
    gone = on_file & F.col("_there").isNull()
    new = gone & ~F.coalesce("stale", F.lit(False))
    out = told.withColumn("_new", new).withColumn("stale", F.when(on_file, gone).otherwise(F.col("stale")))
    return out.select(*notes.columns), out.agg(F.count_if("_new").alias("newly_stale"))


# Chats. Long form: conv_id, turn, role, text.


def thread_summary(turns: DataFrame) -> DataFrame:
    """conv_id, messages, title: the first user message, cut to 60 characters."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    title = F.when(F.length("_t") > 60, F.concat(F.substring("_t", 1, 60), F.lit("..."))).otherwise(F.col("_t"))
    told = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), first.alias("_t"))
    return told.select("conv_id", "messages", F.coalesce(title, F.lit("New Chat")).alias("title"))


def new_thread(threads: DataFrame, thread_id: str, now: datetime, project: str | None = None) -> DataFrame:
    from tessera.schema import THREAD

    made = threads.sparkSession.createDataFrame([(thread_id, "New Chat", project, now, now, [])], THREAD)
    return conform(threads, THREAD).unionByName(made)


def delete_thread(threads: DataFrame, thread_id: str) -> DataFrame:
    return threads.where(F.col("id") != thread_id)


def rename_thread(threads: DataFrame, thread_id: str, title: str) -> DataFrame:
    return threads.withColumn("title", F.when(F.col("id") == thread_id, F.lit(title)).otherwise(F.col("title")))


def in_project(threads: DataFrame, project: str, listing: bool = True) -> DataFrame:
    """Threads of a project; outside listings those of no project too."""
    own = F.col("project_id") == project
    return threads.where(own if listing else own | F.col("project_id").isNull())


def thread_list(threads: DataFrame, limit: int | None = None) -> DataFrame:
    out = threads.select("id", "title", "project_id", "updated_at", F.size("messages").alias("messages")).orderBy(
        F.desc("updated_at"), "id"
    )
    return out.limit(limit) if limit else out


def append_message(threads: DataFrame, thread_id: str, role: str, content: str, now: datetime) -> DataFrame:
    """A first user message names a thread without a title."""
    mine = F.col("id") == thread_id
    message = F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"), F.lit(now).cast("timestamp").alias("timestamp"))
    title = content[:60] + ("..." if len(content) > 60 else "")
    unnamed = F.coalesce("title", F.lit("")).isin("", "New Chat")
    named = F.when(mine & unnamed & F.lit(role == "user"), F.lit(title)).otherwise(F.col("title"))
    return threads.withColumns(
        {
            "title": named,
            "messages": F.when(mine, F.array_append("messages", message)).otherwise(F.col("messages")),
            "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )


def replace_last(threads: DataFrame, thread_id: str, content: str, now: datetime) -> DataFrame:
    mine = (F.col("id") == thread_id) & (F.size("messages") > 0)
    last = F.element_at("messages", -1).withField("content", F.lit(content))
    return threads.withColumns(
        {
            "messages": F.when(mine, F.array_append(F.slice("messages", 1, F.size("messages") - 1), last)).otherwise(F.col("messages")),
            "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )


def search_sessions(turns: DataFrame, sought: str, newest: int = 100, limit: int = 20) -> DataFrame:
    """conv_id of the conversations, among the ``newest`` by id, with the text in any case in a message."""
    new = turns.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(newest)
    hits = turns.join(F.broadcast(new), "conv_id", "left_semi").where(F.lower("text").contains(sought.lower()))
    return hits.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(limit)


def search_threads(threads: DataFrame, sought: str, newest: int = 100, limit: int = 20) -> DataFrame:
    """Rows of the threads, among the ``newest`` by time, with the text in any case in their title, a tag or a message;
    the latest first, ties by id. Threads without a time are the oldest. A table without a column tags has none."""
    new = threads.orderBy(F.desc_nulls_last("updated_at"), "id").limit(newest)
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(sought.lower())), F.lit(False))
    hit = has(F.col("title")) | F.coalesce(F.exists("messages", lambda m: has(m["content"])), F.lit(False))
    if "tags" in threads.columns:
        hit = hit | F.coalesce(F.exists("tags", has), F.lit(False))
    return new.where(hit).orderBy(F.desc_nulls_last("updated_at"), "id").limit(limit)


def keep_last(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    from tessera.operators.changes import last_per_key

    return last_per_key(turns, ["conv_id"], ["turn"], n)


def prune_threads(threads: DataFrame, now: datetime, days: int) -> DataFrame:
    """Threads updated in the last ``days`` days."""
    return threads.where(F.col("updated_at") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))
