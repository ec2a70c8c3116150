"""The document catalogue, uploads and chat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.storage import stored


def delete_documents(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """catalog without the wanted (id, user_id) rows; another user's documents stay."""
    return catalog.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_anti")


def deleted_sources(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, source) of the documents that delete_documents removes."""
    return catalog.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_semi").select("user_id", F.col("filename").alias("source")).distinct()


def delete_index_rows(table: DataFrame, gone: DataFrame) -> DataFrame:
    """An index table without the rows of deleted (user_id, source)."""
    return table.join(gone, ["user_id", "source"], "left_anti")


def delete_user_cascade(catalog: DataFrame, users: DataFrame) -> DataFrame:
    return catalog.join(users.select("user_id"), "user_id", "left_anti")


def list_documents(catalog: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's documents, or every user's with their place in that user's list, newest first."""
    fields = ["id", "filename", "filesize", "chunk_count", "created_at"]
    if user_id is not None:
        return catalog.where(F.col("user_id") == user_id).select(*fields).orderBy(F.desc("created_at"), "id")
    # numbered within parts of a user's list, then counted on over the parts before: no user's rows meet in one task
    placed = stored(catalog.select("user_id", *fields).repartitionByRange("user_id", F.desc("created_at"), "id").withColumn("part", F.spark_partition_id()), "listed")
    inside = Window.partitionBy("part", "user_id").orderBy(F.desc("created_at"), "id")
    earlier = Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("user_id", "part").agg(F.count("*").alias("n")).select("user_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.withColumn("n", F.row_number().over(inside)).join(offsets, ["user_id", "part"]).select("user_id", *fields, (F.col("n") + F.col("before")).cast("int").alias("place"))


def catalog_entries(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents as catalogue rows: mimetype text/plain and chunk count 0 unless known."""
    joined = docs.join(counts, "source", "left")
    kind = F.col("mimetype") if "mimetype" in docs.columns else F.lit(None).cast("string")
    return joined.select("filename", F.col("source").alias("filepath"), F.col("size_bytes").alias("filesize"), F.coalesce(kind, F.lit("text/plain")).alias("mimetype"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "user_id")


def dedupe_uploads(incoming: DataFrame, queued: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Incoming (user_id, filename, extension) that are supported and not queued; equal incoming names all stay."""
    new = incoming.join(queued.select("user_id", "filename"), ["user_id", "filename"], "left_anti")
    return new.where(F.lower("extension").isin(*extensions))


def search_filename(catalog: DataFrame, text: str) -> DataFrame:
    return catalog.where(F.lower("filename").contains(text.lower()))


def session_summary(messages: DataFrame, default_title: str = "New chat") -> DataFrame:
    """(conv_id, title, n_messages, last_turn): the first user message, cut to 30 characters, is the title."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    grouped = messages.groupBy("conv_id").agg(first.alias("first"), F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    title = F.when(F.length("first") > 30, F.concat(F.substring("first", 1, 30), F.lit("..."))).otherwise(F.coalesce("first", F.lit(default_title)))
    return grouped.select("conv_id", title.alias("title"), "n_messages", "last_turn")


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The n sessions with the latest updated_at."""
    return sessions.orderBy(F.desc("updated_at"), "conv_id").limit(n)


def delete_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("conv_id"), "conv_id", "left_anti")


def assemble_messages(fragments: DataFrame) -> DataFrame:
    """(conv_id, message_id, seq, text[, kind]) to whole messages in fragment order.

    With a column kind, rows of kind "references" hold the message's citations (the last
    one counts) and a row of kind "done" closes it; the rest are text.
    """
    kind = F.col("kind") if "kind" in fragments.columns else F.lit("text")
    is_text = ~F.coalesce(kind.isin("references", "done"), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.when(is_text, F.struct("seq", "text"))))
    out = fragments.groupBy("conv_id", "message_id").agg(
        F.array_join(F.transform(ordered, lambda f: f["text"]), "").alias("text"),
        F.count(F.when(is_text, 1)).alias("n_fragments"),
        F.max_by(F.when(kind == "references", F.col("text")), F.when(kind == "references", F.col("seq"))).alias("references"),
        F.coalesce(F.bool_or(kind == "done"), F.lit(False)).alias("done"),
    )
    return out if "kind" in fragments.columns else out.drop("references", "done")
