"""Documents, chat sessions and recorded runs: paging, summaries, status rules, validity, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ["uploaded", "parsing", "chunking", "embedding", "ready", "failed"]
PAGE_SIZE_CAP, RUN_CAP = 100, 100


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of rows with total and total_pages (1 if there are no rows)."""
    size = max(1, min(size, PAGE_SIZE_CAP))
    total = rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("total_pages"))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(total)  # one row


def newest(rows: DataFrame, order: list[Column], n: int, most: int = RUN_CAP) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(n, most)))


def session_summaries(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, preview, last_turn): the preview is the first 120 characters of the first user message, null without one."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.substring(first, 1, 120).alias("preview"), F.max("turn").alias("last_turn"))


def blank_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.join(messages, "conv_id", "left_anti")


def session_messages(messages: DataFrame, conv_id) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def next_action(status: Column, n_chunks: Column) -> Column:
    """What resuming does with a document: nothing if ready, embedding if it has chunks, else all of it."""
    return F.when(status == "ready", "skip").when(n_chunks > 0, "embed").otherwise("parse")


def token_valid(used_at: Column, expires_at: Column, now: Column) -> Column:
    return used_at.isNull() & (expires_at > now)


def delete_document(doc_id, *tables: DataFrame) -> list[DataFrame]:
    """All tables without the document's rows."""
    return [t.filter(~F.coalesce(F.col("doc_id") == doc_id, F.lit(False))) for t in tables]


def replace_document(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with all rows of the documents in `rows` exchanged for them."""
    return table.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows)


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def audit_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("last_at"))


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc()))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def run_artifacts(calls: DataFrame) -> DataFrame:
    """One row a run from its steps (run_id, step, stage, ms, ...): totals, and the steps in order as an array of structs."""
    return calls.groupBy("run_id").agg(F.round(F.sum(F.col("ms").cast("decimal(20,6)")), 1).cast("double").alias("total_ms"), F.count("*").alias("step_count"), F.array_sort(F.collect_list(F.struct("step", "stage", "ms"))).alias("steps"))
