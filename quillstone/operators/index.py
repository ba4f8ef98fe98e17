"""Indexes as plain tables: postings and statistics for BM25, vector collections, reconciliation, upsert and delete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.runs import whole_keys


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, chunk_id, dl, w) in the order of the first three to one row for them, with its distinct words."""
    for batch, key in whole_keys(batches, ["scope", "chunk_id", "dl"]):
        lists = batch.column("w")
        at = lists.offsets.to_numpy()
        words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        n, size = int(key[-1]) + 1, max(len(words.dictionary), 1)
        keys, tf = np.unique(np.repeat(key, np.diff(at)) * size + words.indices.to_numpy().astype(np.int64), return_counts=True)
        row, term = np.divmod(keys, size)
        bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        first = batch.take(pa.array(np.searchsorted(key, np.arange(n))))
        lists = [pa.ListArray.from_arrays(bounds, x) for x in (words.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([*[first.column(c) for c in ("scope", "chunk_id", "dl")], *lists], ["scope", "chunk_id", "dl", "terms", "tfs"])


def word_lists(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, chunk_id, dl, terms, tfs): the postings of a chunk as one row. The texts are shuffled by chunk_id, not their words."""
    rows = chunks.select((F.lit("all") if scope is None else scope.cast("string")).alias("scope"), "chunk_id", F.coalesce("text", F.lit("")).alias("text")).repartition("chunk_id")
    rows = rows.select("scope", "chunk_id", T.words(F.col("text")).alias("w")).select("scope", "chunk_id", F.size("w").alias("dl"), "w").sortWithinPartitions("scope", "chunk_id", "dl")
    return rows.mapInArrow(_counted, f"scope string, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, dl int, terms array<string>, tfs array<bigint>")


def postings(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, chunk_id, term, tf, dl). Scope keys the statistics: one user, one document, or all."""
    return word_lists(chunks, scope).select("scope", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("scope", "chunk_id", F.col("x.terms").alias("term"), "dl", F.col("x.tfs").alias("tf"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, action): delete what is gone, upsert what is new or has another content_hash, leave the rest. Nulls count as different."""
    o, n = old.select("chunk_id", F.col("content_hash").alias("old_hash")), new.select(F.col("chunk_id").alias("new_id"), F.col("content_hash").alias("new_hash"))
    both = o.join(n, F.col("chunk_id") == F.col("new_id"), "full_outer")
    same = F.col("old_hash") == F.col("new_hash")
    action = F.when(F.col("new_id").isNull(), "delete").when(F.col("chunk_id").isNull() | ~F.coalesce(same, F.lit(False)), "upsert").otherwise("unchanged")
    return both.select(F.coalesce("chunk_id", "new_id").alias("chunk_id"), action.alias("action"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put over those of the same keys; of rows with equal keys the last by all columns stays."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in rows.columns if c not in keys] or [F.lit(0)])
    latest = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(latest)


def where_equal(table: DataFrame, where: dict | None) -> DataFrame:
    """Rows that equal all given scalars. Anything richer raises: a filter that quietly stops filtering would show other users' rows."""
    for key, value in (where or {}).items():
        if isinstance(value, (list, tuple, set, dict)):
            raise ValueError(f"only scalar equality is supported, not {key}={value!r}")
        table = table.filter(F.col(key) == value)
    return table


def get(table: DataFrame, ids: list[str] | None = None, where: dict | None = None, limit: int | None = None, include: list[str] | None = None, id_col: str = "chunk_id") -> DataFrame:
    table = where_equal(table, where)
    if ids is not None:
        table = table.filter(F.col(id_col).isin(list(ids)))
    if include is not None:
        table = table.select(id_col, *[c for c in include if c != id_col])
    return table.orderBy(id_col).limit(limit) if limit is not None else table


def delete(table: DataFrame, ids: DataFrame | None = None, where: dict | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The table without rows of these ids, and without those that equal all of `where`."""
    if ids is not None:
        table = table.join(ids.select(id_col).distinct(), id_col, "left_anti")
    if where:
        where_equal(table.limit(0), where)
        match = None
        for key, value in where.items():
            match = (F.col(key) == value) if match is None else match & (F.col(key) == value)
        table = table.filter(~F.coalesce(match, F.lit(False)))
    return table
