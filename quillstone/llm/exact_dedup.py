"""Exact dedup by content sort, in DataFrame operations only.

Splitters sampled from (first bytes, SHA-256, id) range-partition the normalised contents; each range is sorted externally, so equal contents
are neighbours; the window compares neighbours in full (its partition key is the content) and numbers every run. Only contents equal to a
splitter's can lie across a range's border: there are fewer of them than ranges. Their totals are pre-aggregated on the map side and put in as
literals, so a group with a third of all rows is spread over many ranges by id and never meets in one task.

The text crosses one shuffle, once. Nothing is collected but the splitters and those totals, both bounded by the number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_MAX, LONG_MIN, bucket_of, sampled_splitters, shuffle_partitions

#: Bytes of the content that lead the range key.
PREFIX = 48


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, ranges: int | None = None) -> DataFrame:
    """All rows and columns of docs in a struct `row`, plus keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and empty texts form one group. The smallest (or largest) id of a group stays; a null id stays only if
    its group has no other, and keep_id is null then. Of rows repeated with the same id exactly one is kept. An empty table gives an empty result.
    Names of other columns never clash: they stay inside `row`.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    spark, low = docs.sparkSession, keep == "smallest"
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = base.select("row", (normalise(text) if normalise else text).alias("content"), F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(LONG_MAX if low else LONG_MIN)).alias("rank_id"))
    prefix, sha = F.substring(F.col("content").cast("binary"), 1, PREFIX), F.sha2(F.col("content"), 256)
    keys, types = [prefix, sha, F.col("rank_id")], ["binary", "string", "bigint"]
    splitters = sampled_splitters(rows, keys, ranges or shuffle_partitions(spark))

    # contents that touch a border: by the first splitter that has them
    border = {s[:2]: i for i, s in reversed(list(enumerate(splitters)))}
    at = F.lit(None).cast("int")
    if border:
        found = sorted(border.items(), key=lambda x: x[1])
        at = F.array_position(F.array(*[F.lit(h) for (_, h), _ in found]), F.col("sha")).cast("int")
        heads = rows.filter(prefix.isin([p for (p, _), _ in found])).select("rank_id", sha.alias("sha")).withColumn("at", at).filter("at > 0")
        best = F.min("rank_id") if low else F.max("rank_id")
        totals = {r["at"]: (r["keep"], r["n"]) for r in heads.groupBy("at").agg(best.alias("keep"), F.count("*").alias("n")).collect()}
        keeps, sizes = (F.array(*[F.lit(totals.get(i + 1, (None, 0))[k]).cast("long") for i in range(len(found))]) for k in (0, 1))
    ranged = rows.withColumns({"sha": sha, "bucket": bucket_of(keys, splitters, types)}).repartitionById(len(splitters) + 1, F.col("bucket"))
    run = Window.partitionBy("bucket", "content")
    order = run.orderBy(F.col("rank_id") if low else F.col("rank_id").desc())
    runs = ranged.withColumns({"place": F.row_number().over(order), "run_keep": F.first("rank_id").over(order), "run_size": F.count("*").over(run), "at": at})
    if border:
        split = F.col("at") > 0
        runs = runs.withColumns({"run_keep": F.when(split, F.get(keeps, F.col("at") - 1)).otherwise(F.col("run_keep")), "run_size": F.when(split, F.get(sizes, F.col("at") - 1)).otherwise(F.col("run_size"))})
    return runs.select(
        "row",
        F.when(F.col("run_keep") != (LONG_MAX if low else LONG_MIN), F.col("run_keep")).alias("keep_id"),
        F.col("run_size").alias("group_size"),
        ((F.col("place") == 1) & (F.col("rank_id") == F.col("run_keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    return content_sort(docs, **options).filter("kept").select("row.*")
