"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source, documents are range-sorted by it: the key's leading digits deal a source into buckets of
about ROWS_PER_BUCKET rows, each bucket is sorted by key, and a document's place in its source is its bucket's offset plus the running sum inside
the bucket. So a source with a third of all rows is many tasks, not one. The budget of a source gives whole epochs and a rest; the rest is cut at
one key. Reruns agree, because keys depend on the seed, the id and the text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ROWS_PER_BUCKET = 4_000
WORD = r"[^\x20\x09-\x0D]+"
#: No document is repeated more often than this.
MAX_EPOCHS = 3


def mix_key(id_col: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_rows, target for a table (source, size).

    Sources by code point, null last, get the weights of `cycle` in turn. Targets share `share` of all sizes by weight; none exceeds max_epochs
    times its source's size and the excess goes to the others by weight. That is a water level L with target = min(weight * L, cap): with
    sources in the order of cap / weight, L is the largest (total - caps of the first k) / (weights of the rest). One row a source; sources are
    counted in thousands, so these windows are small.
    """
    by = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    by = by.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)).withColumn("weight", F.get(weights, F.col("turn")))
    by = by.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = by.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(everything).cast("double") * share})
    levels = levels.withColumn("level", F.max((F.col("total") - F.col("caps")) / F.col("left")).over(everything))
    return levels.select("source", "source_size", "n_rows", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **targets) -> DataFrame:
    """doc_id, source, size, key, start (words of its source before it), source_size, target, budget, full, rest."""
    work = Scratch(docs.sparkSession, "mix")
    text = F.col(f"`{text_col}`")
    sized = work.table(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mix_key(F.col(f"`{id_col}`"), text, seed).alias("key")), "sized")
    goals = work.table(source_targets(sized, **targets), "targets")
    spread = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / ROWS_PER_BUCKET))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    same = sized["source"].eqNullSafe(goals["source"])
    dealt = sized.join(goals, same).drop(goals["source"]).withColumn("bucket", F.floor(lead * spread).cast("long"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("bucket").alias("nth"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("nth"))).withColumn("start", F.col("offset") + F.col("inner"))
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    return placed.withColumns({"budget": budget, "full": full}).withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **targets) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken.

    taken counts words, repeats included: `full` epochs of the whole document and what of it lies before the cut, so a source's taken words are
    exactly the whole part of its target. Null text has size 0; a null source is a source, the last; sources without words take nothing.
    """
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return _placed(docs, id_col, text_col, source_col, seed, **targets).select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + cut).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **targets) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as the mix takes it.

    Documents stay whole here: the one at the cut is taken if that brings its source nearer to its target, so a source differs from its target
    by half a document at most. Documents without words are taken once for each whole epoch, and once if their source has no words at all.
    A source's cut is one key, so the choice needs one row a source and no join on documents. Rows with the same id and text stand or fall together.
    """
    spark = docs.sparkSession
    placed = _placed(docs, id_col, text_col, source_col, seed, **targets)
    taken = (F.col("start") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0) & ((F.col("start") < F.col("rest")) | (F.col("size") == 0))
    cuts = placed.groupBy("source", "full", "source_size").agg(F.max(F.when(taken, F.col("key"))).alias("cut_key"))
    cuts = Scratch(spark, "mix").table(cuts.select(F.col("source").alias("cut_source"), F.when(F.col("source_size") > 0, F.col("full")).otherwise(1).alias("cut_full"), "cut_key"), "cuts")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = mix_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"), seed)
    copies = F.col("cut_full") + F.coalesce(key <= F.col("cut_key"), F.lit(False)).cast("int")
    chosen = row.join(cuts, F.col(f"row.`{source_col}`").eqNullSafe(F.col("cut_source"))).withColumn("copies", copies.cast("int")).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
