"""Chunk analytics: size statistics, histograms, overlap, pages, warnings, embeddings, neighbours, projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import embedding
from .dense_index import matrix

HEALTHY, BOUNDS = 50, [0, 200, 400, 600, 800]


def sizes(chunks: DataFrame, *keys: str) -> DataFrame:
    n, t = F.length("text"), F.col("token_count")
    return chunks.groupBy(*keys).agg(F.count("*").alias("total_chunks"), F.round(F.avg(n), 2).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(t), 2).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.sum(t).alias("total_tokens"))


def labels(bounds: list[int] = BOUNDS) -> list[str]:
    return [f"{a}-{b}" for a, b in zip(bounds, bounds[1:], strict=False)] + [f"{bounds[-1]}+"]


def histogram(chunks: DataFrame, *keys: str, bounds: list[int] = BOUNDS) -> DataFrame:
    """(keys, bucket, n), empty buckets too. Sizes under the first bound count in the last bucket."""
    n, names = F.length("text"), labels(bounds)
    inside = [((n >= a) & (n < b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    last = ~inside[0]
    for c in inside[1:]:
        last = last & ~c
    counts = chunks.groupBy(*keys).agg(F.array(*[F.struct(F.lit(name).alias("bucket"), F.count_if(c).alias("n")) for name, c in zip(names, [*inside, last], strict=True)]).alias("h"))
    return counts.select(*keys, F.explode("h").alias("h")).select(*keys, "h.*")


def overlap_coverage(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters that consecutive chunks share, in percent of the document's last end."""
    after = Window.partitionBy(key).orderBy("chunk_index")
    a, b = F.lead("char_start").over(after), F.lead("char_end").over(after)
    shared = F.greatest(F.lit(0), F.least(F.col("char_end"), b) - F.greatest(F.col("char_start"), a))
    per = chunks.withColumn("shared", F.when(a.isNotNull(), shared).otherwise(0)).groupBy(key).agg(F.sum("shared").alias("s"), F.max("char_end").alias("e"))
    return per.select(key, F.when(F.col("e") > 0, F.round(F.col("s") / F.col("e") * 100, 6)).otherwise(0.0).alias("overlap_coverage_pct"))


def per_page(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "page_number").agg(F.count("*").alias("n_chunks"))


def warnings(chunks: DataFrame, pages: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, kind, places): tiny chunks and oversized ones by index, pages with text but without a chunk by number."""
    n = F.length("text")
    one = lambda kind, c: chunks.filter(c).groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("places")).select("doc_id", F.lit(kind).alias("kind"), "places")
    bare = pages.filter("cleaned_char_count > 0").join(chunks, ["doc_id", "page_number"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("page_number").cast("int"))).alias("places"))
    return one("tiny", n < HEALTHY).unionByName(one("oversized", n > 2 * most)).unionByName(bare.select("doc_id", F.lit("page_without_chunks").alias("kind"), "places"))


def listing(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "chunk_id", "page_number", "char_start", "char_end", "token_count", F.length("text").alias("chars"), F.substring("text", 1, 240).alias("excerpt"))


def embedding_stats(vectors: DataFrame, key: str) -> DataFrame:
    v = F.col("embedding")
    return vectors.select(key, F.size(v).alias("dim"), F.round(embedding.norm(v), 4).alias("l2_norm"), F.slice(v, 1, 8).alias("preview"))


def _nearest_others(k: int, dim: int, names: list[str]):
    """For two blocks of a group: the k rows of the second that are nearest to each row of the first, and what ties with the last of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left["key"].combine_chunks(), right["r_key"].combine_chunks()
        x, y = matrix(left["embedding"].combine_chunks(), dim), matrix(right["r_embedding"].combine_chunks(), dim)
        norms = np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1))
        score = np.where(norms > 0, np.floor(np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0) * 1e6 + 0.5) / 1e6, 0.0)
        if not len(left) or not len(right):
            return pa.table([ids[:0], others[:0], pa.array([], pa.float64())], names)
        if left["a"][0].as_py() == left["b"][0].as_py():  # a block and itself
            place = pc.index_in(others, ids).to_numpy(zero_copy_only=False).astype(int)
            score[place, np.arange(len(others))] = -np.inf
        if len(others) > k:
            score[score < -np.partition(-score, k - 1, 1)[:, k - 1 : k]] = -np.inf
        i, j = np.nonzero(score > -np.inf)
        return pa.table([ids.take(pa.array(i)), others.take(pa.array(j)), pa.array(score[i, j])], names)

    return run


def neighbours(vectors: DataFrame, group: str, key: str, k: int = 3, block: int = 1_024) -> DataFrame:
    """(key, neighbour, similarity, rank): the k nearest others of the same group (a document's chunks) by cosine, rounded to 6 places. A key names one
    vector of one group; rows without a group or a vector take no part.

    A group's rows go in blocks of about `block`; every two blocks meet in a task of their own as two matrices and pass on the nearest only, so a group
    of any size is many tasks.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).filter("g is not null and key is not null and embedding is not null")
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select("g", F.col("own").alias("a"), F.col("other").alias("b"), "key", "embedding")
    right = dealt.select(*[F.col(c).alias(f"r_{n}") for n, c in (("g", "g"), ("a", "other"), ("b", "own"), ("key", "key"), ("embedding", "embedding"))])
    first = rows.first()
    kind = vectors.schema[key].dataType.simpleString()
    meet = left.groupBy("g", "a", "b").cogroup(right.groupBy("r_g", "r_a", "r_b"))
    names = [key, "neighbour", "similarity"]
    met = meet.applyInArrow(_nearest_others(k, len(first["embedding"]) if first else 1, names), f"`{key}` {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "neighbour"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k)


def project_2d(vectors: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, x, y): the first two principal components of each group's vectors; one or two points lie on a line."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        x = np.stack([np.asarray(v, float) for v in frame["embedding"]])
        if len(x) <= 2:
            xy = np.array([[float(i), 0.0] for i in range(len(x))])
        else:
            x = x - x.mean(0)
            u, s, vt = np.linalg.svd(x, full_matrices=False)
            sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:2]
            xy = (u[:, :2] * s[:2]) * sign
            xy = np.pad(xy, ((0, 0), (0, 2 - xy.shape[1])))
        return pd.DataFrame({group: frame[group], key: frame[key], "x": xy[:, 0], "y": xy[:, 1]})

    return vectors.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, x double, y double")
