"""Embeddings: the hashing bag-of-words embedder as a sparse table, normalisation, job bookkeeping, and the protocol for model-backed embedders."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.runs import whole_keys

DIM = 384


@functools.lru_cache(1 << 18)
def _digest(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()[:8]


def _buckets(lists: pa.ListArray, dim: int) -> np.ndarray:
    """The bucket of text.hash_bucket of each word of these rows."""
    at = lists.offsets.to_numpy()
    words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    digests = b"".join(map(_digest, words.dictionary.to_pylist()))
    return (np.frombuffer(digests, "<u8") % dim).astype(np.int64)[words.indices.to_numpy()]


def _placed(buckets: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    rows = len(sizes)
    return np.bincount(np.repeat(np.arange(rows) * dim, sizes) + buckets, minlength=rows * dim).reshape(rows, dim).astype(float)


def counted(lists: pa.ListArray, dim: int = DIM) -> np.ndarray:
    """Word counts (rows, dim) in buckets, of rows of words; a word that recurs is hashed once."""
    return _placed(_buckets(lists, dim), np.diff(lists.offsets.to_numpy()), dim)


def counted_in_blocks(texts: pa.StringArray, most: int, dim: int = DIM) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, word counts) of blocks of at most `most` plain texts."""
    lists = T.split_words(texts)
    at = lists.offsets.to_numpy()
    buckets = _buckets(lists, dim)
    for start in range(0, len(texts), most):
        mine = at[start : start + most + 1] - at[0]
        yield start, _placed(buckets[mine[0] : mine[-1]], np.diff(mine), dim)


def _sparse(name: str, dim: int):
    """(key, words) in the order of keys to a row for each bucket of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key in whole_keys(batches, [name]):
            first = np.searchsorted(key, np.arange(int(key[-1]) + 1))
            x = np.add.reduceat(counted(batch.column("words"), dim), first).astype(np.int64)
            row, bucket = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first[row])), pa.array(bucket.astype(np.int32)), pa.array(x[row, bucket]), pa.array((x * x).sum(1)[row])], [name, "bucket", "tf", "norm2"])

    return run


def sparse_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, bucket, tf, norm2): term counts in hash buckets and the squared length of the whole vector. Integers, so sums are exact in any order.
    The texts are shuffled by key, not their words; texts of one key are one vector."""
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(key).sortWithinPartitions(key)
    return dealt.select(key, T.words(F.col("text")).alias("words")).mapInArrow(_sparse(key, dim), f"`{key}` {kind}, bucket int, tf bigint, norm2 bigint")


def dense_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = DIM, unit: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, what is kept, embedding): the same vectors as arrays, of length 1 or as counts, a row for each row; a text without words has only zeros. Nothing is
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, x in counted_in_blocks(whole.column("text"), 2048, dim):
                batch = whole.slice(start, 2048)
                if unit:
                    x /= np.sqrt(np.maximum((x * x).sum(1, keepdims=True), 1))
                flat = pa.array(x.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), flat)], [*names, "embedding"])

    names = [key, *keep]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*[F.col(c) for c in names], T.plain(F.col(text)).alias("text")).mapInArrow(run, f"{kinds}, embedding array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """The vector at length 1; unchanged if its length is 0 or not finite."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def embed_with(rows: DataFrame, key: str, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 32) -> DataFrame:
    """(key, embedding) by a model on the executors, in batches. A failing batch, or one of the wrong length, gives nulls and never an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for i in range(0, len(frame), batch):
                part = frame[text].iloc[i : i + batch].tolist()
                try:
                    vectors = model(part)
                    out += vectors if len(vectors) == len(part) else [None] * len(part)
                except Exception:
                    out += [None] * len(part)
            yield pd.DataFrame({key: frame[key], "embedding": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def tier(n: Column) -> Column:
    """small up to 100 chunks, large from 1000, else medium; only large jobs write checkpoints."""
    return F.when(n <= 100, "small").when(n >= 1000, "large").otherwise("medium")


def job_status(total: Column, done: Column, failed: Column) -> Column:
    return F.when((done == 0) & (total > 0), "failed").when(failed > 0, "completed_with_failures").otherwise("completed")
