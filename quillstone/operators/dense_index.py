"""A stored index of vectors for nearest neighbours by cosine: cells of a coarse quantiser, blocks of a cell with their radius, probed or exact search.

The quantiser is spherical k-means, fitted on the driver on a sample of at most SAMPLE rows; every row is indexed. A row goes to the cell of its
nearest centroid; cells are stored as blocks of at most BLOCK rows, dealt by cell and salt, so that a cell with a third of all rows is many blocks
in many tasks. A block keeps its radius, the largest angle between its rows and the centroid.

A search scores the blocks of each query's `probes` nearest cells. That is all if exact is false, and recall depends on probes. If it is true, each
query's n-th best score so far is a floor, and all other blocks are scored whose rows can reach it: a row's angle to the query is at least the angle
between query and centroid less the block's radius. Scores are taken from the stored vectors in double precision, in either case.

Queries go in groups of about QUERIES, each of which travels with the code; blocks of at most BLOCK rows meet it where they are read, so nothing but
results is shuffled. The driver holds one group and its nearness to the cells.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.shipping import ship
from ..functions.workspace import new_folder, shuffle_partitions, written
from ..sources.log import Log

SAMPLE, BLOCK, QUERIES, SALTS, ROUNDS = 20_000, 1_024, 1_024, 16, 10
CELLS = "cell int, block string, n int, radius double, ids array<string>, vectors binary"
#: Bytes of vectors in a file: a reader may hold all rows of one at a time.
FILE_BYTES = 32_000_000


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    flat = column.flatten() if len(column) else pa.array([], pa.float32())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def fit_cells(sample: np.ndarray, cells: int, seed: int = 11, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means, first drawn from the sample; an empty cell is drawn anew from the rows that lie farthest from theirs."""
    x, rng = units(sample), np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        centres = units(sums)
    return centres


def _nearest(centres: np.ndarray, dim: int):
    """(id, vector) to (id, cell, cosine, vector) for the nearest cell of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                near = units(matrix(batch.column(1), dim)) @ centres.T
                cells = near.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells.astype(np.int32)), pa.array(near[np.arange(len(near)), cells]), batch.column(1)], ["id", "cell", "cosine", "vector"])

    return run


def _blocks(size: int):
    """Rows sorted by cell to blocks of one cell. Rows of a partition's cell may be several blocks."""
    schema = pa.schema([("cell", pa.int32()), ("block", pa.string()), ("n", pa.int32()), ("radius", pa.float64()), ("ids", pa.list_(pa.string())), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for run_ in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
                for at in range(0, len(run_), size):
                    rows = batch.slice(int(run_[at]), len(run_[at : at + size]))
                    angle = np.arccos(np.clip(rows.column("cosine").to_numpy(), -1, 1)).max()
                    ids = rows.column("id").cast(pa.string())
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([cells[run_[at]]], pa.int32()), pa.array([uuid.uuid4().hex]), pa.array([rows.num_rows], pa.int32()), pa.array([float(angle)]), *lists], schema=schema)

    return run


def _best(q: np.ndarray, x: np.ndarray, n: int, above: float | None):
    """Places and scores of each query's n best rows and what ties with the last of them."""
    norms = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1))
    score = np.floor((q @ x.T) / np.maximum(norms, 1e-300) * 1e9 + 0.5) / 1e9
    if len(x) > n:
        score[score < -np.partition(-score, n - 1, 1)[:, n - 1 : n]] = -np.inf
    a, b = np.nonzero(score > (-np.inf if above is None else above))
    return a, b, score[a, b]


def _visited(ids: pa.Array, q: np.ndarray, n: int, above: float | None, wants):
    """For each block: the best of it for those queries that want it, by wants(cell, radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asks = np.flatnonzero(wants(batch.column("cell")[i].as_py(), batch.column("radius")[i].as_py()))
                if len(asks):
                    x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<f4").astype(float).reshape(-1, q.shape[1])
                    a, b, score = _best(q[asks], x, n, above)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(asks[a])), batch.column("ids")[i].values.take(pa.array(b)), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


def _scored(n: int, kind: pa.DataType, above: float | None, dim: int):
    """For one block and one group of queries: each query's n best rows and what ties with the last of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], kind), pa.array([], pa.string()), pa.array([], pa.float64())], ["query_id", "chunk_id", "score"])
        ids, x = left["ids"][0].values, left["vectors"][0].values.to_numpy().astype(float).reshape(-1, dim)
        a, b, score = _best(matrix(right["vector"].combine_chunks(), dim), x, n, above)
        return pa.table([right["query_id"].combine_chunks().take(pa.array(a)).cast(kind), ids.take(pa.array(b)), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


class DenseIndex:
    """index.build(rows) and index.search(queries, n); see the module's text. Rows (chunk_id, vector) have vectors of one length; rows whose vector is
    null, of length 0 or not finite take no part, nor do such queries. A chunk_id names one row."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        ship(spark)
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self.log = Log(spark, f"{self.path}/log")

    @staticmethod
    def _usable(rows: DataFrame, id_col: str) -> DataFrame:
        length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        return rows.select(F.col(id_col).alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter(F.col("id").isNotNull() & (length > 0) & (length < float("inf")))

    def build(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 11) -> DenseIndex:
        """cells: default the square root of the number of rows, 1024 at most, so that the quantiser travels with the code at every size. sample: rows
        that it is fitted on, drawn by a hash of the id."""
        rows = written(self._usable(rows, "chunk_id"), "vectors")
        n = rows.count()
        dim = len(rows.first()["vector"]) if n else 1
        spread = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(min(1.0, 0.9 * sample / max(n, 1)) * (1 << 30))
        drawn = rows.filter(spread if n > sample else F.lit(True)).select("vector").limit(sample).toArrow()
        centres = fit_cells(matrix(drawn["vector"].combine_chunks(), dim), cells or min(1024, int(n**0.5) + 1), seed) if len(drawn) else np.zeros((0, dim))
        name = f"cells/{uuid.uuid4().hex}"
        if len(centres):
            placed = rows.mapInArrow(_nearest(centres, dim), "id string, cell int, cosine double, vector array<float>")
            dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("cell", "id")
            dealt.mapInArrow(_blocks(self.block), CELLS).write.option("compression", "zstd").option("maxRecordsPerFile", max(1, FILE_BYTES // (4 * dim * self.block))).parquet(f"{self.path}/{name}")
        version, _ = self.log.latest()
        self.log.commit(version + 1, {"cells": name if len(centres) else None, "dim": dim, "centres": centres.round(12).tolist()})
        return self

    def search(self, queries: DataFrame, n: int = 50, probes: int = 8, exact: bool = False, above: float | None = 0.0) -> DataFrame:
        """(query_id, chunk_id, score, dense_rank) of queries (query_id, vector); above: only scores larger than this (null: all)."""
        _, entry = self.log.latest()
        kind = queries.schema["query_id"].dataType.simpleString()
        if not entry or not entry["cells"]:
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double, dense_rank int")
        centres, dim = np.array(entry["centres"]), entry["dim"]
        blocks = self.spark.read.schema(CELLS).parquet(f"{self.path}/{entry['cells']}")
        asked = written(self._usable(queries, "query_id"), "asked")
        groups = max(1, -(-asked.count() // QUERIES))
        # a group of queries travels with the code, as in retrieval.dense_top; blocks are read where they lie
        parts = [self._group(asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g), centres, blocks, n, probes, exact, above, kind) for g in range(groups)]
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return functools.reduce(DataFrame.unionByName, parts).withColumn("dense_rank", F.row_number().over(best)).filter(F.col("dense_rank") <= n)

    def _group(self, asked: DataFrame, centres: np.ndarray, blocks: DataFrame, n: int, probes: int, exact: bool, above: float | None, kind: str) -> DataFrame:
        rows = asked.toArrow()
        ids, q = rows["id"].combine_chunks(), matrix(rows["vector"].combine_chunks(), centres.shape[1])
        near = units(q) @ centres.T
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, np.argsort(-near, axis=1, kind="stable")[:, : max(1, probes)], True, 1)
        scored = lambda wants: blocks.mapInArrow(_visited(ids, q, n, above, wants), f"query_id {kind}, chunk_id string, score double")
        first = scored(lambda cell, _: probed[:, cell])
        if not exact:
            return first
        first = written(first, "first")
        nth = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("k") == n)
        known = {r["query_id"]: r["score"] for r in nth.select("query_id", "score").collect()}
        floor = np.array([known.get(i, -np.inf) for i in ids.to_pylist()])
        angle = np.arccos(np.clip(near, -1, 1))
        # a row of the block is no nearer to the query than this; 1e-6 covers the rounding of angles and scores
        more = lambda cell, radius: ~probed[:, cell] & (np.cos(np.maximum(angle[:, cell] - radius, 0)) + 1e-6 >= floor)
        return first.unionByName(scored(more))


def exact_top(queries: DataFrame, rows: DataFrame, n: int = 50, above: float | None = 0.0) -> DataFrame:
    """What an exact search gives, without an index: every block of rows (chunk_id, vector) meets every group of queries (query_id, vector) in a task of
    its own, and passes on the best."""
    ship(rows.sparkSession)
    held, asked = DenseIndex._usable(rows, "chunk_id"), DenseIndex._usable(queries, "query_id")
    first = held.first()
    blocks, groups = (max(1, -(-x.count() // size)) for x, size in ((held, BLOCK), (asked, QUERIES)))
    spread = lambda n_: F.explode(F.sequence(F.lit(0), F.lit(n_ - 1)))
    left = held.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), spread(groups).alias("group"), F.col("id").cast("string").alias("row_id"), F.col("vector").alias("row"))
    packed = left.groupBy("block", "group").agg(F.collect_list("row_id").alias("ids"), F.flatten(F.collect_list("row")).alias("vectors"))
    right = asked.select(spread(blocks).alias("q_block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("q_group"), F.col("id").alias("query_id"), "vector")
    kind = queries.schema["query_id"].dataType
    run = _scored(n, to_arrow_type(kind), above, len(first["vector"]) if first else 1)
    dealt = lambda x, *keys: x.repartition(shuffle_partitions(rows.sparkSession), *keys).groupBy(*keys)
    scored = dealt(packed, "block", "group").cogroup(dealt(right, "q_block", "q_group")).applyInArrow(run, f"query_id {kind.simpleString()}, chunk_id string, score double")
    return scored.withColumn("dense_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).filter(F.col("dense_rank") <= n)


def build(rows: DataFrame, **options) -> DenseIndex:
    """An index of rows (chunk_id, vector), in a folder of its own under the shared one."""
    return DenseIndex(rows.sparkSession, new_folder(rows.sparkSession, "dense")).build(rows, **options)
