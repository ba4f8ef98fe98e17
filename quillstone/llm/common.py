"""Shared helpers: scratch tables on the cluster's shared folder, sampled range splitters, Arrow batching."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship  # noqa: F401  the operators take it from here

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session without one (a local test) gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Intermediate Parquet tables of one operator call. Writing one cuts the lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/quillstone/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """few: state of a round, which an eighth of the shuffle's tasks write, one partition after another, so that rounds don't leave many small files."""
        if few:
            df = df.coalesce(max(8, shuffle_partitions(self.spark) // 8))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path := f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark's cleaner delete shuffle files of finished steps now: it learns of them when the driver collects its garbage."""
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Removes a table that no pending plan reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sampled_splitters(df: DataFrame, keys: list[Column], buckets: int, per_bucket: int = 40, seed: int = 7) -> list[tuple]:
    """At most buckets - 1 quantiles of the key tuples, from a sample of about per_bucket * buckets rows: its size depends on buckets, not on the rows."""
    if buckets <= 1 or not (rows := df.count()):
        return []
    sample = df.sample(fraction=min(1.0, per_bucket * buckets / rows), seed=seed) if rows > per_bucket * buckets else df
    found = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in sample.select(*keys).collect())
    return sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []


def bucket_of(keys: list[Column], splitters: list[tuple], types: list[str]) -> Column:
    """How many splitters are at or below the key, found in two steps of about sqrt(n) comparisons each."""
    if not splitters:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    struct = lambda values: F.struct(*[v.cast(t).alias(n) for v, t, n in zip(values, types, names, strict=True)])
    width = max(1, math.isqrt(len(splitters)))
    groups = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    lit = lambda s: struct([F.lit(x) for x in s])
    heads, rest, key = F.array(*[lit(g[0]) for g in groups]), F.array(*[F.array(*[lit(s) for s in g]) for g in groups]), struct(keys)
    above = F.size(F.filter(heads, lambda s: s <= key))
    return F.when(above == 0, 0).otherwise((above - 1) * width + F.size(F.filter(F.element_at(rest, F.greatest(above, F.lit(1))), lambda s: s <= key))).cast("int")


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between the tasks of a stage: make()'s value. Workers are reused by later stages, so there is room for one key only."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, without what an earlier stage left in this worker; at the end of a task freed memory goes back to the system, for the executor to use."""

    def frugally(batches):  # is sent by value, with what it names: functions of this module, which go by reference, and not what is kept
        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return frugally


def forget() -> None:
    _kept.clear()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about max_bytes of the string column; one longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
