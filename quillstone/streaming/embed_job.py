"""Embedding jobs that can be stopped and resumed: batches of 32 chunks, a ledger written after the sink, failed chunks retried alone.

A document's chunks go in batches by chunk_index, as they lie: batch b has the indexes 32 b to 32 b + 31. Batches are dealt into parts, which are
embedded one after another: a part is a wave (so many batches of each document) of one slice of the documents. Earlier batches of a document are in
earlier parts, so what is done of a document is always its first batches, and the number of the last one is its checkpoint. A part's vectors are
written first and named in the ledger then: a job that is killed leaves out what it has not named and embeds no named batch again. Within a part
Spark deals batches to tasks and repeats what a lost executor had.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators import embedding
from ..sources.log import Log

BATCH, WAVE, SLICES = 32, 32, 4
VECTORS = "doc_id bigint, chunk_id string, batch int, embedding array<float>"


def embed_batches(batches: DataFrame, model: Callable[[list[str]], list]) -> DataFrame:
    """VECTORS from rows (doc_id, batch, chunks of (chunk_index, chunk_id, text)): one call of the model a row. A call that fails or returns another
    number of vectors gives nulls; so does a text for which the model returns None."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for doc, batch, chunks in zip(frame["doc_id"], frame["batch"], frame["chunks"], strict=True):
                try:
                    vectors = list(model([c["text"] for c in chunks]))
                    vectors = vectors if len(vectors) == len(chunks) else [None] * len(chunks)
                except Exception:
                    vectors = [None] * len(chunks)
                out += [(doc, c["chunk_id"], batch, v) for c, v in zip(chunks, vectors, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "batch", "embedding"])

    return batches.mapInPandas(run, VECTORS)


class EmbeddingJob:
    """job.run(chunks, model), again after any failure; job.retry(chunks, model) for what the model failed on; job.vectors(), job.progress(chunks).

    chunks (doc_id, chunk_index, chunk_id, text) must be the same table in every call. Rows with a null doc_id or chunk_index belong to no batch.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = BATCH, wave: int = WAVE, slices: int = SLICES):
        ship(spark)
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, f"{path.rstrip('/')}/ledger")
        self.batch, self.wave, self.slices = batch, wave, slices

    def _ledger(self) -> tuple[int, dict]:
        version, entry = self.log.latest()
        return version, entry or {"batch": self.batch, "wave": self.wave, "slices": self.slices, "parts": {}, "retries": []}

    def _dealt(self, chunks: DataFrame, entry: dict) -> DataFrame:
        rows = chunks.filter("doc_id is not null and chunk_index is not null").select("doc_id", F.expr(f"int(chunk_index div {entry['batch']})").alias("batch"), "chunk_index", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
        return rows.withColumns({"wave": F.expr(f"int(batch div {entry['wave']})"), "slice": F.pmod(F.xxhash64("doc_id"), F.lit(entry["slices"])).cast("int")})

    def _embedded(self, rows: DataFrame, model: Callable[[list[str]], list]) -> str:
        """Embeds rows (doc_id, batch, chunk_index, chunk_id, text), a batch a call, into a new folder."""
        grouped = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("chunks"))
        embed_batches(grouped, model).write.option("compression", "zstd").parquet(f"{self.path}/{(name := f'vectors/{uuid.uuid4().hex}')}")
        return name

    def run(self, chunks: DataFrame, model: Callable[[list[str]], list], most_parts: int | None = None) -> int:
        """Embeds the parts that the ledger does not name yet, in order, most_parts of them at most; returns how many."""
        version, entry = self._ledger()
        dealt = self._dealt(chunks, entry)
        # as many parts as waves of the longest document times slices
        parts = [(r["wave"], r["slice"]) for r in dealt.select("wave", "slice").distinct().orderBy("wave", "slice").collect()]
        todo = [p for p in parts if f"{p[0]}-{p[1]}" not in entry["parts"]][:most_parts]
        for wave, piece in todo:
            entry["parts"][f"{wave}-{piece}"] = self._embedded(dealt.filter(f"wave = {wave} and slice = {piece}"), model)
            version += 1
            self.log.commit(version, entry)
        return len(todo)

    def retry(self, chunks: DataFrame, model: Callable[[list[str]], list]) -> None:
        """Embeds the failed chunks alone, in batches of the same size; those that fail again stay failed."""
        version, entry = self._ledger()
        rows = self._dealt(chunks, entry).drop("batch").join(self.failed().select("chunk_id"), "chunk_id", "left_semi")
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")) - 1
        entry["retries"].append(self._embedded(rows.withColumn("place", place).withColumn("batch", F.expr(f"int(place div {entry['batch']})")), model))
        self.log.commit(version + 1, entry)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], VECTORS)

    def _tried(self) -> DataFrame:
        return self._read(list(self._ledger()[1]["parts"].values()))

    def _recovered(self) -> DataFrame:
        """What retries have brought, the first success of a chunk."""
        return self._read(self._ledger()[1]["retries"]).filter("embedding is not null")

    def vectors(self) -> DataFrame:
        """(doc_id, chunk_id, embedding) of all chunks embedded so far."""
        return self._tried().filter("embedding is not null").unionByName(self._recovered()).select("doc_id", "chunk_id", "embedding")

    def failed(self) -> DataFrame:
        """(doc_id, chunk_id) of chunks that were tried and have no vector."""
        return self._tried().filter("embedding is null").select("doc_id", "chunk_id").join(self._recovered().select("chunk_id"), "chunk_id", "left_anti").select("doc_id", "chunk_id")

    def progress(self, chunks: DataFrame) -> DataFrame:
        """(doc_id, total, completed, failed, checkpoint, tier, status): checkpoint is the last batch that is done, -1 if none is; status is in_progress
        while batches are missing, else as `embedding.job_status` says."""
        version, entry = self._ledger()
        totals = self._dealt(chunks, entry).groupBy("doc_id").agg(F.count("*").alias("total"))
        tried = self._tried().groupBy("doc_id").agg(F.count("*").alias("tried"), F.max("batch").alias("last"))
        bad = self.failed().groupBy("doc_id").agg(F.count("*").alias("failed"))
        out = totals.join(tried, "doc_id", "left").join(bad, "doc_id", "left").select("doc_id", "total", F.coalesce("tried", F.lit(0)).alias("tried"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("last", F.lit(-1)).alias("checkpoint"))
        done = F.col("tried") - F.col("failed")
        status = F.when(F.col("tried") < F.col("total"), "in_progress").otherwise(embedding.job_status(F.col("total"), done, F.col("failed")))
        return out.select("doc_id", "total", done.alias("completed"), "failed", "checkpoint", embedding.tier(F.col("total")).alias("tier"), status.alias("status"))
