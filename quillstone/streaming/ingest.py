"""Ingestion as a stream of files: each batch is cleaned, chunked, embedded and put into the collections and the word index, once, however often it is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.workspace import written
from ..operators import chunking, embedding, index
from ..operators.lexical_index import LexicalIndex
from ..sources.store import Collection

CHUNKS = "chunk_id string, doc_id long, chunk_index int, char_start int, char_end int, text string, content_hash string, token_count int, page_number int, source string"
VECTORS = "chunk_id string, doc_id long, embedding array<float>"
#: A word index of more segments than this is made one.
MOST_SEGMENTS = 16


class Ingest:
    """A library in a folder: chunks, vectors and postings. foreachBatch writes carry the stream's name and the batch's number, so a batch that is
    replayed after a failure goes on where it stopped and changes nothing that it has changed already. Chunks whose content hash is unchanged are not
    embedded again; chunks that their document no longer has are removed. Of a batch's texts with one doc_id the largest counts, so that a replay
    takes the same one. A batch of new documents is put beside what is there; any other rewrites the buckets of its own documents only.
    """

    def __init__(self, spark: SparkSession, path: str, strategy: str = "fixed", buckets: int = 16):
        self.strategy = strategy
        self.chunks = Collection(spark, f"{path}/chunks", CHUNKS, bucket_by="doc_id", buckets=buckets)
        self.vectors = Collection(spark, f"{path}/vectors", VECTORS, bucket_by="doc_id", buckets=buckets)
        self.lexical = LexicalIndex(spark, f"{path}/lexical")

    def batch(self, docs: DataFrame, batch_id: int | None = None, name: str = "batch") -> None:
        """batch_id None: not a stream's batch, and never skipped."""
        mark = None if batch_id is None else (name, batch_id)
        source = F.max("source") if "source" in docs.columns else F.lit(None).cast("string")
        docs = docs.filter("doc_id is not null")
        sources = written(docs.groupBy("doc_id").agg(source.alias("source")), "batch")
        # the texts are shuffled once, by document, and chunks stay in the tasks of their documents until they are written
        texts = docs.groupBy("doc_id").agg(T.clean(F.coalesce(F.max("text"), F.lit(""))).alias("text"))
        snap = self.chunks.snapshot()
        staged, new = self.chunks.stage(chunking.chunks(texts, self.strategy).join(sources, "doc_id"), snap)
        current = self.chunks._rows(snap, self.chunks.buckets_of(sources, snap)).join(sources, "doc_id", "left_semi")
        if current.select("doc_id").isEmpty():
            self._first(new, staged, snap, mark)
        else:
            self._changed(new, current, mark)
        self.vectors.merge()
        self.chunks.merge()
        if len(self.lexical.segments()) > MOST_SEGMENTS:
            self.lexical.compact()

    def _first(self, new: DataFrame, staged: dict[str, str], snap: dict, mark: tuple[str, int] | None) -> None:
        """Documents that are all new: what is there already is neither compared nor rewritten."""
        if not staged:
            return
        at = self.vectors.snapshot()
        if mark is None or at["batches"].get(mark[0], -1) < mark[1]:
            self.vectors.add(self.vectors.stage(embedding.dense_vectors(new, "chunk_id", keep=("doc_id",)), at)[0], at["version"], mark)
        self.lexical.apply(new, batch=mark)
        self.chunks.add(staged, snap["version"], mark)  # last: it is what the next batch compares with

    def _changed(self, new: DataFrame, current: DataFrame, mark: tuple[str, int] | None) -> None:
        plan = written(index.reconcile(current, new).filter("action <> 'unchanged'"), "plan")
        if plan.isEmpty():
            return
        rows = written(new.join(plan.filter("action = 'upsert'"), "chunk_id", "left_semi"), "rows")
        stale = written(current.join(plan, "chunk_id", "left_semi").select("chunk_id", "doc_id", "text"), "stale")
        self.vectors.replace(embedding.dense_vectors(rows, "chunk_id", keep=("doc_id",)), stale, mark)
        self.lexical.apply(rows, stale, batch=mark)
        self.chunks.replace(rows, stale, mark)  # last: it is what the next batch compares with

    def stream(self, source: DataFrame, checkpoint: str, available_now: bool = True):
        """Starts the stream; its checkpoint says which files are done, and its path names the stream's batches."""
        writer = source.writeStream.foreachBatch(lambda docs, n: self.batch(docs, n, checkpoint)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", files_per_batch).parquet(path)
