"""Batch retrieval: dense and BM25 legs, reciprocal rank fusion, hydration, reranking, diversification, routing helpers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.workspace import written
from . import embedding, lexical_index
from .lexical_index import LexicalIndex

#: Chunks that meet a block of queries at a time.
CHUNK_ROWS = 1_024
RRF_K, DENSE_CAP, WHOLE_DOCUMENT_CAP = 60, 100, 400


def top_by(rows: DataFrame, group: str, order: list[Column], n: int, name: str) -> DataFrame:
    """The first n rows of each group with their place; Spark cuts groups before the shuffle as well."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= n)


def _ids(rows: list, queries: DataFrame) -> pa.Array:
    return pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType))


def _best(ids: pa.Array, n: int):
    """Makes a function of a block's scores (queries, chunks; -inf: none) and chunk_ids that passes on what is among each query's n best of all blocks
    so far, and what ties with the last of them."""

    def keep():
        best = np.full((len(ids), n), -np.inf)

        def passed(score: np.ndarray, chunk_ids: pa.Array) -> pa.RecordBatch:
            nonlocal best
            best = -np.partition(-np.concatenate([best, score], 1), n - 1, 1)[:, :n]
            q, c = np.nonzero((score > -np.inf) & (score >= best[:, n - 1 :]))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunk_ids.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

        return passed

    return keep


def _cosines(queries: np.ndarray, best):
    """For blocks of chunks (chunk_id, plain text): what `best`, made anew for a task, keeps of all queries' scores."""
    lengths = np.maximum((queries * queries).sum(1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = best()
        for whole in batches:
            for start, x in embedding.counted_in_blocks(whole.column("text"), CHUNK_ROWS):
                # counts are integers, so products are exact; a text without words is no one's neighbour
                norms = np.sqrt(lengths[:, None] * np.maximum((x * x).sum(1), 1))
                score = np.floor((queries @ x.T) / norms * 1e9 + 0.5) / 1e9
                yield keep(np.where(score > 0, score, -np.inf), whole.column("chunk_id").slice(start, CHUNK_ROWS))

    return run


def in_blocks(asked: DataFrame, most: int) -> Iterator[list]:
    """The rows of a table of queries in blocks of about `most`, by a hash of the query's id, one block after another. An empty table is one empty block."""
    rows = asked.limit(most + 1).collect()
    if len(rows) <= most:
        yield rows
        return
    blocks = -(-asked.count() // most)
    for b in range(blocks):
        yield asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()


def _united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def dense_top(queries: DataFrame, chunks: DataFrame, n: int = 50, block_queries: int = 4096) -> DataFrame:
    """(query_id, chunk_id, score, dense_rank) by cosine of hashed word counts; chunks that share no bucket with a query are not ranked.

    Queries go in blocks of about block_queries, which travel with the code as a matrix and meet all chunks in blocks, each of which passes on its
    best: nothing else is shuffled. Products are integers, so scores don't depend on the order of summation. A chunk_id names one chunk; the texts of
    repeated query_ids are one query.
    """
    n = min(n, DENSE_CAP)
    words = T.words(F.coalesce("text", F.lit("")))
    asked = queries.groupBy("query_id").agg(F.flatten(F.collect_list(words)).alias("words")).filter(F.size("words") > 0)
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks = chunks.select("chunk_id", T.plain(F.col("text")).alias("text"))
    parts = []
    for rows in in_blocks(asked, block_queries):
        matrix = embedding.counted(pa.array([r["words"] for r in rows], pa.list_(pa.string())))
        parts.append(blocks.mapInArrow(_cosines(matrix, _best(_ids(rows, queries), n)), f"query_id {kind}, chunk_id string, score double"))
    scored = _united(parts)
    return top_by(scored, "query_id", [F.col("score").desc(), F.col("chunk_id")], n, "dense_rank")


def bm25_top(queries: DataFrame, chunks: DataFrame | LexicalIndex, n: int = 50, scope: Column | None = None, block_queries: int = 4096) -> DataFrame:
    """(query_id, chunk_id, score, bm25_rank). Only chunks with a query word are ranked; repeated query words count as often as they occur.

    chunks: a stored index, or a table, which is read once for its statistics and once for each block of queries, as in `dense_top`; with a scope, a
    table is indexed for this call. Inverse document frequencies below 0 are set to a quarter of the mean over the
    scope's vocabulary. Queries have a column `scope` if one is given (for a stored index: any column, its scopes are those it was made with):
    statistics are the scope's own.
    """
    if scope is not None or isinstance(chunks, LexicalIndex):
        stored = chunks if isinstance(chunks, LexicalIndex) else lexical_index.build(chunks, scope)
        return stored.search(queries, n, scoped=scope is not None)
    asked = lexical_index.table_weights(queries, chunks).groupBy("query_id").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("term", "weight")).alias("words"))
    asked = written(asked, "weights")
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks, parts = chunks.select("chunk_id", T.plain(F.col("text")).alias("text")), []
    for rows in in_blocks(asked, block_queries):
        words = [[(w["term"], w["weight"]) for w in r["words"]] for r in rows]
        run = lexical_index.scan(words, rows[0]["avgdl"] if rows else 1.0, _best(_ids(rows, queries), n))
        parts.append(blocks.mapInArrow(run, f"query_id {kind}, chunk_id string, score double"))
    return top_by(_united(parts), "query_id", [F.col("score").desc(), F.col("chunk_id")], n, "bm25_rank")


def dense_in_documents(queries: DataFrame, chunks: DataFrame, n: int = 50) -> DataFrame:
    """dense_top of queries (query_id, text, doc_id) over the chunks of their own documents, by a join on document and bucket."""
    asked = embedding.sparse_vectors(queries, "query_id").join(queries.select("query_id", "doc_id"), "query_id")
    own = chunks.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    held = embedding.sparse_vectors(own, "chunk_id").join(own.select("chunk_id", "doc_id"), "chunk_id")
    asked = asked.select("query_id", "doc_id", "bucket", F.col("tf").alias("q_tf"), F.col("norm2").alias("q_norm2"))
    met = held.join(asked, ["doc_id", "bucket"]).groupBy("query_id", "chunk_id", "norm2", "q_norm2").agg(F.sum(F.col("tf") * F.col("q_tf")).alias("both"))
    score = F.floor(F.col("both") / F.sqrt(F.col("norm2").cast("double") * F.col("q_norm2")) * 1e9 + 0.5) / 1e9
    return top_by(met.select("query_id", "chunk_id", score.alias("score")), "query_id", [F.col("score").desc(), F.col("chunk_id")], min(n, DENSE_CAP), "dense_rank")


def rrf_fuse(dense: DataFrame, lexical: DataFrame, n: int = 50, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, dense_rank, bm25_rank, fused_score, place); an empty leg leaves the other's order."""
    both = dense.select("query_id", "chunk_id", "dense_rank").join(lexical.select("query_id", "chunk_id", "bm25_rank"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused_score", part("dense_rank") + part("bm25_rank"))
    order = [F.round("fused_score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col("chunk_id")]
    return top_by(both, "query_id", order, n, "place")


def fuse_lists(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fused_score, place) from any number of ranked lists (query_id, list_id, chunk_id, rank)."""
    summed = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("fused_score"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")))


def hydrate(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with their chunks' columns; hits whose chunk is gone are dropped."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def hybrid(queries: DataFrame, chunks: DataFrame, n: int = 50, lexical: LexicalIndex | None = None) -> DataFrame:
    """Both legs, fused and with the chunks' columns. Chunks are read by each leg and once more, so they should be a stored table; lexical: their index."""
    fused = rrf_fuse(dense_top(queries, chunks, n), bm25_top(queries, chunks if lexical is None else lexical, n), n)
    return hydrate(written(fused, "fused"), chunks, "doc_id", "text", "chunk_index", "char_start", "char_end", "page_number")


def lexical_rerank(candidates: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """The k candidates that share most distinct content words with the query; earlier place first among equals."""
    q = queries.select("query_id", F.array_distinct(T.content_words(F.col("text"))).alias("q_words"))
    shared = F.size(F.array_intersect("q_words", F.array_distinct(T.content_words(F.col("text")))))
    scored = candidates.join(q, "query_id").withColumn("reranker_score", shared.cast("double")).drop("q_words")
    return top_by(scored, "query_id", [F.col("reranker_score").desc(), F.col("place")], k, "rank")


def rerank_with(candidates: DataFrame, queries: DataFrame, predict, k: int = 8) -> DataFrame:
    """Reranking by a model (list of (query, text) -> scores) on the executors; where it fails, the input order stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                scores = list(map(float, predict(list(zip(frame["q"], frame["text"], strict=True)))))
            except Exception:
                scores = [None] * len(frame)
            yield frame[["query_id", "chunk_id", "place"]].assign(reranker_score=pd.Series(scores, index=frame.index, dtype="float64"))

    joined = candidates.join(queries.select("query_id", F.col("text").alias("q")), "query_id").select("query_id", "chunk_id", "place", "q", "text")
    kind = joined.schema["query_id"].dataType.simpleString()
    scored = joined.mapInPandas(run, f"query_id {kind}, chunk_id string, place int, reranker_score double")
    return top_by(scored, "query_id", [F.col("reranker_score").desc_nulls_last(), F.col("place")], k, "rank")


def mmr(candidates: DataFrame, k: int = 5, weight: float = 0.7, scaled: bool = True) -> DataFrame:
    """(query_id, chunk_id, rank): maximal marginal relevance over candidates (query_id, chunk_id, place, relevance, embedding), best first.

    The first candidate is always chosen; relevance is scaled to 0..1 (all 1 if constant); ties go to the earlier candidate. All candidates come back
    in order if there are no more than k, the first k if weight is 1 or more. A query's candidates are a bounded list, so each is one group.
    scaled false: relevance lies in 0..1 already and is taken as given, and lists of no more than k are ordered like longer ones.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        n = len(frame)
        if (scaled and k >= n) or weight >= 1:
            chosen = list(range(min(k, n)))
        else:
            rel = frame["relevance"].to_numpy(float)
            if scaled:
                low, high = rel.min(), rel.max()
                rel = np.ones(n) if high - low < 1e-12 else (rel - low) / (high - low)
            x = np.stack([np.asarray(v, float) for v in frame["embedding"]])
            length = np.linalg.norm(x, axis=1)
            unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
            chosen, nearest = [0], unit @ unit[0]
            while len(chosen) < min(k, n):
                score = weight * rel - (1 - weight) * nearest
                score[chosen] = -np.inf
                chosen.append(int(np.argmax(np.round(score, 12))))
                nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        picked = frame.iloc[chosen]
        return pd.DataFrame({"query_id": picked["query_id"], "chunk_id": picked["chunk_id"], "rank": np.arange(1, len(picked) + 1, dtype=np.int32)})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, rank int")


def whole_document(queries: DataFrame, chunks: DataFrame, cap: int = WHOLE_DOCUMENT_CAP) -> DataFrame:
    """All chunks of each query's document (queries: query_id, doc_id) in order, with a fused score of 1."""
    met = queries.select("query_id", "doc_id").join(chunks, "doc_id")
    return top_by(met, "query_id", [F.col("chunk_index")], cap, "place").withColumn("fused_score", F.lit(1.0))


def pool_size(k: int | Column, caller: str = "search") -> int | Column:
    """Candidates fetched before reranking."""
    if isinstance(k, Column):
        return {"search": F.least(6 * k, F.lit(50)), "answer": F.lit(50), "evaluation": F.greatest(10 * k, F.lit(50))}[caller]
    return {"search": min(6 * k, 50), "answer": 50, "evaluation": max(10 * k, 50)}[caller]


def thin_retry(first: DataFrame, second: DataFrame, kinds: DataFrame, least: int = 3) -> DataFrame:
    """Hits of `first` (query_id, chunk_id, place), and for definitional and informational queries with fewer than `least`, unseen ones of `second` after them."""
    counts = kinds.join(first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("place").alias("last")), "query_id", "left")
    thin = counts.filter((F.coalesce("n", F.lit(0)) < least) & F.col("kind").isin("definitional", "informational")).select("query_id", F.coalesce("last", F.lit(0)).alias("last"))
    more = second.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(thin, "query_id")
    place = F.col("last") + F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return first.select("query_id", "chunk_id", "place").unionByName(more.withColumn("place", place.cast("int")).select("query_id", "chunk_id", "place"))


def route(queries: DataFrame, local: DataFrame, whole: DataFrame) -> DataFrame:
    """Queries (query_id, scope, doc_id): the whole document where the scope is global and a document is named, else the local hits."""
    wide = (F.col("scope") == "global") & F.col("doc_id").isNotNull()
    a = whole.join(queries.filter(wide).select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", "place", F.lit("whole").alias("leg"))
    b = local.join(queries.filter(~F.coalesce(wide, F.lit(False))).select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", "place", F.lit("local").alias("leg"))
    return a.unionByName(b)


def relevance_score(reranker: Column, fused: Column) -> Column:
    return F.coalesce(reranker, fused)


def retrieval_signal(hits: DataFrame) -> DataFrame:
    """(query_id, signal): sigmoid of the best reranker score, else 30 times the best fused score, at most 1."""
    best = hits.groupBy("query_id").agg(F.max("reranker_score").alias("r"), F.max("fused_score").alias("f"))
    return best.select("query_id", F.round(F.when(F.col("r").isNotNull(), 1 / (1 + F.exp(-F.col("r")))).otherwise(F.least(F.lit(1.0), F.col("f") * 30)), 3).alias("signal"))


def merge_backends(parts: list[DataFrame], n: int) -> DataFrame:
    """The n nearest hits (query_id, chunk_id, distance, backend) of several backends' own n nearest; an unreachable backend is left out by its caller."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_by(every, "query_id", [F.col("distance"), F.col("chunk_id"), F.col("backend")], n, "place")
