"""One object over a library of documents: ingest, search, answer, multi-hop answer, analysis, evaluation. Every call works on a batch of queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.shipping import ship
from .functions.workspace import written
from .operators import agent, chunking, context, embedding, evaluate, index, lexical_index, retrieval, stats, understanding, verify
from .operators.lexical_index import LexicalIndex
from .streaming.ingest import Ingest

SOURCE = ["chunk_id", "doc_id", "source", "page_number", "chunk_index", "char_start", "char_end", "text"]


class Engine:
    def __init__(self, spark: SparkSession, documents: DataFrame, strategy: str = "fixed", size: int | None = None, overlap: int | None = None, user_id=None):
        """documents (doc_id, text, source, ...). With a user_id only this user's rows (column user_id) exist for the engine: every chunk, statistic
        and answer is taken over them alone. Chunks and the word index are written at first use and read from then on."""
        ship(spark)
        if user_id is not None:
            documents = index.where_equal(documents, {"user_id": user_id})
        self.spark, self.documents, self._library = spark, documents, None
        self._chunked = lambda: written(chunking.chunks(documents, strategy, size, overlap).join(documents.select("doc_id", "source"), "doc_id"), "chunks")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """An engine over the library that `streaming.ingest.Ingest` keeps in this folder: its chunks and its word index as they are now."""
        library = Ingest(spark, path)
        engine = cls(spark, library.chunks.table().select("doc_id", "source", "text"))
        engine._library, engine._chunked = library, lambda: library.chunks.table()
        return engine

    @functools.cached_property
    def chunks(self) -> DataFrame:
        return self._chunked()

    @functools.cached_property
    def lexical(self) -> LexicalIndex:
        return self._library.lexical if self._library else lexical_index.build(self.chunks)

    def candidates(self, queries: DataFrame, n: int = 50) -> DataFrame:
        """Hybrid candidates of queries (query_id, text, and doc_id if some ask one document): those with a doc_id get chunks of this document only,
        ranked by its own word statistics."""
        if "doc_id" not in queries.columns:
            return retrieval.hybrid(queries, self.chunks, n, self.lexical)
        tied = queries.filter("doc_id is not null").select("query_id", "text", "doc_id")
        own = self.chunks.join(tied.select("doc_id").distinct(), "doc_id", "left_semi")
        inside = retrieval.rrf_fuse(retrieval.dense_in_documents(tied, own, n), retrieval.bm25_top(tied.withColumn("scope", F.col("doc_id")), own, n, F.col("doc_id")), n)
        free = retrieval.hybrid(queries.filter("doc_id is null").select("query_id", "text"), self.chunks, n, self.lexical)
        return free.unionByName(retrieval.hydrate(inside, own, *[c for c in free.columns if c not in inside.columns]))

    def search(self, queries: DataFrame, k: int = 8, rewrites: DataFrame | None = None, diverse: float | None = None) -> DataFrame:
        """Hybrid retrieval and reranking of queries (query_id, text; doc_id).

        rewrites (query_id, text): other wordings; each is searched and the lists are fused. diverse: the k hits are chosen from the reranked
        candidates by maximal marginal relevance with this weight of relevance.
        """
        k = max(1, min(k, 50))
        pool = retrieval.pool_size(k)
        hits = self.candidates(queries, pool) if rewrites is None else self._rewritten(queries, rewrites, pool)
        ranked = retrieval.lexical_rerank(hits, queries, k if diverse is None else pool)
        if diverse is not None:
            vectors = embedding.dense_vectors(ranked.select("chunk_id", "text").distinct(), "chunk_id")
            pool_of = ranked.join(vectors, "chunk_id").select("query_id", "chunk_id", F.col("rank").alias("place"), F.col("reranker_score").alias("relevance"), "embedding")
            ranked = ranked.drop("rank").join(retrieval.mmr(pool_of, k, diverse), ["query_id", "chunk_id"])
        ranked = ranked.join(self.chunks.select("chunk_id", "source"), "chunk_id")
        return ranked.select("query_id", "rank", *SOURCE, "dense_rank", "bm25_rank", "fused_score", "reranker_score")

    def _rewritten(self, queries: DataFrame, rewrites: DataFrame, pool: int) -> DataFrame:
        """Candidates of all wordings, fused by reciprocal ranks; the legs' ranks are those of the query's own wording."""
        own = queries.withColumn("wording", F.lit(0))
        names = [c for c in queries.columns if c != "text"]
        other = rewrites.select("query_id", "text").join(queries.select(*names), "query_id").withColumn("wording", F.row_number().over(Window.partitionBy("query_id").orderBy("text")))
        every = written(own.unionByName(other.select(*own.columns)).withColumn("of", F.col("query_id")).withColumn("query_id", F.concat_ws("#", "query_id", "wording")), "wordings")
        found = written(self.candidates(every.drop("of", "wording"), pool).join(every.select("query_id", "of", "wording"), "query_id").drop("query_id").withColumnRenamed("of", "query_id"), "wordings-hits")
        fused = retrieval.fuse_lists(found.select("query_id", F.col("wording").alias("list_id"), "chunk_id", F.col("place").alias("rank"))).filter(F.col("place") <= pool)
        legs = found.filter("wording = 0").select("query_id", "chunk_id", "dense_rank", "bm25_rank")
        hits = fused.join(legs, ["query_id", "chunk_id"], "left")
        return retrieval.hydrate(hits, self.chunks, *[c for c in SOURCE if c not in ("chunk_id", "source")])

    def retrieve(self, queries: DataFrame, k: int = 8, thin: int = 3, **searching) -> DataFrame:
        """Sources of queries as answers need them: column leg says how they were found.

        whole: the query asks for a whole document that it names by doc_id, and gets all of its chunks in order (400 at most). local: as search
        finds them. retry: definitional and informational queries with fewer than `thin` local hits are searched once more in broadened words, and
        what is new comes after the hits they have.
        """
        asked = written(self.understand(queries), "asked")
        wide = F.lit(False)
        if "doc_id" in asked.columns:
            there = asked.join(self.chunks.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id").withColumn("there", F.lit(True))
            asked, wide = asked.join(there, "query_id", "left"), (F.col("scope") == "global") & F.col("there").isNotNull()
        local = asked.filter(~F.coalesce(wide, F.lit(False)))
        names = [c for c in ("query_id", "text", "doc_id") if c in asked.columns]
        first = written(self.search(local.select(*names), k, **searching).withColumn("leg", F.lit("local")), "hits")
        counts = first.groupBy("query_id").agg(F.count("*").alias("n"))
        again = local.join(counts, "query_id", "left").filter((F.coalesce("n", F.lit(0)) < thin) & F.col("kind").isin("definitional", "informational"))
        again = again.withColumn("wider", understanding.broadened(F.col("text"))).filter(F.lower("wider") != F.lower(T.strip(F.col("text"))))
        again = written(again.withColumn("text", F.col("wider")).select(*names, F.coalesce("n", F.lit(0)).alias("n")), "thin")
        out = first
        if not again.isEmpty():
            more = self.search(again.drop("n"), k).join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(again.select("query_id", "n"), "query_id")
            place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + F.col("n")
            out = out.unionByName(more.withColumn("rank", place.cast("int")).drop("n").withColumn("leg", F.lit("retry")))
        if "doc_id" in asked.columns:
            whole = retrieval.whole_document(asked.filter(wide), self.chunks).withColumnRenamed("place", "rank").withColumn("leg", F.lit("whole"))
            out = out.unionByName(whole.select("query_id", "rank", *SOURCE, "fused_score", "leg"), allowMissingColumns=True)
        return out

    def understand(self, queries: DataFrame) -> DataFrame:
        """queries with kind, task and scope."""
        q = F.col("text")
        task = understanding.answer_task(q)
        return queries.withColumns({"kind": understanding.query_type(q), "task": task, "scope": understanding.retrieval_scope(q, task)})

    def widened(self, sources: DataFrame, window: int = 1) -> DataFrame:
        """Sources with the text of their neighbours in the document; labels and ranks stay those of the source itself."""
        merged = context.expand(sources.withColumn("key", F.struct("query_id", "rank")), self.chunks, window)
        return sources.drop("text").join(merged.select("key.query_id", "key.rank", F.col("merged_text").alias("text")), ["query_id", "rank"])

    def answer(self, queries: DataFrame, k: int = 8, hits: DataFrame | None = None, replies: DataFrame | None = None, judge: DataFrame | None = None, **searching) -> dict[str, DataFrame]:
        """Extractive answers with citations of their sources, checked: tables answers, sources, citations, copied, prompts, signals.

        Sources come from `retrieve` (searching: its rewrites and diverse), or are hits. Prompts hold the sources with their neighbours, within the budgets of context and input. replies (query_id, reply): what a verifier said of
        the answers; without one, groundedness counts as not verified. judge: replies on single citations, as `verify.validate` takes them.
        """
        sources = written(self.retrieve(queries, k, **searching) if hits is None else hits, "sources")
        asked = self.understand(queries)
        thin = sources.groupBy("query_id").agg((F.count("*") < 2).alias("thin"))
        asked = asked.join(thin, "query_id", "left").withColumn("thin", F.coalesce("thin", F.lit(True)))
        prompts = context.prompts(self.widened(sources), asked, context.INPUT_TOKENS, context.CONTEXT_TOKENS)
        answers = written(cite(evaluate.extractive_answers(queries, sources), sources).withColumnRenamed("query_id", "answer_id"), "answers")
        own = sources.withColumnRenamed("query_id", "answer_id")
        citations = verify.validate(answers, own, judge)
        return {"answers": answers, "sources": sources, "citations": citations, "copied": verify.verbatim(answers, own), "prompts": prompts, "signals": self.signals(answers, sources, citations, replies)}

    def signals(self, answers: DataFrame, sources: DataFrame, citations: DataFrame, replies: DataFrame | None = None) -> DataFrame:
        """(answer_id, retrieval, n_valid, n_dropped, groundedness, verified, citation_coverage, capped): how far an answer can be trusted."""
        scores = {"reranker_score", "fused_score"} - set(sources.columns)
        found = retrieval.retrieval_signal(sources.withColumns({c: F.lit(None).cast("double") for c in scores})).withColumnRenamed("query_id", "answer_id")
        valid, dropped = F.col("state") == "valid", (F.col("state") == "dropped") & F.col("chunk_id").isNotNull()
        states = citations.groupBy("answer_id").agg(F.count_if(valid).alias("n_valid"), F.count_if(dropped).alias("n_dropped"))
        rows = answers.join(found, "answer_id", "left").join(states, "answer_id", "left")
        if replies is not None:
            rows = rows.join(replies.select(F.col("query_id").alias("answer_id"), "reply"), "answer_id", "left")
        said = verify.groundedness(F.col("reply") if replies is not None else F.lit(None).cast("string"), F.col("answer"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        rows = rows.withColumn("said", said).select("answer_id", F.coalesce("signal", F.lit(0.0)).alias("retrieval"), zero("n_valid").alias("n_valid"), zero("n_dropped").alias("n_dropped"), F.col("said.confidence").alias("groundedness"), F.col("said.verified").alias("verified"))
        return verify.confidence(rows)

    def agent_answer(self, queries: DataFrame, k: int = 5) -> dict[str, DataFrame]:
        gathered = agent.run_offline(queries, lambda q: self.search(q, k).select("query_id", "chunk_id", "rank"))
        plain = self.search(queries, k).select("query_id", "chunk_id", "rank")
        found = gathered.select("query_id", "chunk_id", F.col("seen").alias("rank")).unionByName(agent.fallback(queries, gathered, plain))
        sources = found.join(self.chunks, "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "source", "page_number", "chunk_index", "char_start", "char_end", "text")
        return self.answer(queries, k, sources) | {"steps": agent.offline_plan(queries), "gathered": gathered}

    def analysis(self) -> dict[str, DataFrame]:
        return {"sizes": stats.sizes(self.chunks, "doc_id"), "histogram": stats.histogram(self.chunks, "doc_id"), "overlap": stats.overlap_coverage(self.chunks), "listing": stats.listing(self.chunks)}

    def evaluate(self, queries: DataFrame, snippets: DataFrame, k: int = 5) -> dict[str, DataFrame]:
        truth = evaluate.ground_truth(snippets, self.chunks)
        per = evaluate.retrieval_metrics(queries, self.search(queries, k), truth, k)
        return {"truth": truth, "unmatched": evaluate.unmatched(snippets, truth), "per_query": per, "summary": per.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall_at_k", "recall_at_1", "reciprocal_rank", "precision_at_k")])}


def cite(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with the number of the first source that holds each sentence put before its end mark."""
    said = answers.select("query_id", F.posexplode(F.split("answer", r"(?<=[.!?])\s+")).alias("at", "sentence")).filter("sentence <> ''")
    met = said.join(sources.select("query_id", "rank", "text"), "query_id", "left").groupBy("query_id", "at", "sentence").agg(F.min(F.when(F.contains("text", F.col("sentence")), F.col("rank"))).alias("rank"))
    marked = F.when(F.col("rank").isNull(), F.col("sentence")).otherwise(F.concat(F.regexp_replace("sentence", r"[.!?]$", ""), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"), F.regexp_extract("sentence", r"([.!?]?)$", 1)))
    joined = met.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", marked.alias("s")))), lambda x: x["s"]), " ").alias("answer"))
    return answers.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
