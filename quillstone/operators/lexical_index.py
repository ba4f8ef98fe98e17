"""A stored BM25 index: term-partitioned postings in blocks with maxima, document frequencies as deltas, exact top n with blocks left out by bounds.

Chunks are dealt into shards of at most SHARD chunks of one scope, as they lie in the table. A block holds the postings of one term in one shard: places
in the shard and term frequencies, with the largest frequency and the smallest chunk length as its maxima. Blocks are written by term, so a search
reads those of its own words, and their bounds without their postings.

A change writes a segment: blocks of what it adds, tombstones of what it removes, and signed deltas of document frequencies and of chunk counts and
lengths. Nothing written before is touched. The log of versions names the segments; `compact` writes one from all.

A search is exact. bound(query, shard) is the sum over the query's words of the largest weight that the block's maxima allow under the statistics of
now, 0 at least. Each query's two best shards by bound are scored in full; their n-th best score is a floor under the n-th best of all. A chunk at or
above the floor lies in a shard whose bound is at or above it, because a chunk's parts are at most its blocks' bounds. So only those shards are
scored, with all the query's blocks in them, and the rest are left out unread. Scores, statistics and ties are those of `retrieval.bm25_top`.

Shards and queries meet in groups of one shard and one block of queries: at most SHARD chunks and QUERIES queries, whatever the number of either.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.shipping import ship
from ..functions.workspace import new_folder, shuffle_partitions, written
from ..sources.log import Conflict, Log

K1, B, EPSILON = 1.5, 0.75, 0.25
SHARD, QUERIES = 1_024, 1_024
#: Texts that are counted at a time, and cells of a matrix of queries' words and chunks.
COUNTED, MOST_CELLS = 4_096, 4_000_000
#: Shards of each query that are scored to find the floor.
FIRST = 2
#: Up to so many distinct words, a search also hands them to the Parquet readers, which skip row groups without them.
PUSHED_WORDS = 2_000
BLOCKS = "scope string, term string, shard string, n int, max_tf int, min_dl int, places array<int>, tfs array<int>"
DOCS = "scope string, shard string, n int, chunk_ids array<string>, dls array<int>"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
MARKED = "kind int, " + BLOCKS + ", chunk_ids array<string>, dls array<int>"


def _sharded(size: int):
    """(scope, chunk_id, plain text) to the blocks (kind 0) and the documents (kind 1) of shards."""
    schema = pa.schema([("kind", pa.int32()), ("scope", pa.string()), ("term", pa.string()), ("shard", pa.string()), *[(c, pa.int32()) for c in ("n", "max_tf", "min_dl")], *[(c, pa.list_(pa.int32())) for c in ("places", "tfs")], ("chunk_ids", pa.list_(pa.string())), ("dls", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes = batch.column("scope").dictionary_encode()
            codes = scopes.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                if not len(mine):
                    continue
                scope = scopes.dictionary[int(codes[mine[0]])].as_py()
                for at in range(0, len(mine), size):
                    rows = batch.take(pa.array(mine[at : at + size]))
                    lists = T.split_words(rows.column("text"))
                    offsets = lists.offsets.to_numpy()
                    dls, name = np.diff(offsets).astype(np.int32), uuid.uuid4().hex
                    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                    keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(len(dls)), dls), return_counts=True)
                    term, place = keys // size, (keys % size).astype(np.int32)
                    first = np.flatnonzero(np.diff(term, prepend=-1))
                    bounds, k = pa.array(np.append(first, len(keys)).astype(np.int32)), len(first)
                    if k:
                        fill = lambda x, t: pa.array([x] * k, t)
                        yield pa.RecordBatch.from_arrays([
                            fill(0, pa.int32()), fill(scope, pa.string()), words.dictionary.take(pa.array(term[first])), fill(name, pa.string()), pa.array(np.diff(np.append(first, len(keys))).astype(np.int32)),
                            pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), pa.array(np.minimum.reduceat(dls[place], first)), pa.ListArray.from_arrays(bounds, pa.array(place)), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32))),
                            pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, pa.list_(pa.int32())),
                        ], schema=schema)
                    ids = rows.column("chunk_id").to_pylist()
                    yield pa.RecordBatch.from_pylist([{"kind": 1, "scope": scope, "shard": name, "n": len(ids), "chunk_ids": ids, "dls": dls.tolist()}], schema=schema)

    return run


def _scored(n: int, kind: pa.DataType):
    """For one shard and one block of queries: each query's n best chunks of the shard, and what ties with the last of them.

    Parts are whole multiples of 1e-10, which a double adds up exactly.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], kind), pa.array([], pa.string()), pa.array([], pa.float64())], ["query_id", "chunk_id", "score"])
        docs = left.filter(pc.equal(left["kind"], 1))
        blocks = left.filter(pc.equal(left["kind"], 0))
        if not len(docs) or not len(blocks) or not len(right):
            return none
        ids, dls = docs["chunk_ids"][0].values, docs["dls"][0].values.to_numpy().astype(float)
        live = ~np.isin(np.arange(len(ids)), docs["places"][0].values.to_numpy() if docs["places"][0].is_valid else [])
        terms, lists = blocks["term"].combine_chunks(), [blocks[c].combine_chunks() for c in ("places", "tfs")]
        at = lists[0].offsets.to_numpy().astype(np.int64)
        place, tf = (x.values.to_numpy() for x in lists)
        names, words = right["query_id"].combine_chunks(), right["words"].combine_chunks()
        block = pc.fill_null(pc.index_in(words.flatten().field("term"), terms), -1).to_numpy()
        asked = block >= 0
        query = np.repeat(np.arange(len(names)), np.diff(words.offsets.to_numpy()))[asked]
        block, weight, avgdl = block[asked].astype(np.int64), words.flatten().field("weight").to_numpy()[asked], right["avgdl"].to_numpy()[query]
        size = at[block + 1] - at[block]
        entry = np.repeat(at[block] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        spread = lambda x: np.repeat(x, size)
        p, f = place[entry], tf[entry]
        part = spread(weight) * f * (K1 + 1) / (f + K1 * (1 - B + B * dls[p] / spread(avgdl)))
        cell = spread(query).astype(np.int64) * len(ids) + p
        shape = (len(names), len(ids))
        total = np.bincount(cell, np.floor(part * 1e10 + 0.5), shape[0] * shape[1]).reshape(shape)
        met = (np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) > 0) & live
        score = np.where(met, np.floor(total / 1e4 + 0.5) / 1e6, -np.inf)
        if len(ids) > n:
            met &= score >= -np.partition(-score, n - 1, 1)[:, n - 1 : n]
        q, c = np.nonzero(met)
        return pa.table([names.take(pa.array(q)).cast(kind), ids.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

    return run


def scope_column(scope: Column | None) -> Column:
    return F.lit("all") if scope is None else scope.cast("string")


def weighted(queries: DataFrame, frequencies: DataFrame, sizes: DataFrame, scope: Column) -> DataFrame:
    """(query_id, scope, term, weight, avgdl): idf times occurrences of the queries' words.

    Inverse document frequencies below 0 are set to a quarter of the mean over the scope's vocabulary.
    """
    asked = queries.select("query_id", scope.alias("scope"), F.explode(T.words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("times"))
    raw = frequencies.join(sizes, "scope").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floors = raw.groupBy("scope").agg((F.sum("idf") / F.count("*") * EPSILON).alias("floor"))
    met = asked.join(raw, ["scope", "term"]).join(floors, "scope")
    return met.select("query_id", "scope", "term", (F.col("times") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"), "avgdl")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain texts to (term, n, total): in how many of them a term is; without a term, their number and how many words they have."""
    for whole in batches:
        for start in range(0, whole.num_rows, COUNTED):
            lists = T.split_words(whole.column("text").slice(start, COUNTED))
            at = lists.offsets.to_numpy()
            words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
            keys = np.sort(words.indices.to_numpy().astype(np.int64) * len(lists) + np.repeat(np.arange(len(lists)), np.diff(at)))
            n = np.bincount(keys[np.diff(keys, prepend=-1) > 0] // len(lists), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n), pa.array(n)], ["term", "n", "total"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([len(lists)]), pa.array([int(at[-1] - at[0])])], ["term", "n", "total"])


def table_weights(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """`weighted` words of queries in a table of chunks that has no index: one pass over its texts, of which only counts are shuffled."""
    ship(chunks.sparkSession)
    counts = chunks.select(T.plain(F.col("text")).alias("text")).mapInArrow(_frequencies, "term string, n bigint, total bigint")
    counts = written(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("scope", scope_column(None)), "frequencies")
    sizes = counts.filter("term IS NULL").select("scope", "n", (F.col("total") / F.col("n")).alias("avgdl"))
    return weighted(queries, counts.filter("term IS NOT NULL").select("scope", "term", F.col("n").alias("df")), sizes, scope_column(None))


def scan(words: list[list[tuple[str, float]]], avgdl: float, best):
    """For blocks of chunks (chunk_id, plain text): what `best`, made anew for a task, keeps of all queries' scores. words: each query's (term, weight).

    A term's parts are computed once for all queries that give it one weight, and each query adds up the rows of its own. Parts are whole multiples
    of 1e-10, as in `_scored`, which a double adds up exactly.
    """
    pairs = sorted({p for mine in words for p in mine})
    place = {p: i for i, p in enumerate(pairs)}
    own = [np.array(sorted(place[p] for p in mine), np.int64) for mine in words]
    terms = sorted({t for t, _ in pairs})
    weight = np.array([w for _, w in pairs], float)
    first = np.searchsorted(np.array([t for t, _ in pairs], object), np.array([*terms, "\U0010ffff"], object))
    rows = max(64, min(SHARD, MOST_CELLS // max(len(pairs), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, asked = best(), pa.array(terms, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                lists, n = T.split_words(batch.column("text")), batch.num_rows
                at = lists.offsets.to_numpy()
                dls = np.diff(at)
                found = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
                code = pc.fill_null(pc.index_in(found.dictionary, asked), -1).to_numpy()[found.indices.to_numpy()]
                cell, tf = np.unique((code.astype(np.int64) * n + np.repeat(np.arange(n), dls))[code >= 0], return_counts=True)
                term, c = np.divmod(cell, n)
                size = first[term + 1] - first[term]
                pair = np.repeat(first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                c, f = np.repeat(c, size), np.repeat(tf, size)
                part = weight[pair] * f * (K1 + 1) / (f + K1 * (1 - B + B * dls[c].astype(float) / avgdl))
                parts, met = np.zeros((len(pairs), n)), np.zeros((len(pairs), n), bool)
                parts[pair, c], met[pair, c] = np.floor(part * 1e10 + 0.5), True
                score = np.full((len(own), n), -np.inf)
                for q, mine in enumerate(own):
                    score[q] = np.where(met[mine].any(0), np.floor(parts[mine].sum(0) / 1e4 + 0.5) / 1e6, -np.inf)
                yield keep(score, batch.column("chunk_id"))

    return run


class LexicalIndex:
    """index.apply(added, removed) and index.search(queries, n); see the module's text. A chunk_id names one chunk of one scope at a time."""

    def __init__(self, spark: SparkSession, path: str, shard: int = SHARD):
        ship(spark)
        self.spark, self.path, self.shard = spark, path.rstrip("/"), shard
        self.log = Log(spark, f"{self.path}/log")

    def _entries(self) -> dict[str, dict]:
        """Segments in their order, each with what it has: by_term (blocks in the order of terms), removes (tombstones), made (the kinds)."""
        return self.log.latest()[1].get("segments", {})

    def segments(self) -> list[str]:
        return list(self._entries())

    def _read(self, part: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        found = [f"{self.path}/{s}/{part}" for s in (self.segments() if segments is None else segments)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, scope: Column | None = None, batch: tuple[str, int] | None = None, by_term: bool = False) -> bool:
        """Adds and removes chunks (chunk_id, text, and what scope reads) in one commit. removed must carry the text that was added. A chunk that
        changes is in both. A batch (name, number) that is in already is skipped, and the call says False. by_term: blocks are put in the order of
        terms, as `compact` does, so that searches read fewer row groups: for large segments."""
        version, entry = self.log.latest()
        segment, said = f"segments/{uuid.uuid4().hex}", {}
        for attempt in range(5):
            if batch and entry.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return False
            if not attempt:
                said = self._write(segment, added, removed, scope, by_term)
            try:
                self.log.commit(version + 1, {"segments": entry.get("segments", {}) | {segment: said}, "batches": entry.get("batches", {}) | (dict([batch]) if batch else {})})
                return True
            except Conflict:  # another segment was first; this one goes after it
                version, entry = self.log.latest()
        raise Conflict(f"{self.path}: other writers were first")

    def _write(self, segment: str, added: DataFrame | None, removed: DataFrame | None, scope: Column | None, by_term: bool) -> dict:
        """Writes a segment; returns its entry for the log."""
        at = f"{self.path}/{segment}"
        scoped = lambda rows, column: rows.select(F.coalesce(scope_column(scope), F.lit("")).alias("scope"), "chunk_id", column)
        save = lambda df, part: df.write.option("compression", "zstd").parquet(f"{at}/{part}")
        made = scoped(added, T.plain(F.col("text")).alias("text")).mapInArrow(_sharded(self.shard), MARKED) if added is not None else self.spark.createDataFrame([], MARKED)
        # the tasks that make shards write them, in folders of blocks and of documents; a shard's name comes from the attempt that is committed
        made.write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/made")
        made = self.spark.read.schema(MARKED).parquet(f"{at}/made")
        blocks, docs = made.filter("kind = 0"), made.filter("kind = 1").select("scope", "n", F.aggregate("dls", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))
        if by_term:  # of no blocks, an empty folder
            save(blocks.select(*NAMES).repartition("term").sortWithinPartitions("term", "scope"), "blocks")
        df, sizes = blocks.select("scope", "term", F.col("n").cast("long").alias("n")), docs.select("scope", F.col("n").cast("long").alias("n"), "total")
        if removed is not None:
            gone = written(scoped(removed, T.words(F.coalesce("text", F.lit(""))).alias("words")), "removed")
            save(gone.select("chunk_id"), "tombstones")
            df = df.unionByName(gone.select("scope", F.explode(F.array_distinct("words")).alias("term"), F.lit(-1).cast("long").alias("n")))
            sizes = sizes.unionByName(gone.select("scope", F.lit(-1).cast("long").alias("n"), (-F.size("words")).cast("long").alias("total")))
        save(df.groupBy("scope", "term").agg(F.sum("n").alias("df")).filter("df <> 0"), "df")
        save(sizes.groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sizes")
        return {"by_term": by_term, "removes": removed is not None, "made": [x for x in self.log.names(f"{at}/made") if x.startswith("kind=")]}

    def _blocks(self) -> DataFrame:
        found = [f"{self.path}/{s}/{'blocks' if e['by_term'] else 'made/kind=0'}" for s, e in self._entries().items() if "kind=0" in e["made"]]
        return self.spark.read.schema(BLOCKS).parquet(*found) if found else self.spark.createDataFrame([], BLOCKS)

    def frequencies(self) -> DataFrame:
        """(scope, term, df) of what is in the index now: the sum of all deltas."""
        rows = self._read("df", "scope string, term string, df bigint")
        return rows if len(self.segments()) == 1 else rows.groupBy("scope", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def sizes(self) -> DataFrame:
        """(scope, n, avgdl)."""
        rows = self._read("sizes", "scope string, n bigint, total bigint").groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return rows.filter("n > 0").select("scope", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def postings(self) -> DataFrame:
        """(scope, chunk_id, term, tf, dl) of what is in the index now."""
        docs = self._docs().select("shard", "chunk_ids", "dls", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"))
        at = self._blocks().join(docs, "shard").select("scope", "term", "chunk_ids", "dls", "dead", F.explode(F.arrays_zip("places", "tfs")).alias("x"))
        at = at.filter(~F.array_contains("dead", F.col("x.places")))
        return at.select("scope", F.get("chunk_ids", F.col("x.places")).alias("chunk_id"), "term", F.col("x.tfs").cast("long").alias("tf"), F.get("dls", F.col("x.places")).alias("dl"))

    def _docs(self) -> DataFrame:
        """Shards with their chunks and the places of those that a later segment removed (null: none)."""
        entries = self._entries()
        if not entries:
            return self.spark.createDataFrame([], DOCS + ", dead array<int>")
        docs = [self._read("made/kind=1", DOCS, [s] if "kind=1" in e["made"] else []).withColumn("nth", F.lit(i)) for i, (s, e) in enumerate(entries.items())]
        stones = [self._read("tombstones", "chunk_id string", [s]).withColumn("nth", F.lit(i)) for i, (s, e) in enumerate(entries.items()) if e["removes"]]
        every = functools.reduce(DataFrame.unionByName, docs)
        if not stones:
            return every.drop("nth").withColumn("dead", F.lit(None).cast("array<int>"))
        dead = functools.reduce(DataFrame.unionByName, stones)
        last = dead.groupBy("chunk_id").agg(F.max("nth").alias("until"))
        places = every.select("shard", "nth", F.posexplode("chunk_ids").alias("place", "chunk_id")).join(last, "chunk_id").filter("nth < until")
        return every.drop("nth").join(places.groupBy("shard").agg(F.collect_list("place").alias("dead")), "shard", "left")

    def compact(self) -> None:
        """All segments as one, without what was removed: (scope, chunk_id) with their words are put together from the postings."""
        words = self.postings().groupBy("scope", "chunk_id").agg(F.array_join(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))), " ").alias("text"))
        alive = self._docs().select("scope", F.explode(F.array_except(F.col("chunk_ids"), F.transform(F.coalesce("dead", F.array().cast("array<int>")), lambda p: F.get(F.col("chunk_ids"), p)))).alias("chunk_id"))
        version, entry = self.log.latest()
        segment = f"segments/{uuid.uuid4().hex}"
        said = self._write(segment, alive.join(words, ["scope", "chunk_id"], "left"), None, F.col("scope"), by_term=True)
        self.log.commit(version + 1, {"segments": {segment: said}, "batches": entry.get("batches", {})})

    def expire(self) -> None:
        """Deletes what only older versions name; for when no reader is on them."""
        named = {s.split("/")[1] for s in self.segments()}
        for name in self.log.names(f"{self.path}/segments"):
            if name not in named:
                self.log.delete(f"{self.path}/segments/{name}")
        self.log.forget(self.log.versions()[:-1])

    def weights(self, queries: DataFrame, scoped: bool = False) -> DataFrame:
        """`weighted` words of queries under the statistics of now. scoped: queries have a column scope; else all are of 'all'."""
        return weighted(queries, self.frequencies(), self.sizes(), scope_column(F.col("scope") if scoped else None))

    def search(self, queries: DataFrame, n: int = 50, scoped: bool = False, prune: bool = True) -> DataFrame:
        """(query_id, chunk_id, score, bm25_rank) of queries (query_id, text, and scope if scoped). prune=False scores all shards with a word of the query."""
        kind = queries.schema["query_id"].dataType.simpleString()
        weights = written(self.weights(queries, scoped), "weights")
        blocks = self._blocks()
        words = [r["term"] for r in weights.select("term").distinct().limit(PUSHED_WORDS + 1).collect()]
        if len(words) <= PUSHED_WORDS:
            blocks = blocks.filter(F.col("term").isin(words))
        groups = max(1, -(-weights.select("query_id").distinct().count() // QUERIES))
        most = F.col("weight") * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_dl") / F.col("avgdl")))
        met = weights.join(blocks.select("scope", "term", "shard", "max_tf", "min_dl"), ["scope", "term"])
        bounds = met.groupBy("query_id", "shard").agg(F.sum(F.greatest(most, F.lit(0.0))).alias("bound"))
        bounds = written(bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "shard"))), "bounds")
        if not prune:
            scored = self._score(bounds, weights, blocks, groups, n, kind)
        else:
            first = written(self._score(bounds.filter(F.col("nth") <= FIRST), weights, blocks, groups, n, kind), "first")
            floor = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("n") == n).select("query_id", F.col("score").alias("floor"))
            # scores are rounded to 6 places, and sums of bounds to a double
            more = bounds.filter(F.col("nth") > FIRST).join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + 1e-5 >= F.col("floor")))
            scored = first.unionByName(self._score(more, weights, blocks, groups, n, kind))
        return scored.withColumn("bm25_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).filter(F.col("bm25_rank") <= n)

    def _score(self, pairs: DataFrame, weights: DataFrame, blocks: DataFrame, groups: int, n: int, kind: str) -> DataFrame:
        """Scores of the shards in pairs (query_id, shard) for the query of each."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("block")
        packed = weights.groupBy("query_id").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("term", "weight")).alias("words"))
        wanted = pairs.select("query_id", "shard").join(packed, "query_id").select("shard", block, "query_id", "avgdl", "words")
        shards = pairs.select("shard", block).distinct()
        marked = [F.lit(0).alias("kind"), "shard", "block", "term", "places", "tfs", F.lit(None).cast("array<string>").alias("chunk_ids"), F.lit(None).cast("array<int>").alias("dls")]
        terms = weights.select("term", block).distinct()
        postings = blocks.join(shards, "shard").join(terms, ["term", "block"]).select(*marked)
        heads = self._docs().join(shards, "shard").select(F.lit(1).alias("kind"), "shard", "block", F.lit(None).cast("string").alias("term"), F.col("dead").alias("places"), F.lit(None).cast("array<int>").alias("tfs"), "chunk_ids", "dls")
        run = _scored(n, to_arrow_type(pairs.schema["query_id"].dataType))
        # a number of partitions of our own: the groups are small in bytes but not in work, and adaptive plans would put them into few tasks
        dealt = lambda rows: rows.repartition(shuffle_partitions(self.spark), "shard", "block").groupBy("shard", "block")
        return dealt(postings.unionByName(heads)).cogroup(dealt(wanted)).applyInArrow(run, f"query_id {kind}, chunk_id string, score double")


def build(chunks: DataFrame, scope: Column | None = None, shard: int = SHARD) -> LexicalIndex:
    """An index of a table of chunks, in a folder of its own under the shared one."""
    made = LexicalIndex(chunks.sparkSession, new_folder(chunks.sparkSession, "lexical"), shard)
    made.apply(chunks, scope=scope)
    return made
