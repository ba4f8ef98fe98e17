"""Cross-entropy difference (Moore and Lewis, "Intelligent Selection of Language Model Training Data", ACL 2010).

Two n-gram models of the same order, smoothing and vocabulary (the 256 bytes; 0 also stands for what is before a text) are counted over whole
corpora: the target documents, and all documents as background, whose counts are scaled to the target's total, so both models are smoothed as much.
p_k(w | h) = (c(hw) + MU * p_{k-1}(w | h')) / (c(h) + MU), down to p_1 with one added to each byte's count. A document's score is its loss per
token under the target model less that under the background model: the lower, the more it is like the target.

The fitted model is one table of n-grams with their log probabilities under both models and, as contexts, their log back-off weights. It grows with
the corpus and is never sent out whole. Documents are put into blocks of BLOCK_BYTES of text; a block asks for the distinct n-grams that it holds, a
join with the model answers, and the block is scored with the rows it has got. Distinct n-grams of a block are a small share of its text, so requests
and answers are too, and what a task holds depends on the block's size only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, ship, slices
from .hashindex import HashIndex
from .textbytes import utf8

ORDER, MU = 5, 4.0
#: The longest n-gram whose key and length fit a bigint.
MAX_ORDER = 7
#: Text of a block; one longer text is a block of its own.
BLOCK_BYTES = 16_000_000


def ngram_keys(at: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the order - 1 bytes before it in its text (0 before the text) as one integer, the byte itself lowest."""
    rows, pad = len(at) - 1, order - 1
    place = np.arange(len(data)) + np.repeat((np.arange(rows) + 1) * pad, np.diff(at))
    wide = np.zeros(len(data) + rows * pad, np.uint64)
    wide[place] = data
    out = wide[place]
    for k in range(1, order):
        out |= wide[place - k] << np.uint64(8 * k)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counter(order: int):
    """Adds up a task's n-grams before they are shuffled; bit 63 marks those of target documents."""

    def run(batches):
        held_keys, held_counts, size = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                at, data = utf8(part.column("text"))
                target = np.array(part.column("target").to_pylist(), bool)
                keys = ngram_keys(at, data, order) | (np.repeat(target, np.diff(at)).astype(np.uint64) << np.uint64(63))
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                held_keys.append(keys[first])
                held_counts.append(np.diff(np.append(first, len(keys))))
                size += len(first)
                if size > 3_000_000:
                    keys, counts = _summed(np.concatenate(held_keys), np.concatenate(held_counts))
                    held_keys, held_counts, size = [keys], [counts], 0
        if held_keys:
            keys, counts = _summed(np.concatenate(held_keys), np.concatenate(held_counts))
            target = keys >> np.uint64(63) == 1
            for i in range(0, len(keys), 200_000):
                k, c, t = keys[i : i + 200_000] & np.uint64((1 << 63) - 1), counts[i : i + 200_000], target[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(np.where(t, c, 0)), pa.array(c)], ["key", "c_t", "c_b"])

    return run


def fit(docs: DataFrame, is_target: Column, text_col: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """The model table (key, t, b, back_t, back_b) from all rows of docs; rows where is_target isn't true count as background only.

    key: the n-gram and, in its highest byte, its length. Documents are scored with the weights in single precision. t and b are null for what is met as a context only, the weights for what never is one.
    Null and empty texts have no n-grams. An empty table gives the 256 single bytes, all alike.
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 1 to {MAX_ORDER}, not {order}")
    ship(spark := docs.sparkSession)
    work = Scratch(spark, "lm")
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    counted = rows.mapInArrow(frugal(_counter(order)), "key bigint, c_t bigint, c_b bigint")
    grams = work.table(counted.groupBy("key").agg(F.sum("c_t").alias("c_t"), F.sum("c_b").alias("c_b")), "counts")
    total = grams.agg(F.coalesce(F.sum("c_t"), F.lit(0)).alias("t"), F.coalesce(F.sum("c_b"), F.lit(0)).alias("b")).first()
    ratio = total["t"] / total["b"] if total["b"] else 1.0
    levels, contexts, lower = [], {}, None
    for k in range(1, order + 1):
        mine = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum("c_t").cast("double").alias("c_t"), (F.sum("c_b") * ratio).alias("c_b"))
        if k == 1:
            n = total["t"] + 256.0
            # all 256 bytes have a row, so every search ends here
            every = spark.range(256).select(F.col("id").alias("key")).join(mine, "key", "left")
            level = every.select("key", F.log((F.coalesce("c_t", F.lit(0.0)) + 1) / n).alias("t"), F.log((F.coalesce("c_b", F.lit(0.0)) + 1) / n).alias("b"))
        else:
            mine = work.table(mine.withColumns({"h": F.shiftright("key", 8), "low": F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1)}), f"counts-{k}")
            context = work.table(mine.groupBy("h").agg(F.sum("c_t").alias("h_t"), F.sum("c_b").alias("h_b")), f"contexts-{k}")
            joined = mine.join(context, "h").join(lower.select(F.col("key").alias("low"), F.col("t").alias("low_t"), F.col("b").alias("low_b")), "low")
            level = joined.select("key", *[F.log((F.col(f"c_{m}") + mu * F.exp(f"low_{m}")) / (F.col(f"h_{m}") + mu)).alias(m) for m in "tb"])
            contexts[k - 1] = context.select(F.col("h").alias("key"), *[F.log(mu / (F.col(f"h_{m}") + mu)).alias(f"back_{m}") for m in "tb"])
        lower = work.table(level, f"grams-{k}")
        levels.append(lower)
    model = None
    for k, level in enumerate(levels, 1):
        both = level.join(contexts[k], "key", "full") if k in contexts else level.withColumns({"back_t": F.lit(None).cast("double"), "back_b": F.lit(None).cast("double")})
        both = both.withColumn("key", F.col("key").bitwiseOR(F.lit(k << LENGTH)))
        model = both if model is None else model.unionByName(both)
    fitted = work.table(model, "model")
    for name in ("counts", *[f"{table}-{k}" for k in range(1, order + 1) for table in ("counts", "contexts", "grams") if k > 1 or table == "grams"]):
        work.drop(name)
    return fitted


#: Bits of a model key below the n-gram's length.
LENGTH = 56


def _asked(grams: np.ndarray, order: int) -> np.ndarray:
    """The keys of all model rows that scoring these distinct n-grams may need: they, their shorter ends and the contexts of both."""
    out = [grams | np.uint64(order << LENGTH)]
    for k in range(order - 1, 0, -1):
        mask = np.uint64((1 << 8 * k) - 1)
        out.append(np.unique(np.concatenate([grams & mask, (grams >> np.uint64(8)) & mask])) | np.uint64(k << LENGTH))
    return np.concatenate(out)


def _blocked(order: int, text: int, block_bytes: int):
    """Rows with the number of their block, and after the last of a block a row with the keys that it asks for."""

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        kind = None

        def asked():
            keys = _asked(np.unique(np.concatenate(held)), order)
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, kind), lists], ["block", "row", "keys"])

        for batch in batches:
            kind = batch.column("row").type
            named = pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), text).cast(pa.string())], ["row", "text"])
            for part in slices(named, "text", min(1_000_000, block_bytes)):
                at, data = utf8(part.column("text"))
                if size and size + len(data) > block_bytes:
                    yield asked()
                    block, held, size = block + 1, [], 0
                held.append(np.unique(ngram_keys(at, data, order)))
                size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), part.column("row"), pa.nulls(part.num_rows, pa.list_(pa.int64()))], ["block", "row", "keys"])
        if held:
            yield asked()

    return run


class _Scorer:
    def __init__(self, keys: np.ndarray, values: np.ndarray, order: int):
        """values: t, b, back_t, back_b; nan where there is none."""
        self.index, self.values, self.order = HashIndex(keys), values, order

    def _rows(self, keys: np.ndarray, k: int, column: int) -> tuple[np.ndarray, np.ndarray]:
        row = self.index.find(keys | np.uint64(k << LENGTH))
        there = row >= 0
        there[there] = ~np.isnan(self.values[row[there], column])
        return there, self.values[row[there], column : column + 2]

    def losses(self, keys: np.ndarray) -> np.ndarray:
        """Negative log probabilities (tokens, 2) of n-grams of the full order."""
        out, left = np.zeros((len(keys), 2)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            hit, found = self._rows(keys, k, 0)
            out[left[hit]] -= found
            left, keys = left[~hit], keys[~hit]
            if not len(left) or k == 1:
                break
            seen, found = self._rows(keys >> np.uint64(8), k - 1, 2)
            out[left[seen]] -= found
            keys = keys & np.uint64((1 << 8 * (k - 1)) - 1)
        return out


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of docs in a struct `row`, plus n_tokens (bytes), target_loss, background_loss, score; the last three null for a text without bytes."""
    ship(spark := docs.sparkSession)
    work = Scratch(spark, "lm")
    order = model.agg(F.max(F.shiftright("key", LENGTH))).first()[0]
    base = docs.select(F.struct(*[(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]).alias("row"))
    kind, text = base.schema["row"].dataType.simpleString(), docs.columns.index(text_col)
    blocks = work.table(base.mapInArrow(frugal(_blocked(order, text, block_bytes)), f"block bigint, `row` {kind}, keys array<bigint>"), "blocks")
    # the texts' shuffles of fitting are not needed any more
    work.release()
    asked = blocks.filter("keys is not null").select(F.col("block").alias("of"), F.explode("keys").alias("key"))
    # requests and model both grow with the corpus, so neither is sent out
    got = asked.join(model.hint("merge"), "key").select("of", "key", *[F.col(c).cast("float") for c in ("t", "b", "back_t", "back_b")])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        values = np.stack([right[c].to_numpy(zero_copy_only=False) for c in ("t", "b", "back_t", "back_b")], 1).astype(np.float64)
        scorer = _Scorer(right["key"].to_numpy().astype(np.uint64), values, order)
        out = [[], [], []]
        for batch in left.select(["row"]).to_batches():
            named = pa.RecordBatch.from_arrays([pc.struct_field(batch.column("row"), text)], ["text"])
            for part in slices(named, "text", 500_000):
                at, data = utf8(part.column("text"))
                total, some = np.zeros((part.num_rows, 2)), at[1:] > at[:-1]
                if some.any():  # a text's sum doesn't depend on what stands beside it
                    total[some] = np.add.reduceat(scorer.losses(ngram_keys(at, data, order)), at[:-1][some], axis=0)
                for o, x in zip(out, (np.diff(at), total[:, 0], total[:, 1]), strict=True):
                    o.append(x)
        return pa.table([left["row"], *[pa.array(np.concatenate(o)) for o in out]], ["row", "n_tokens", "t", "b"])

    pairs = blocks.filter("keys is null").select("block", "row").groupBy("block").cogroup(got.groupBy("of"))
    found = pairs.applyInArrow(scored, f"`row` {kind}, n_tokens bigint, t double, b double")
    per = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return found.select("row", "n_tokens", per("t").alias("target_loss"), per("b").alias("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def labelled_target(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column is_target (in place of one of that name): some label of the id says quality 1 and none says toxic 1. One row stays one row."""
    # labels grow with the documents, so they are never broadcast: texts ride one shuffle by id at every size
    good = (F.coalesce(F.max("quality"), F.lit(0)) == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).filter("good").select(F.struct("doc_id").alias("mark")).hint("merge")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.join(marks, F.col(f"row.`{id_col}`") == F.col("mark.doc_id"), "left")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "is_target"], F.col("mark").isNotNull().alias("is_target"))
