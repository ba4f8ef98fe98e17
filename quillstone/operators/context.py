"""Context for answers: neighbours of a hit merged by character spans, token budgets, prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import understanding

GAP, CUT, FLOOR = " … ", " … (truncated) … ", 80
CONTEXT_TOKENS, INPUT_TOKENS = 3000, 4000


def estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def expand(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits (key, chunk_id, doc_id, chunk_index, char_start, char_end, text) with the text of their neighbours.

    Neighbours are those at most `window` places away in the document, joined by an explicit list of places, so this is an equality join. Spans
    are merged in order: what a span repeats is cut off, a gap is shown, a contained span adds nothing. A hit without place or with unusable
    offsets keeps its own text.
    """
    near = chunks.select("doc_id", F.col("chunk_index").alias("place"), _span().alias("s"))
    asked = hits.select("key", "doc_id", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("place"))
    found = asked.join(near, ["doc_id", "place"]).groupBy("key").agg(F.collect_list("s").alias("met"))
    return _merged(hits.join(found, "key", "left"))


def expand_all(chunks: DataFrame, window: int = 1) -> DataFrame:
    """`expand` of all chunks (key, doc_id, chunk_index, char_start, char_end, text), each being a hit and a neighbour of others.

    A document's chunks pass in order, each with those around it, so a text is shuffled once at most, and not at all where the chunks are dealt by
    document already, as `chunking` leaves them. Beyond that no copy of a text is stored.
    """
    around = Window.partitionBy("doc_id").orderBy("chunk_index").rangeBetween(-window, window)
    placed = F.when(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull(), _span())  # nothing is beside a chunk without place
    return _merged(chunks.withColumn("met", F.collect_list(placed).over(around)))


def _span() -> Column:
    return F.struct(F.col("char_start").alias("a"), F.col("char_end").alias("b"), F.col("text").alias("t"), F.col("chunk_index").alias("i"))


def _merged(rows: DataFrame) -> DataFrame:
    """Hits with met, the spans around them and their own (null: none), as one span each."""
    own = F.array(_span())
    met = F.coalesce("met", own)
    met = F.when(F.exists(met, lambda s: s["i"] == F.col("chunk_index")), met).otherwise(F.concat(met, own))
    rows = rows.withColumn("spans", F.array_sort(met))
    usable = F.col("chunk_index").isNotNull() & F.coalesce(F.forall("spans", lambda s: s["b"] > s["a"]), F.lit(False))
    first = F.get("spans", F.lit(0))
    begin = F.struct(first["t"].alias("text"), first["b"].cast("int").alias("end"))

    def step(acc, s):
        joined = F.when(s["a"] > acc["end"], F.concat(acc["text"], F.lit(GAP), s["t"])).when(s["a"] == acc["end"], F.concat(acc["text"], s["t"]))
        joined = joined.when(s["b"] > acc["end"], F.concat(acc["text"], F.substring(s["t"], acc["end"] - s["a"] + 1, F.length(s["t"])))).otherwise(acc["text"])
        return F.struct(joined.alias("text"), F.greatest(acc["end"], s["b"].cast("int")).alias("end"))

    merged = F.aggregate(F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))), begin, step)
    out = rows.withColumn("merged", F.when(usable, merged)).drop("met")
    return out.select(
        "key",
        F.coalesce("merged.text", "text").alias("merged_text"),
        F.when(usable, F.array_sort(F.transform("spans", lambda s: s["i"].cast("int")))).otherwise(F.array(F.coalesce("chunk_index", F.lit(0)).cast("int"))).alias("chunk_indices"),
        F.when(usable, first["a"]).otherwise(F.col("char_start")).cast("int").alias("range_start"),
        F.when(usable, F.array_max(F.transform("spans", lambda s: s["b"]))).otherwise(F.col("char_end")).cast("int").alias("range_end"),
    )


def cut_middle(text: str, remove: int) -> str:
    keep = max(FLOOR, len(text) - remove)
    if remove <= 0 or keep >= len(text):
        return text
    return text[: keep // 2] + CUT + text[len(text) - (keep - keep // 2) :]


def fit_budget(texts: list[str], budget: int) -> list[str]:
    """Cuts the middles of texts, the last first and never the first one, until the estimated tokens fit."""
    out = list(texts)
    for i in range(len(out) - 1, 0, -1):
        over = sum(len(t) // 4 for t in out) - budget
        if budget <= 0 or over <= 0:
            break
        out[i] = cut_middle(out[i], over * 4)
    return out


def budgeted(lists: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """(query_id, texts) with texts cut to the budget. Each cut depends on those after it, so the list is handled in Python, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(texts=[fit_budget(list(t), budget) for t in frame["texts"]])

    return lists.select("query_id", "texts").mapInPandas(run, lists.select("query_id", "texts").schema)


INSTRUCTIONS = "Answer from the numbered sources only. Cite them as [n] after each claim. If the sources do not hold the answer, say that you don't have enough information."
THIN_NOTE = "Only little material was found. Answer from what there is and say what is missing."


def _fitted(texts: Column, budget: Column, spark: SparkSession) -> Column:
    """The texts within the budget; a null budget leaves them as they are."""
    ship(spark)

    def fit(lists: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([list(t) if pd.isna(b) else fit_budget(list(t), int(b)) for t, b in zip(lists, budgets, strict=True)], dtype=object)

    return F.pandas_udf(fit, "array<string>")(texts, budget.cast("bigint"))


def prompts(sources: DataFrame, queries: DataFrame, most: int = INPUT_TOKENS, most_context: int = 0) -> DataFrame:
    """(query_id, prompt, tokens) from sources (query_id, rank, source, page_number, text) and queries (query_id, text, kind, task, thin).

    The texts of sources are first cut to `most_context` tokens. A prompt of over `most` tokens gives its sources what the rest of it leaves. Both
    cuts spare the first source and begin with the last; 0 is no limit. Where the rest of the prompt leaves nothing, sources stay as they are.
    """
    spark = queries.sparkSession
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")), F.lit(", p."), F.coalesce("page_number", F.lit(0)).cast("string"), F.lit(")\n"))
    listed = F.array_sort(F.collect_list(F.struct("rank", label.alias("label"), F.coalesce("text", F.lit("")).alias("t"))))
    lists = sources.groupBy("query_id").agg(listed.alias("s")).select("query_id", F.col("s.label").alias("labels"), F.col("s.t").alias("texts"))
    hint, task = understanding.lookup(F.col("kind"), understanding.HINTS), understanding.lookup(F.col("task"), understanding.TASK_INSTRUCTIONS)
    part = lambda title, c: F.when(c != "", F.concat(F.lit(f"\n\n{title}: "), c)).otherwise("")
    tail = F.concat(F.lit("\n\nQUESTION: "), F.col("text"), part("QUERY-TYPE HINT", hint), part("TASK INSTRUCTIONS", task), F.when(F.col("thin"), "\n\n" + THIN_NOTE).otherwise(""), F.lit("\n\nANSWER:"))
    rows = queries.select("query_id", tail.alias("tail")).join(lists, "query_id", "left")
    if most_context > 0:
        rows = rows.withColumn("texts", _fitted(F.coalesce("texts", F.array().cast("array<string>")), F.lit(most_context), spark))
    blocks = lambda: F.array_join(F.zip_with("labels", "texts", lambda a, t: F.concat(a, t)), "\n\n")
    whole = lambda: F.concat(F.lit(INSTRUCTIONS + "\n\nSOURCES:\n"), F.coalesce(blocks(), F.lit("(no sources retrieved)")), F.col("tail"))
    if most > 0:
        size = F.aggregate("texts", F.lit(0), lambda n, t: n + F.length(t))
        room = F.greatest(F.lit(most) - F.floor((F.length(whole()) - size) / 4), F.lit(0))
        rows = rows.withColumn("room", F.when(estimate(whole()) > most, room))
        rows = rows.withColumn("texts", F.when(F.col("room").isNull(), F.col("texts")).otherwise(_fitted(F.coalesce("texts", F.array().cast("array<string>")), F.col("room"), spark)))
    return rows.select("query_id", whole().alias("prompt")).withColumn("tokens", estimate(F.col("prompt")))
