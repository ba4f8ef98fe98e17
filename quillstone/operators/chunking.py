"""Chunking with exact character provenance: pages joined into documents, windows, sentences, paragraphs, token guard, ids, page numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import boundaries

SEPARATOR = "\n\n"
#: Defaults of the strategies; the guard's windows hold 254 and step 222 tokens of four characters.
FIXED = {"chunk_size": 500, "overlap": 50}
SENTENCE = {"max_chars": 800, "overlap": 2}
PARAGRAPH = {"max_chars": 1000, "overlap": 1}
GUARD_TOKENS, GUARD_CHARS, GUARD_STEP = 256, 1016, 888
#: Documents that are cut at a time.
PACK_ROWS = 64
SPANS = "doc_id bigint, char_start int, char_end int"


def join_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_number, text) as one row a document: text, spans (page_number, start, end); the separator belongs to no span."""
    by = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(by), F.lit(0)).cast("int")
    placed = pages.select("doc_id", "page_number", "text", at.alias("start"))
    rows = F.array_sort(F.collect_list(F.struct("page_number", "start", (F.col("start") + F.length("text")).cast("int").alias("end"), "text")))
    return placed.groupBy("doc_id").agg(rows.alias("p")).select("doc_id", F.array_join("p.text", SEPARATOR).alias("text"), F.transform("p", lambda s: F.struct(s["page_number"].alias("page_number"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def fixed_spans(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters; the overlap is cut to size - 1, and the last window is the first that reaches the end."""
    overlap = max(0, min(overlap, size - 1))
    n, step = F.length("text"), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return docs.filter(n > 0).select("doc_id", "text", F.explode(starts).alias("char_start")).select("doc_id", "char_start", F.least(F.col("char_start") + size, F.length("text")).cast("int").alias("char_end"), F.substring("text", F.col("char_start") + 1, F.lit(size)).alias("text"))


def sentence_offsets(text: str) -> list[tuple[int, int]]:
    """Sentences between white space that follows . ! or ?; blank ones are left out."""
    out, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def paragraph_offsets(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in re.finditer(r"\n\n+", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def pack(spans: list[tuple[int, int]], most: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of spans at most `most` characters long, or one longer span alone. Each run begins `overlap` spans before the last one's end, so the
    end of a text gives ever shorter runs until one span is left."""
    out, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][1] - spans[i][0] <= most:
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        i = max(i + 1, j - overlap)
    return out


def pack_paragraphs(text: str, most: int = 1000, overlap: int = 1) -> list[tuple[int, int]]:
    """Runs of paragraphs; one that is too long is packed by sentences, and no run reaches over it."""
    spans, out, i = paragraph_offsets(text), [], 0
    long = [b - a > most for a, b in spans]
    while i < len(spans):
        a, b = spans[i]
        if long[i]:
            out += [(a + x, a + y) for x, y in pack(sentence_offsets(text[a:b]), most, SENTENCE["overlap"])]
            i += 1
            continue
        j = i + 1
        while j < len(spans) and not long[j] and spans[j][1] - a <= most:
            j += 1
        out.append((a, spans[j - 1][1]))
        i = max(i + 1, j - overlap)
    return out


def _packed(rule):
    """(doc_id, text and what else the rule takes) to the rule's spans with their texts; a few documents are objects of Python at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACK_ROWS):
                columns = (c.to_pylist() for c in whole.slice(start, PACK_ROWS).columns)
                rows = [(d, a, b, t[a:b]) for d, t, *rest in zip(*columns, strict=True) for a, b in rule(t or "", *rest)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "char_start", "char_end", "text"])

    return run


def sentence_spans(docs: DataFrame, most: int = 800, overlap: int = 2, model: boundaries.Model | boundaries.Tables | None = None) -> DataFrame:
    """Runs of sentences; with a model, of sentences as `boundaries` has learned them."""
    cut, docs = (sentence_offsets, docs.select("doc_id", "text")) if model is None else (boundaries.cutter(model), boundaries.informed(docs, model))
    return docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(_packed(lambda *text: pack(cut(*text), most, overlap)), SPANS + ", text string")


def paragraph_spans(docs: DataFrame, most: int = 1000, overlap: int = 1) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_packed(lambda t: pack_paragraphs(t, most, overlap)), SPANS + ", text string")


DEFAULTS = {
    "fixed": (fixed_spans, tuple(FIXED.values())),
    "sentence": (sentence_spans, tuple(SENTENCE.values())),
    "paragraph": (paragraph_spans, tuple(PARAGRAPH.values())),
}


def guard(spans: DataFrame) -> DataFrame:
    """Chunks of over 256 estimated tokens as windows of 1016 characters that begin every 888; others as they are."""
    n = F.length("text")
    long = T.token_estimate(F.col("text")) > GUARD_TOKENS
    starts = F.when(long, F.sequence(F.lit(0), F.greatest(n - (GUARD_CHARS - GUARD_STEP) - 1, F.lit(0)), F.lit(GUARD_STEP))).otherwise(F.array(F.lit(0)))
    wide = F.when(long, F.lit(GUARD_CHARS)).otherwise(n)
    cut = spans.select("doc_id", "char_start", "text", F.explode(starts).alias("at"), wide.alias("wide"))
    piece = F.substring("text", F.col("at") + 1, F.col("wide"))
    return cut.select("doc_id", (F.col("char_start") + F.col("at")).cast("int").alias("char_start"), (F.col("char_start") + F.col("at") + F.length(piece)).cast("int").alias("char_end"), piece.alias("text"))


def assemble(spans: DataFrame, strategy: str, pages: DataFrame | None = None) -> DataFrame:
    """Chunks with index, ids, hash, token count and page: the first page that a chunk overlaps, else the document's first."""
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    rows = guard(spans).filter(F.col("text").rlike(r"\S"))
    out = rows.select(
        "doc_id",
        (F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        "char_start",
        "char_end",
        "text",
        T.chunk_id(F.col("doc_id"), F.col("char_start"), F.col("char_end")).alias("chunk_id"),
        T.short_sha(F.col("text")).alias("content_hash"),
        T.token_estimate(F.col("text")).alias("token_count"),
        F.lit(strategy).alias("strategy"),
    )
    if pages is None:
        return out.withColumn("page_number", F.lit(1))
    over = lambda s: (F.col("char_start") < s["end"]) & (F.col("char_end") > s["start"])
    joined = out.join(pages.select("doc_id", "spans"), "doc_id")
    on = F.filter("spans", over)
    numbers = F.transform(on, lambda s: s["page_number"])
    return joined.withColumn("page_number", F.coalesce(F.get(numbers, F.lit(0)), F.get("spans", F.lit(0))["page_number"])).withColumn("spans_pages", F.when(F.size(on) > 1, numbers)).drop("spans")


def chunks(docs: DataFrame, strategy: str = "fixed", size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of docs (doc_id, text) by one of the strategies fixed, sentence, paragraph; page_number is 1.

    size: characters at most; overlap: characters (fixed), sentences or paragraphs that a chunk shares with the next. None takes the strategy's own.
    """
    if strategy not in DEFAULTS:
        raise ValueError(f"no strategy {strategy!r}, only {', '.join(DEFAULTS)}")
    spans, (own_size, own_overlap) = DEFAULTS[strategy]
    size, overlap = own_size if size is None else size, own_overlap if overlap is None else overlap
    if size < 1 or overlap < 0:
        raise ValueError(f"size {size} must be at least 1 and overlap {overlap} at least 0")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return assemble(spans(docs, size, overlap), strategy)


def entities(c):
    """Company names, and upper-case words of two to five letters in the first 600 characters; sorted, once each."""
    names = F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)*(?:[ ](?:Inc|Corp|Ltd|LLC|Co|Group|Holdings|Technologies|Solutions))\.?\b"), F.lit(0))
    tickers = F.regexp_extract_all(F.substring(c, 1, 600), F.lit(r"(?U)\b[A-Z]{2,5}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(names, tickers)))
