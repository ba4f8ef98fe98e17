"""Best-fit packing of documents into sequences, bulk-synchronously.

Pieces are range-sorted by length, longest first, with sampled splitters, and numbered in that order. Pieces of one length differ in nothing that
packing sees, so documents and gaps are runs: (length, how many). A sweep takes the runs of documents in order of length; the run's successor among
the gap runs (the smallest gap that is large enough) takes one document for each of its sequences, more if they fit; the documents' ranks say which
of them get it when it is too short for all. The gaps shrink and the sweep repeats until the run is placed; what has no successor opens sequences.
That is best-fit decreasing over all documents, yet no step depends on how many there are: there are at most `capacity` lengths and gap sizes, and
the plan is a list of rank runs. Every piece then finds its run by binary search on its own rank, in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, frugal, sampled_splitters, ship, shuffle_partitions, slices
from .tokenizing import encoder, with_end

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def sweep_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks (pieces by length, longest first): first rank, first sequence, pieces in each sequence, offset of the first, length."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    rank = opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        left = counts[length]
        while left:
            at = bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            each = gap // length
            if at < len(sizes):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                first, n = opened, -(-left // each)
                opened += n
            full = min(n, left // each)
            if full:
                runs.append((rank, first, each, capacity - gap, length))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last one gets what is left
                runs.append((rank, first + full, left, capacity - gap, length))
                leave(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                leave(gap, first + full, n - full)
    return tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (end_id appended): doc_id, piece, start, length, ids_crc32, and ids if asked for. Null text: only the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    ship(docs.sparkSession)

    def run(batches):
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                rows: list[tuple] = []
                ids, begin = with_end(*code.encode(part.column("text")), end_id)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    for k, at in enumerate(range(0, b - a, capacity)):
                        piece = ids[a + at : min(b, a + at + capacity)]
                        rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes()), *([piece.astype(np.int32)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (a table that can be read again, with a column length of 1 to capacity), plus sequence_id and offset. Ties go by `order`, nulls first."""
    ship(spark := pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sweep_plan(counts, capacity)
    low = F.lit(-(1 << 63))
    keys = [-F.col("length"), *[F.coalesce(F.col(c).cast("long"), low) for c in order]]
    splitters = sampled_splitters(pieces, keys, shuffle_partitions(spark))
    ranged = pieces.withColumn("bucket", bucket_of(keys, splitters, ["bigint"] * len(keys)))
    totals = {r["bucket"]: r["n"] for r in ranged.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    offsets = np.concatenate([[0], np.cumsum([totals.get(b, 0) for b in range(len(splitters) + 1)])]).tolist()
    inside = Window.partitionBy("bucket").orderBy(*keys)
    base = F.get(F.array(*[F.lit(int(x)) for x in offsets]), F.col("bucket")).cast("long")
    ranked = ranged.repartitionById(len(splitters) + 1, F.col("bucket")).withColumn("rank", F.row_number().over(inside) - 1 + base).drop("bucket")

    names = pieces.columns

    def place(batches):
        first_rank, first_sequence, each, offset, length = plan
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(first_rank, rank, "right") - 1
            nth = rank - first_rank[run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(first_sequence[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * length[run])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(frugal(place), f"{fields}, sequence_id bigint, `offset` bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **columns) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each for itself; an empty table gives no row."""
    work = Scratch(docs.sparkSession, "pack")
    return pack_pieces(work.table(cut_pieces(docs, tokenizer, capacity, **columns), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, **columns) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids, ids (at most capacity)."""
    work = Scratch(docs.sparkSession, "pack")
    placed = pack_pieces(work.table(cut_pieces(docs, tokenizer, capacity, with_ids=True, **columns), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))
