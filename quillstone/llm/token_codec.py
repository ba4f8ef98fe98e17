"""Token ids on disk: canonical length-limited Huffman codes from global counts, in independent blocks with bit-offset checkpoints.

The file format is two tables under one folder:
* codebook (id, bits): the code length of every id; codes are canonical, so lengths are all a reader needs.
* blocks (bucket, block, start, doc_ids, lengths, crc32s, lanes, lane_bits, payload): some hundred documents in ascending id order. Each document's
  bits begin at a byte; every LANE ids there is a checkpoint, the bit offset of a lane in the payload. A block is decoded without any other one.

Decoding is table-driven: one lookup of the next LIMIT bits gives an id and its length, for all lanes of a block at once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, frugal, sampled_splitters, ship, shuffle_partitions, slices
from .tokenizing import Encoder, encoder, with_end

#: Most bits of a code (raised where an alphabet needs more), ids between checkpoints, and ids in a block (a longer document is a block of its own).
LIMIT, LANE, BLOCK = 20, 256, 1 << 20
BLOCKS = "bucket int, block int, start bigint, doc_ids array<bigint>, lengths array<bigint>, crc32s array<bigint>, lanes array<int>, lane_bits array<bigint>, payload binary"
DOCS = "doc_id bigint, n bigint, crc32 bigint, lane_bits array<bigint>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, math.ceil(math.log2(n)))
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        level = both[place]
        marks.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(marks):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, position); lengths of 0 have none."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, begin: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' codes, each text from a byte's start; the first byte of each (rows + 1 values); the bit offset of every id."""
    bits = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(bits)])
    size = (ends[begin[1:]] - ends[begin[:-1]] + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    at = ends[:-1] + np.repeat(first[:-1] * 8 - ends[begin[:-1]], np.diff(begin))
    word, inside = at >> 5, at & 31
    value = codes[ids] << (64 - bits - inside).astype(np.uint64)
    n = int(first[-1] // 4 + 2)
    # bits of different ids never overlap, so sums of at most 32 bits, exact in a double, put them together
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return out.astype(">u4").tobytes()[: first[-1]], first, at


def decoder(symbols: np.ndarray, lengths: np.ndarray):
    """A function (payload, bit offset and number of ids of each lane) -> all ids, lane after lane."""
    limit = int(lengths.max(initial=1))
    if limit > 25:
        raise ValueError("codes of over 25 bits don't fit a 32-bit window")
    order = np.argsort(lengths, kind="stable")
    table, width = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    spans = (1 << (limit - lengths[order])).astype(np.int64)
    table[: spans.sum()], width[: spans.sum()] = np.repeat(symbols[order], spans), np.repeat(lengths[order], spans)

    def decode(payload: bytes, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        data = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
        window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        by = np.argsort(-counts, kind="stable")
        left, at = counts[by], bits[by].astype(np.int64)
        place = (np.cumsum(counts) - counts)[by]
        out = np.zeros(int(counts.sum()), np.uint32)
        for k in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -k, "left"))  # lanes with more than k ids
            p = at[:m]
            key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - limit)
            out[place[:m] + k] = table[key]
            p += width[key]
        return out

    return decode


#: In place of a range: the row that a task writes last, with its counts of all ids.
COUNTS = -1


def _tokenise(tokenizer: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code, total = encoder(tokenizer), np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, begin = with_end(*code.encode(part.column("text")), end_id)
                counts = np.bincount(ids, minlength=len(total))
                counts[: len(total)] += total
                total = counts
                small = ids.astype(code.dtype)
                # rows share one buffer of ids
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begin * code.dtype.itemsize).astype(np.int32)), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("bucket"), pa.array(np.diff(begin)), raw], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([COUNTS], pa.int32()), pa.array([0], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], schema=schema)

    return run


def _counted(batches):
    """(id, n) of the tasks' counts."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            more = np.frombuffer(raw, "<i8")
            total = np.pad(total, (0, max(0, len(more) - len(total))))
            total[: len(more)] += more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])


def _packer(width: int, symbols: np.ndarray, lengths: np.ndarray):
    def run(batches):
        by_id = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
        by_id[symbols] = lengths
        codes = canonical_codes(by_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch, "ids", 8_000_000):
                raw = part.column("ids")
                ids = np.frombuffer(b"".join(raw.to_pylist()), f"<u{width}").astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(part.column("n").to_numpy())])
                data, first, at = pack_bits(ids, begin, codes, by_id)
                lanes = [(at[a:b:LANE] - f * 8) for a, b, f in zip(begin[:-1], begin[1:], first[:-1], strict=True)]
                four = ids.astype("<u4")
                crc = [zlib.crc32(four[a:b].tobytes()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                body = [data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("bucket"), pa.array(np.diff(begin)), pa.array(crc, pa.int64()), pa.array(lanes, pa.list_(pa.int64())), pa.array(body, pa.binary())], ["doc_id", "bucket", "n", "crc32", "lane_bits", "payload"])

    return run


def _block_maker():
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "lengths", "crc32s")], ("lanes", pa.list_(pa.int32())), ("lane_bits", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        held, ids, bucket, block, start = [], 0, None, 0, 0

        def made():
            nonlocal held, ids, block, start
            docs, n, crc, lanes, body = zip(*held, strict=True)
            first = np.concatenate([[0], np.cumsum([len(b) for b in body])])
            bits = np.concatenate([np.asarray(x, np.int64) + 8 * f for x, f in zip(lanes, first[:-1], strict=True)])
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, block, start, docs, n, crc, [len(x) for x in lanes], bits, b"".join(body)), schema, strict=True)], schema=schema)
            held, ids, block, start = [], 0, block + 1, start + ids
            return out

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "crc32", "lane_bits", "payload")]
            for b, *doc in zip(*cols, strict=True):
                if held and (b != bucket or ids + doc[1] > BLOCK):
                    yield made()
                if b != bucket:
                    bucket, block, start = b, 0, 0
                held.append(doc)
                ids += doc[1]
        if held:
            yield made()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encodes every text (end_id appended; null counts as empty) and writes the two tables under path, documents in ascending id order, null ids first.

    Texts are encoded once. Only payloads, about ten bits an id, cross the shuffle that puts documents in order; its ranges come from the ids alone.
    """
    ship(spark := docs.sparkSession)
    work = Scratch(spark, "codec")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key = [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))]
    splitters = sampled_splitters(base.select("doc_id"), key, shuffle_partitions(spark))
    width = Encoder(tokenizer).dtype.itemsize
    found = work.table(base.withColumn("bucket", bucket_of(key, splitters, ["bigint"])).mapInArrow(_tokenise(tokenizer, end_id), "doc_id bigint, bucket int, n bigint, ids binary"), "ids")
    # the alphabet is the tokenizer's, so this is bounded by its size
    counts = sorted(found.filter(F.col("bucket") == COUNTS).select("ids").mapInArrow(frugal(_counted), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect())
    symbols, n = np.array([r["id"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame([(int(s), int(k)) for s, k in zip(symbols, lengths, strict=True)], "id bigint, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    packed = found.filter(F.col("bucket") != COUNTS).mapInArrow(frugal(_packer(width, symbols, lengths)), f"bucket int, {DOCS}".replace("bucket int, doc_id bigint", "doc_id bigint, bucket int"))
    ordered = packed.repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc32")
    ordered.mapInArrow(frugal(_block_maker()), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    work.drop("ids")
    work.release()


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the decoded ids), crc_written, ids if asked for."""
    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").collect()
    symbols, lengths = np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)
    by_id = np.argsort(symbols)
    symbols, lengths = symbols[by_id], lengths[by_id]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ends = blocks.select("bucket", (F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end")).groupBy("bucket").agg(F.max("end").alias("n")).collect()
    before, total = {}, 0  # one number a range
    for b, n in sorted((r["bucket"], r["n"]) for r in ends):
        before[b], total = total, total + n
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "crc_written", *(["ids"] if with_ids else [])]

    def run(batches):
        decode = decoder(symbols, lengths) if len(symbols) else None
        for batch in batches:
            for row in batch.to_pylist():
                n, lanes = np.array(row["lengths"], np.int64), np.array(row["lanes"], np.int64)
                counts = np.full(int(lanes.sum()), LANE, np.int64)
                counts[np.cumsum(lanes) - 1] = n - (lanes - 1) * LANE
                ids = decode(row["payload"], np.array(row["lane_bits"], np.int64), counts)
                first = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["bucket"]] + row["start"] + first[:-1]), pa.array(n), pa.array(crc, pa.int64()), pa.array(row["crc32s"], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.select("bucket", "start", "doc_ids", "lengths", "crc32s", "lanes", "lane_bits", "payload").mapInArrow(frugal(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, crc_written bigint" + ", ids array<int>" * with_ids)
