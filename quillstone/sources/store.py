"""Collections on Parquet: hash buckets changed by copy-on-write under a log of versions; several backends read as one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from .log import Conflict, Log

BACKENDS, DEFAULT_BACKEND = ["chroma", "pgvector", "pinecone"], "chroma"
UPSERT_BATCH = 4000
#: Parts of one level that a bucket has beside its folder before they are merged into one of the next level.
FAN = 8


class Collection:
    """A keyed table in hash buckets, changed by copy-on-write: a change rewrites the buckets that its rows fall into and no other. Rows of which the
    caller knows that they are new are put beside what their buckets hold, as parts, and nothing is rewritten; `merge` makes few parts of many.

    The log's entry of a version names each bucket's folder, so a version is a snapshot that later changes leave alone, and a failed write is never
    named. Changes commit optimistically: if another writer was first, the change is put on top of its version, as it is where it touched other
    buckets, else computed anew. bucket_by: columns that decide the bucket (default: the key). Rows of one key must agree in them. A change may carry
    the name and the number of its batch; a batch that is in already is skipped, so a replayed stream changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "chunk_id", bucket_by: str | None = None, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.by = spark, path.rstrip("/"), schema, key, bucket_by or key
        self.log = Log(spark, f"{self.path}/log")
        self.fresh_buckets = buckets

    def snapshot(self, version: int | None = None) -> dict:
        """version, n_buckets, folders (bucket -> folder), parts (bucket -> [folder, level] beside it), batches (name -> number), touched (by that version)."""
        at, entry = self.log.latest() if version is None else (version, self.log.read(version))
        return {"n_buckets": self.fresh_buckets, "folders": {}, "parts": {}, "batches": {}, "touched": []} | entry | {"version": at}

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(n)).cast("int")

    def buckets_of(self, rows: DataFrame, snap: dict | None = None) -> list[int]:
        """The buckets that rows (with the columns of bucket_by) fall into; there are n_buckets at most."""
        n = (snap or self.snapshot())["n_buckets"]
        return sorted(r["b"] for r in rows.select(self.bucket(n).alias("b")).distinct().collect())

    def table(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some of its buckets."""
        return self._rows(self.snapshot(version), buckets)

    def _rows(self, snap: dict, buckets: list[int] | None = None) -> DataFrame:
        some = lambda of: [(b, x) for b, x in sorted(snap[of].items()) if buckets is None or int(b) in buckets]
        return self._read([f for _, f in some("folders")] + [f for _, parts in some("parts") for f, _ in parts])

    def _read(self, folders: list[str]) -> DataFrame:
        found = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def _change(self, rows_of: Callable[[dict], tuple[list[int], DataFrame]], batch: tuple[str, int] | None = None, attempts: int = 5, beside: tuple[int, dict[str, str]] | None = None) -> bool:
        """Commits rows_of(snapshot) -> (touched buckets, their new rows). False if the batch is in already. beside: a version and written folders of
        buckets, whose rows that version has not; they are committed as parts in place of rows_of if no later version has touched these buckets."""
        snap, last = self.snapshot(), None
        for _ in range(attempts):
            if batch and snap["batches"].get(batch[0], -1) >= batch[1]:
                return False
            folders, parts = snap["folders"], snap["parts"]
            if beside and not self._touched_after(beside[0]) & (touched := set(map(int, beside[1]))):
                touched, parts = sorted(touched), parts | {b: [*parts.get(b, []), [f, 0]] for b, f in beside[1].items()}
            else:
                if beside:
                    beside = last = None
                if last is None:
                    touched, rows = rows_of(snap)
                    last = self._write(rows, touched, snap["n_buckets"])
                others = lambda of: {b: x for b, x in of.items() if int(b) not in touched}
                folders, parts = others(folders) | last, others(parts)
            entry = {"n_buckets": snap["n_buckets"], "folders": folders, "parts": parts, "batches": snap["batches"] | (dict([batch]) if batch else {}), "touched": touched}
            try:
                self.log.commit(snap["version"] + 1, entry)
                return True
            except Conflict:
                seen = snap["version"]
                snap = self._after(seen)
                if self._touched_after(seen) & set(touched):
                    last = None
        raise Conflict(f"{self.path}: other writers were first {attempts} times")

    def _touched_after(self, version: int) -> set[int]:
        return {b for v in self.log.versions() if v > version for b in self.log.read(v)["touched"]}

    def _after(self, version: int, patience: float = 30.0) -> dict:
        """The newest snapshot once the version after this one is there: its writer holds the lock and is about to finish."""
        began = time.monotonic()
        while (snap := self.snapshot())["version"] <= version:
            if time.monotonic() - began > patience:
                raise Conflict(f"{self.path}: version {version + 1} is locked by a writer that does not finish; see Log.break_lock")
            time.sleep(0.05)
        return snap

    def _write(self, rows: DataFrame, touched: list[int], n: int) -> dict[str, str]:
        """Folders of the buckets that have rows."""
        return self._save(rows.withColumn("_bucket", self.bucket(n)).repartition(min(n, len(touched)), "_bucket")) if touched else {}

    def _save(self, dealt: DataFrame) -> dict[str, str]:
        name = f"data/{uuid.uuid4().hex}"
        dealt.write.partitionBy("_bucket").option("maxRecordsPerFile", 1_000_000).option("compression", "zstd").parquet(f"{self.path}/{name}")
        return {x.split("=")[1]: f"{name}/{x}" for x in self.log.names(f"{self.path}/{name}") if x.startswith("_bucket=")}

    def stage(self, rows: DataFrame, snap: dict) -> tuple[dict[str, str], DataFrame]:
        """Writes rows in buckets from the tasks that they lie in, which shuffles nothing, and commits nothing: (folders of buckets, the rows read back)."""
        names = [f.name for f in self.table().schema]
        staged = self._save(rows.select(*names).withColumn("_bucket", self.bucket(snap["n_buckets"])))
        return staged, self._read(sorted(staged.values()))

    def add(self, staged: dict[str, str], version: int, batch: tuple[str, int] | None = None) -> bool:
        """Commits staged rows beside what their buckets hold. The caller has seen that no key is in them twice or in that version; if a later version
        has touched their buckets, they are put in as by upsert."""

        def changed(snap: dict) -> tuple[list[int], DataFrame]:
            touched = sorted(map(int, staged))
            return touched, index.upsert(self._rows(snap, touched), self._read(sorted(staged.values())), [self.key])

        return self._change(changed, batch, beside=(version, staged))

    def merge(self, fan: int = FAN) -> None:
        """Parts of one level, where a bucket has `fan` of them, become one of the next: so a row is written again once a level, of which there are as
        many as the logarithm of the number of changes. Another writer's change that comes first leaves the parts for the next call."""
        level, snap = 0, self.snapshot()
        while any(at >= level for parts in snap["parts"].values() for _, at in parts):
            full = {b: mine for b, parts in snap["parts"].items() if len(mine := [f for f, at in parts if at == level]) >= fan}
            if full:
                one = self._write(self._read([f for mine in full.values() for f in mine]), touched := sorted(map(int, full)), snap["n_buckets"])
                parts = {b: [p for p in parts if b not in full or p[1] != level] + ([[one[b], level + 1]] if b in one else []) for b, parts in snap["parts"].items()}
                try:
                    self.log.commit(snap["version"] + 1, {k: v for k, v in snap.items() if k != "version"} | {"parts": parts, "touched": touched})
                except Conflict:
                    return
                snap = self.snapshot()
            level += 1

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Puts rows over those of the same keys. One batch may hold at most one row a key, or the last by all columns counts."""
        rows = rows.select(*[f.name for f in self.table().schema])

        def changed(snap: dict) -> tuple[list[int], DataFrame]:
            touched = self.buckets_of(rows, snap)
            return touched, index.upsert(self._rows(snap, touched), rows, [self.key])

        return self._change(changed, batch)

    def delete(self, ids: DataFrame | None = None, where: dict | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Removes rows of these ids, and those that equal all of `where`. Buckets without such rows are not rewritten."""

        def changed(snap: dict) -> tuple[list[int], DataFrame]:
            every = self._rows(snap)
            keep = index.delete(every, ids, where, self.key)
            gone = every.select(*dict.fromkeys([self.key, self.by])).join(keep.select(self.key), self.key, "left_anti")
            touched = self.buckets_of(gone, snap)
            return touched, index.delete(self._rows(snap, touched), ids, where, self.key)

        return self._change(changed, batch)

    def replace(self, rows: DataFrame, stale: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """One commit that removes the keys of stale (key, bucket_by) and puts rows in."""
        names = [f.name for f in self.table().schema]
        keys = list(dict.fromkeys([self.key, self.by]))

        def changed(snap: dict) -> tuple[list[int], DataFrame]:
            touched = self.buckets_of(rows.select(*keys).unionByName(stale.select(*keys)), snap)
            return touched, index.upsert(index.delete(self._rows(snap, touched), stale, None, self.key), rows.select(*names), [self.key])

        return self._change(changed, batch)

    def get(self, ids: list[str] | None = None, where: dict | None = None, limit: int | None = None, include: list[str] | None = None) -> DataFrame:
        """Ids that decide the bucket themselves are looked for in their own buckets only."""
        snap = self.snapshot()
        some = None
        if ids is not None and self.by == self.key and snap["folders"]:
            kind = self.table().schema[self.key].dataType
            some = self.buckets_of(self.spark.createDataFrame([(i,) for i in ids], "id string").select(F.col("id").cast(kind).alias(self.key)), snap)
        return index.get(self._rows(snap, some), ids, where, limit, include, self.key)

    def count(self) -> int:
        return self.table().count()

    def expire(self, keep: int = 2) -> list[int]:
        """Forgets all versions but the last `keep`, with folders that only they name; returns the versions forgotten. Run it when no reader is on an
        old version and no writer is at work: what a writer has not committed yet is not named either."""
        found = self.log.versions()
        old, kept = found[: max(0, len(found) - max(1, keep))], found[-max(1, keep) :]
        entries = [self.snapshot(v) for v in kept]
        named = {f for e in entries for f in [*e["folders"].values(), *(f for parts in e["parts"].values() for f, _ in parts)]}
        whole = {f.split("/")[1] for f in named}
        for name in self.log.names(f"{self.path}/data"):
            if name not in whole:
                self.log.delete(f"{self.path}/data/{name}")
                continue
            for part in self.log.names(f"{self.path}/data/{name}"):
                if part.startswith("_bucket=") and f"data/{name}/{part}" not in named:
                    self.log.delete(f"{self.path}/data/{name}/{part}")
        self.log.forget(old)
        return old

    def drop(self) -> None:
        self.log.delete(self.path)


def backend(name: Column) -> Column:
    """A known backend's name; anything else is the default one."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(BACKENDS), low).otherwise(DEFAULT_BACKEND)


def backends_of(documents: DataFrame) -> DataFrame:
    """(user_id, backend) of users' ready documents."""
    return documents.filter("status = 'ready'").select("user_id", backend(F.col("vector_backend")).alias("backend")).distinct()


def distance(score: Column) -> Column:
    return 1 - score


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """A chunk's metadata as scalars, without nulls: chunk_id and a map of strings."""
    names = ["doc_id", "source", "page_number", "chunk_index", "char_start", "char_end", "token_count", "strategy", "content_hash"]
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]), lambda p: p["value"].isNotNull())
    return chunks.select("chunk_id", F.map_from_entries(pairs).alias("metadata"))
