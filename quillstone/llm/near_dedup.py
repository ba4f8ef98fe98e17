"""Near-dedup on SetSketch registers: band, estimate jointly by likelihood, verify on whole sets, join components.

1. One pass over the texts makes each document's set of distinct word shingles (64-bit hashes of the words' bytes), its size, a 128-bit digest of the
   set and its registers. Documents with equal sets are one class at once (similarity 1), so copies cost one row from here on.
2. Classes meet in buckets: one for each band of registers. A link of similarity 0.8 misses all 48 bands of 6 with a probability under 1e-6.
3. A bucket never emits its pairs. In the first round each bucket has one hub, drawn by hash, and every other member is paired with it; linked
   members join its component, so a group of thousands of near copies is mostly done. Two more rounds take the member with most links, which is near a
   group's centre, as the hub of each bucket that still holds several components; then up to HUBS members, the rarest components' first, are hubs.
   Hubs are paired with members of other components only. A bucket stays until its
   members are of one component or all have been hubs: every pair of a bucket is compared, connected already, or proved too far apart: shingles that
   no other remaining document has bound what two documents can share. No cap drops a pair.
4. A pair is dropped unseen only if sizes exclude the similarity, or if the sketches make it e^-12 times as likely as the best similarity.
   Of the others, each class's most similar one is compared on whole sets first, then all that are not connected by then.
5. Components come from large-star / small-star rounds over the links, on tables in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import setsketch
from .common import Scratch, frugal, ship, slices
from .textbytes import LOWER, shingles, span_hashes, utf8, words

#: Bands and registers in each; at similarity s a pair shares a bucket with probability 1 - (1 - s^6)^48, over 0.9999995 from 0.8.
BANDS, ROWS = 48, 6
HUBS = 32
#: A pair whose similarity may reach the threshold only with a likelihood e^-12 times the best one's (about five standard errors) is not verified.
DOUBT = 12.0
#: Rounds with one hub a bucket, the member with most links, before those with up to HUBS.
CENTRAL_ROUNDS = 2
#: Hash groups in which shared shingles are bounded.
GROUPS = 128
#: Pairs that share one copy of a hub's set in the verifying join.
PAIRS_PER_COPY = 500


def document_sets(at: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and each row's first (rows + 1 values)."""
    data = LOWER[data]
    starts, ends, first = words(at, data)
    hashes, begin = shingles(span_hashes(data, starts, ends), first, width)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    keep = np.empty(len(hashes), bool)
    for i in range(len(begin) - 1):
        hashes[begin[i] : begin[i + 1]].sort()
    keep[:1] = True
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(begin), np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(begin) - 1), out=out[1:])
    return hashes[keep], out


def _digests(elements: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _sketcher(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                elements, begin = document_sets(*utf8(part.column("text")), width)
                sizes = np.diff(begin)
                registers = setsketch.sketches(elements, begin, BANDS * ROWS)
                keys = setsketch.band_keys(registers, BANDS, ROWS).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(_digests(elements, begin), pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary()), lists], schema=schema)

    return run


def _set_maker(width: int):
    schema = pa.schema([("least", pa.int64()), ("digest", pa.binary()), ("elements", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                elements, begin = document_sets(*utf8(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("least").cast(pa.int64()), pa.array(_digests(elements, begin), pa.binary()), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(elements.view(np.int64)))], schema=schema)

    return run


def _likely(threshold: float):
    """Keeps the pairs that may reach the threshold, with their estimate."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("registers_a", "registers_b"))
            n_one, n_other = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            estimate, doubt = setsketch.joint_estimate(one, other, n_one, n_other, threshold)
            keep = pa.array(doubt <= DOUBT)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(estimate)], ["a", "b", "n_a", "n_b", "estimate"]).filter(keep)

    return run


def connected_components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, component) with the smallest node of each component, for edges (a, b); large-star / small-star until nothing changes.

    Each round links nodes to smaller ones only, so no node gathers a list: every step is a minimum over neighbours, combined on the map side.
    """
    current = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0", few=True)
    mark, round_ = None, 0
    while True:
        round_ += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.unionByName(least.select("a", F.col("m").alias("b")).filter("a <> b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = work.table(small, f"{name}-{round_}", few=True)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{round_ - 1}")
        current = after
        if tuple(now) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
        mark = tuple(now)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are similar on whole sets. A hub in many pairs has its set copied once for PAIRS_PER_COPY of them."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    hubs = sets.join(copies, F.col("class") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("elements").alias("elements_a"))
    both = dealt.join(sets.select(F.col("class").alias("b"), F.col("elements").alias("elements_b")), "b").join(hubs, ["a", "copy"])
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    return both.withColumn("shared", shared).filter(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).select("a", "b")


def _mixed(member: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = member.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", "key")
    return member.join(several, ["band", "key"])


def _common(sets: DataFrame) -> DataFrame:
    """(class, n, common, profile): how many of a class's shingles some other of these classes has too, in all and by hash group.

    Two classes share at most the smaller of their counts in each group. Shingles are counted by 32 bits of their hashes: where two meet by chance,
    the bound is only looser.
    """
    rows = sets.select("class", F.explode("elements").alias("e")).select("class", F.col("e").bitwiseAND(0xFFFFFFFF).alias("e"))
    group = F.pmod(F.col("e"), F.lit(GROUPS)).cast("int").alias("g")
    alone = rows.groupBy("e").agg(F.count("*").alias("n"), F.min("class").alias("class")).filter("n = 1")
    counts = rows.select("class", group, F.lit(1).alias("d")).unionByName(alone.select("class", group, F.lit(-1).alias("d"))).groupBy("class", "g").agg(F.sum("d").alias("c"), F.count_if(F.col("d") > 0).alias("n"))
    per = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("c").alias("common"), F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("m"))
    return per.select("class", "n", "common", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("int")).alias("profile"))


def _linkable(member: DataFrame, percent: int) -> DataFrame:
    """Without the members that can't reach the similarity with any member of their bucket: |x & y| is at most `common`, and |y| at least the bucket's least."""
    least = member.groupBy("band", "key").agg(F.min("n").alias("least"))
    other = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    return member.join(least, ["band", "key"]).filter(F.col("common") * (100 + percent) >= (F.col("n") + other) * percent).drop("least")


class _Components:
    """The growing links and the component of every linked class."""

    def __init__(self, work: Scratch, empty: DataFrame):
        self.work, self.links, self.step = work, [], 0
        self.labels = work.table(empty, "labels-0")

    def of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        known = self.labels.select(F.col("class").alias(column), F.col("component").alias("_known"))
        return rows.join(known, column, "left").withColumn(name, F.coalesce("_known", column)).drop("_known")

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are of different components as yet."""
        return self.of(self.of(pairs, "a", "c_a"), "b", "c_b").filter("c_a <> c_b").drop("c_a", "c_b")

    def degree(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [x.select(F.col(c).alias("class")) for x in self.links for c in "ab"]).groupBy("class").agg(F.count("*").alias("n_links"))

    def add(self, links: DataFrame) -> None:
        """links: a table (a, b). Components are contracted first, so each call works on what is new only."""
        self.step += 1
        self.links.append(links)
        edges = self.of(self.of(links, "a", "c_a"), "b", "c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        joined = connected_components(edges, self.work, f"components-{self.step}").withColumnRenamed("component", "after")
        ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).unionByName(self.labels.select("class")).distinct()
        before = self.of(ends, "class", "component")
        after = before.join(joined.withColumnRenamed("node", "component"), "component", "left").select("class", F.coalesce("after", "component").alias("component"))
        self.labels = self.work.table(after, f"labels-{self.step}", few=True)
        self.work.drop(f"labels-{self.step - 1}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept, n_links (verified links of its class that were needed).

    Texts are lower-cased (A-Z) and parted at space and 0x09 to 0x0D. Fewer words than `width` are one shingle; null, empty and blank texts have
    none and link with nothing. A null id gets a null component and is kept. Rows are compared by their texts: those of an id with several texts may
    be of several components, each with the links of its text.
    """
    ship(spark := docs.sparkSession)
    work = Scratch(spark, "near")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = work.table(base.mapInArrow(frugal(_sketcher(width)), "doc_id bigint, n bigint, digest binary, registers binary, keys array<bigint>"), "sketches")
    usable = made.filter("n > 0 and doc_id is not null")
    # a class is a set, known by its digest; it is numbered here, since one id may stand for several texts. Its smallest id is joined, not aggregated, to its sketch
    least = usable.groupBy("digest", "n").agg(F.min("doc_id").alias("least"))
    heads = usable.join(least, ["digest", "n"]).filter("doc_id = least").dropDuplicates(["digest", "n"]).withColumn("class", F.monotonically_increasing_id())
    heads = work.table(heads.select("class", "least", "n", "digest", "registers", "keys"), "classes")
    signs = heads.select("class", "n", "registers")
    buckets = heads.select("class", F.posexplode("keys").alias("band", "key"))
    # each bucket has its own hub, so a class meets as many different members as it shares buckets
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("members"), F.min_by("class", F.xxhash64("band", "key", "class")).alias("hub")).filter("members > 1")
    buckets = work.table(buckets.join(shared, ["band", "key"]).select("band", "key", "class", "hub"), "buckets-0")
    met = heads.select("class", "least", "digest").join(buckets.select("class").distinct(), "class", "left_semi")
    texts = base.filter("doc_id is not null").withColumnRenamed("doc_id", "least").join(met.select("least").distinct(), "least", "left_semi")
    sets = texts.mapInArrow(frugal(_set_maker(width)), "least bigint, digest binary, elements array<bigint>").join(met, ["least", "digest"])
    sets = work.table(sets.select("class", "elements").dropDuplicates(["class"]), "sets")
    components = _Components(work, heads.select("class", F.col("class").alias("component")).limit(0))
    pairs = buckets.filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    tested, round_ = None, 0
    while True:
        sides = pairs.join(signs.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("registers_a")), "a").join(signs.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("registers_b")), "b")
        sides = sides.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        likely = work.table(sides.mapInArrow(frugal(_likely(percent / 100)), "a bigint, b bigint, n_a bigint, n_b bigint, estimate double"), f"likely-{round_}", few=True)
        work.release()
        # each class with its most similar hub first; then all pairs that these links have not connected
        best = likely.groupBy("b").agg(F.max_by(F.struct("a", "n_a", "n_b"), F.struct("estimate", "a")).alias("m")).select("m.a", "b", "m.n_a", "m.n_b")
        components.add(work.table(_verified(best, sets, percent), f"links-{round_}-best", few=True))
        rest = work.table(components.across(likely.join(best, ["a", "b"], "left_anti")), f"rest-{round_}", few=True)
        if not rest.isEmpty():
            components.add(work.table(_verified(rest, sets, percent), f"links-{round_}-rest", few=True))
        # what is left: members of buckets that still hold several components, without the hubs that have met everyone
        if round_ == 0:
            member = components.of(buckets.filter("class <> hub").select("band", "key", "class"), "class", "component")
            left = work.table(_mixed(member).select("class").distinct(), "left", few=True)
            common = work.table(_common(sets.join(left, "class", "left_semi")), "common", few=True)
            # neither sizes nor bounds change later, so this filter is needed once
            member = _linkable(_mixed(member.join(common, "class")), percent)
        else:
            member = components.of(buckets.filter("not spent").select("band", "key", "class", "n", "common", "profile"), "class", "component")
        member = work.table(_mixed(member), f"mixed-{round_}", few=True)
        if member.isEmpty():
            break
        # members of the rarer components are the next hubs: they have the fewest to be met by
        sizes = member.groupBy("band", "key", "component").agg(F.count("*").alias("in_component"))
        if round_ < CENTRAL_ROUNDS:
            centre = member.join(components.degree(), "class", "left").groupBy("band", "key").agg(F.max_by(F.struct("class", "component", "n", "common", "profile"), F.struct(F.coalesce("n_links", F.lit(0)), "class")).alias("m"))
            chosen = centre.select("band", "key", "m.class", "m.component", "m.n", "m.common", "m.profile", F.lit(1).alias("place"))
        else:
            place = F.row_number().over(Window.partitionBy("band", "key").orderBy("in_component", "component", "class"))
            chosen = member.join(sizes, ["band", "key", "component"]).withColumn("place", place).filter(F.col("place") <= HUBS)
        chosen = work.table(chosen.select("band", "key", F.col("class").alias("hub"), F.col("component").alias("hub_component"), F.col("n").alias("hub_n"), F.col("common").alias("hub_common"), F.col("profile").alias("hub_profile"), "place"), f"hubs-{round_}", few=True)
        done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tested = work.table(done if tested is None else tested.unionByName(done), f"tested-{round_}", few=True)
        round_ += 1
        own = chosen.select("band", "key", F.col("hub").alias("class"), F.col("place").alias("own_place"))
        left = member.join(own, ["band", "key", "class"], "left").withColumn("spent", F.col("own_place").isNotNull())
        buckets = work.table(left.select("band", "key", "class", "component", "n", "common", "profile", "spent", F.coalesce("own_place", F.lit(HUBS + 1)).alias("own_place")), f"buckets-{round_}", few=True)
        shared = F.aggregate(F.zip_with("profile", "hub_profile", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
        needed = (F.col("n") + F.col("hub_n")) * percent
        may = F.when(F.least("common", "hub_common") * (100 + percent) >= needed, shared * (100 + percent) >= needed).otherwise(F.lit(False))
        met = buckets.join(chosen, ["band", "key"]).filter("component <> hub_component and own_place > place").filter(may).select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
        met = met.join(tested, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")
        pairs = work.table(met, f"pairs-{round_}", few=True)
        for name in ("likely", "rest", "mixed", "hubs", "buckets"):
            work.drop(f"{name}-{round_ - 1}")
        if round_ > 1:
            work.drop(f"tested-{round_ - 2}")
        work.release()
    by_class = work.table(components.of(heads.select("digest", "n", "least", "class"), "class", "component").join(components.degree(), "class", "left"), "joined")
    named = by_class.groupBy("component").agg(F.min("least").alias("named"))
    by_class = by_class.join(named, "component").select("digest", "n", F.col("named").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = made.select("doc_id", "n", "digest").join(by_class, ["digest", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay (one document of each component), with docs' columns."""
    kept = near_duplicates(docs, id_col=id_col, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(kept, F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
