"""Filter interaction audit by lattice edges.

k filters applied in any order walk a lattice: a step is an edge (filters already applied, next filter), and there are k * 2^(k-1) of them (80 for
five) whatever the order. A document meets every edge in a way that only its set of failed filters decides. So documents are counted by (part,
failed set) on the map side, the counts contribute to the edges, and each order is a path of k edges: a join of the counted edges with the k! * k
steps. Nothing is recounted per order, and after the first count no table grows with the documents.

The text is read once. What goes on is a digest, the failed set and the id; the check for identical texts groups digests (a hot text is combined on
the map side) and finds each text's smallest id by a join on id and digest, which no hot text makes uneven.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: More filters would have too many orders to list: 8 have 40,320 of them, in 322,560 steps a part.
MOST_FILTERS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def repeated_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def many_capitals(text: Column, words: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text)


def has_symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: A filter's name, one letter, and its failure condition on a text and its words; None: identical to the text of a smaller id.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": has_symbols, "E": None}


def failed_sets(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bit i: fails the i-th filter), n, good, toxic: how many documents fail just these filters, and how many of them have a label
    quality = 1 or toxic = 1.

    Null text counts as empty, a null part as ''. Texts are compared by SHA-256. A row whose id is null is identical to nothing and nothing to it;
    rows that repeat the smallest id of a text are no copies of a smaller id. An id with several labels has what any of them says.
    """
    work, names = Scratch(docs.sparkSession, "audit"), list(filters)
    if len(names) > MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"at most {MOST_FILTERS} filters, each with a name of one letter, not {names}")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    worded = rows.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for bit, rule in enumerate(filters.values()):
        if rule is not None:
            mask = mask.bitwiseOR(F.when(rule(F.col("body"), F.col("words")), 1 << bit).otherwise(0))
    seen = work.table(worded.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), mask.alias("mask")), "seen")
    is_label = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(is_label("quality").alias("good"), is_label("toxic").alias("toxic"))
    found = seen.filter(F.col("id").isNotNull()).join(said, "id", "left")
    own = [1 << b for b, rule in enumerate(filters.values()) if rule is None]
    if own:
        first = seen.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
        found = found.join(first, ["id", "digest"], "left")
        found = found.withColumn("mask", F.when(F.col("is_first").isNull(), F.col("mask").bitwiseOR(F.lit(sum(own)))).otherwise(F.col("mask")))
    # rows without an id meet no label and no copy, so they stay out of the joins, where they would be one key
    found = found.unionByName(seen.filter(F.col("id").isNull()), allowMissingColumns=True)
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def lattice_edges(counted: DataFrame, k: int) -> DataFrame:
    """part, before (a set of applied filters), step_filter (the next one) and the counts of that edge, from failed_sets; all edges of every part."""
    pairs = [F.struct(F.lit(s).alias("before"), F.lit(f).alias("step_filter")) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    met = counted.select("*", F.explode(F.array(*pairs)).alias("edge")).select("*", "edge.*")
    bit = F.expr("shiftleft(1, step_filter)")
    fails, out = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    sums = [total(~fails & ~out), total(fails & ~out), total(fails & out), total(F.col("mask") == bit), total(fails & ~out, "good"), total(fails & ~out, "toxic")]
    return met.groupBy("part", "before", "step_filter").agg(*[s.alias(c) for s, c in zip(sums, COUNTS, strict=True)])


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, **columns) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, each order of the
    filters and each step of it, zeros included. An empty table has no parts and no rows. labels: doc_id, quality, toxic. shapley: what the step's
    filter removes, summed over all orders: an edge lies on |before|! (k - 1 - |before|)! of them.
    """
    spark, names, k = docs.sparkSession, list(filters), len(filters)
    edges = lattice_edges(failed_sets(docs, labels, filters, **columns), k)
    orders = F.array(*[F.lit(float(math.factorial(s) * math.factorial(k - 1 - s))).cast("long") for s in range(k)])
    share = F.col("removed") * F.get(orders, F.bit_count("before"))
    edges = edges.withColumn("shapley", F.sum(share).over(Window.partitionBy("part", "step_filter")))
    steps = [("".join(p), i + 1, sum(1 << names.index(x) for x in p[:i]), names.index(p[i])) for p in itertools.permutations(names) for i in range(k)]
    paths = spark.createDataFrame(steps, "filter_order string, step int, before int, step_filter int")
    return edges.join(paths, ["before", "step_filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
