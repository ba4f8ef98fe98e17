"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Words at distance one share such a key: a longer word's deletion is the shorter word, and
words that differ in one place share the deletion of that place. Sharing a key is not enough, so a deletion carries the run of equal letters it was
taken from: two words with one key are at distance exactly one if one of them is the key, or if their runs overlap (the differing letter then stands
at one place of both). Each pair meets this at one key only, so no pair is found twice and no text is compared again.

How many words share a key is bounded by its length and the alphabet (a key of n letters is a deletion of at most 89 (n + 1) words), not by the
documents. Counting combines words in the tasks before it shuffles. Forms are followed to their roots by doubling: n at least doubles from a word to
its form, so chains are at most 63 long and seven rounds reach every root.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, ship, slices

# A word is a run of these letters; ASCII capitals are lowered before.
RUN = re.compile(r"[a-zÀ-ÿ]+")
#: One in so many runs of a document loses a letter.
TYPO_EVERY = 97
#: Distinct words that a task counts before it passes them on.
FLUSH = 200_000


def _counter(least_length: int, typo_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "body"):
                for key, text in zip(part.column("key").to_pylist(), part.column("body").to_pylist(), strict=True):
                    seed = zlib.crc32(f"{key}:".encode())
                    # bytes.lower changes A-Z alone
                    for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                        if len(word) < least_length:
                            continue
                        if typo_every and not (h := zlib.crc32(word.encode(), seed)) % typo_every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        total[word] = total.get(word, 0) + n
                    if len(total) >= FLUSH:
                        yield counted()
        if total:
            yield counted()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3, typo_every: int = TYPO_EVERY) -> DataFrame:
    """word, n: runs of Latin letters of whole texts with ASCII capitals lowered, of at least least_length code points and least_n occurrences.

    A run whose crc32 of `<id>:<run>` is a multiple of typo_every loses the code point at crc32 % length; 0 leaves all runs as they are. Null texts
    have no words, a null id counts as empty; repeated rows count each.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    found = rows.mapInArrow(frugal(_counter(least_length, typo_every)), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def deletion_keys(words: DataFrame) -> DataFrame:
    """word, n, key, low, high: the word itself (low and high null), and its distinct single deletions with the run of equal letters they are from."""
    letter = lambda i: F.substring(F.col("word"), i, F.lit(1))
    size = F.length("word")
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (letter(i) != letter(i - 1)))
    runs = words.withColumn("starts", starts).select("word", "n", F.posexplode("starts").alias("nth", "low"), "starts")
    high: Column = F.coalesce(F.get("starts", F.col("nth") + 1) - 1, size)
    cut = F.concat(F.substring(F.col("word"), F.lit(1), F.col("low") - 1), F.substring(F.col("word"), F.col("low") + 1, size))
    none = F.lit(None).cast("int")
    return runs.select("word", "n", cut.alias("key"), "low", high.alias("high")).unionByName(words.select("word", "n", F.col("word").alias("key"), none.alias("low"), none.alias("high")))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words at distance exactly one, in both directions."""
    keys = deletion_keys(words)
    a, b = keys.alias("a"), keys.select(*[F.col(c).alias(f"b_{c}") for c in keys.columns]).alias("b")
    one_is_key = F.col("low").isNull() != F.col("b_low").isNull()
    same_place = (F.col("low") <= F.col("b_high")) & (F.col("b_low") <= F.col("high"))
    met = a.join(b, (F.col("key") == F.col("b_key")) & (F.col("word") != F.col("b_word")) & (one_is_key | F.coalesce(same_place, F.lit(False))))
    return met.select("word", "n", F.col("b_word").alias("near"), F.col("b_n").alias("near_n"))


def roots(forms: DataFrame, work: Scratch) -> DataFrame:
    """word, root of a table (word, form) without nulls and cycles: forms followed to the last, twice as far each round."""
    state = work.table(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "root-0", few=True)
    for n in itertools.count(1):
        if state.filter("not done").isEmpty():
            return state.select("word", "root")
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("done").alias("reached"))
        open_ = state.filter("not done").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.coalesce("reached", F.lit(True)).alias("done"))
        state = work.table(state.filter("done").unionByName(open_), f"root-{n}", few=True)
        work.drop(f"root-{n - 1}")


def variants(docs: DataFrame, factor: int = 2, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of word_counts.

    n_near: words at distance one. form: of these the one of largest n, the smallest in code-point order among equals, if its n is at least factor
    times the word's own; else null, with form_n. root: the last of the word's forms, or the word. No words, no rows.
    """
    if factor < 2:
        raise ValueError(f"factor {factor} must be at least 2, or forms could go in circles")
    work = Scratch(docs.sparkSession, "spelling")
    words = work.table(word_counts(docs, **counting), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    form_n = -F.col("best.n")
    kept = form_n >= factor * F.col("n")
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.word")).alias("form"), F.when(kept, form_n).alias("form_n"))
    formed = work.table(joined, "forms")
    last = roots(formed.filter("form is not null"), work)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
