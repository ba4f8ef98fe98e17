"""Sentence boundaries learned from the corpus, without labels: abbreviations, collocations and sentence starters by log-likelihood ratios.

A period after a word is a boundary unless the word is an abbreviation, a single letter or a number. What an abbreviation is, the corpus says: it is
short, it has periods inside, and it stands with a final period more often than chance (Dunning's log-likelihood). After an abbreviation, a letter or
a number there is a boundary all the same if the next word begins with a capital and often begins sentences elsewhere; there is none between two words
that stand together with the period more often than chance (a collocation). ! and ? are boundaries always.

All counts are aggregations over all tokens, combined in the tasks; what they decide on is one row a word, or a pair of words around an end mark. A model of
at most MOST words of each kind goes to the executors as a whole. Larger kinds stay in tables, with all their words, and each text gets those it asks for by a join.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shipping import ship
from ..functions.workspace import written

# The thresholds of the published method for abbreviations, collocations and sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Words of each kind up to which a model is held in memory, and shares into which the texts that ask for a common word are dealt.
MOST, SHARES = 50_000, 16
#: A sentence starter begins a sentence in more than this share of its occurrences.
OFTEN = 0.25
#: A token ends its sentence if its end is one of these, closing marks aside.
ENDS = re.compile(r"[.!?][\"'”’)\]]*$")
LAST_MARKS, TOKEN = re.compile(r"[.!?][\"'”’)\]]*(?!\S)"), re.compile(r"\S+")
#: Marks before and after a token that are not counted as part of it; what tokens lie between; kinds of counts; bytes of text counted at a time.
AROUND = "\"'“‘([", "\"'”’)],;:"
NO_BLANK = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
WORD, NEXT, END = 0, 1, 2
BYTES = 8_000_000
#: Documents that are cut at a time.
ROWS = 64
OPENING, CLOSING = AROUND


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str]
    collocations: frozenset[tuple[str, str]]
    starters: frozenset[str]


@dataclass(frozen=True)
class Tables:
    """A model too large for memory: the kinds that are have a row for each of their words (word; word, next; next), the others are sets as in a Model."""

    abbreviations: frozenset[str] | DataFrame
    collocations: frozenset[tuple[str, str]] | DataFrame
    starters: frozenset[str] | DataFrame


def log_likelihood(both: Column, first: Column, second: Column, total: Column, one_sided: bool = True) -> Column:
    """Dunning's ratio that `second` (of total) depends on `first`: both of first have it. One-sided: 0 where they meet less often than by chance."""
    rate = lambda p, k, n: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    rest, other = second - both, F.greatest(total - first, F.lit(1))
    p, p1, p2 = second / total, both / F.greatest(first, F.lit(1)), rest / other
    ratio = 2 * (rate(p1, both, first) + rate(p2, rest, other) - rate(p, both, first) - rate(p, rest, other))
    return F.when(p1 > p2, ratio).otherwise(0.0) if one_sided else ratio


@functools.lru_cache(1 << 17)
def _piece(token: str) -> tuple[str, bool, bool, bool] | None:
    """(word, period, stop, capital) of a white-space token: without marks around it, lower-cased and without its end mark; numbers are one word,
    ##number##. None for a token of marks only."""
    if token.isascii() and token.isalpha():  # most tokens
        return token.lower(), False, False, token[0].isupper()
    t = token.lstrip(AROUND[0]).rstrip(AROUND[1])
    kinds = {c: unicodedata.category(c) for c in t}
    if not any(k[0] in "LN" for k in kinds.values()):
        return None
    bare = t.rstrip(".!?").lower()
    number = all(c in ".,-" or unicodedata.category(c)[0] == "N" for c in bare)
    return "##number##" if number else bare, t.endswith("."), t.endswith(("!", "?")), kinds[t[0]] == "Lu"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        texts = whole.column("text")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.searchsorted(ends, np.arange(BYTES, ends[-1] if len(ends) else 0, BYTES), "right")
        for start, stop in itertools.pairwise(np.unique(np.concatenate([[0], cuts, [len(texts)]])).tolist()):
            yield from _counts_of(T.split_words(texts.slice(start, stop - start), NO_BLANK))


def _counts_of(lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
    at = lists.offsets.to_numpy()
    found = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    pieces = [_piece(t) for t in found.dictionary.to_pylist()]
    places: dict[str, int] = {}
    known = np.array([p is not None for p in pieces], bool)
    word, period, stop, capital = (np.array(x, np.int64) for x in zip(*[(places.setdefault(p[0], len(places)), *p[1:]) if p else (0, 0, 0, 0) for p in pieces], strict=True)) if pieces else (np.zeros(0, np.int64),) * 4
    code, row = found.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(at))
    code, row = code[known[code]], row[known[code]]
    follows, after = row[1:] == row[:-1], code[1:]
    names, w = pa.array(list(places), pa.string()), len(places)

    def batch(kind: int, n: np.ndarray, first=None, end=None, stopped=None, second=None, large=None) -> pa.RecordBatch:
        empty = {"word": pa.string(), "period": pa.bool_(), "stop": pa.bool_(), "next": pa.string(), "capital": pa.bool_()}
        of = lambda x: None if x is None else names.take(pa.array(x))
        flag = lambda x: None if x is None else pa.array(x.astype(bool))
        columns = [pa.nulls(len(n), t) if x is None else x for t, x in zip(empty.values(), (of(first), flag(end), flag(stopped), of(second), flag(large)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), *columns, pa.array(n.astype(np.int64))], ["kind", *empty, "n"])

    n = np.bincount(word[code] * 2 + period[code], minlength=2 * w)
    yield batch(WORD, n[n > 0], *np.divmod(np.flatnonzero(n), 2))
    n = np.bincount(word[after[follows]], minlength=w)
    yield batch(NEXT, n[n > 0], second=np.flatnonzero(n))
    ending = follows & ((period + stop)[code[:-1]] > 0)
    c, x = code[:-1][ending], after[ending]
    keys, n = np.unique((((word[c] * 2 + period[c]) * 2 + stop[c]) * max(w, 1) + word[x]) * 2 + capital[x], return_counts=True)
    rest, large = np.divmod(keys, 2)
    rest, second = np.divmod(rest, max(w, 1))
    rest, stopped = np.divmod(rest, 2)
    first, end = np.divmod(rest, 2)
    yield batch(END, n, first, end, stopped, second, large)


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts n of white-space tokens as words, in rows of three kinds: WORD (word, period) of all tokens; NEXT (next) of all that follow another;
    END (word, period, stop, next, capital) of those with an end mark that another follows, next being its word and capital its beginning."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ["kind", "word", "period", "stop", "next", "capital"]
    return texts.mapInArrow(_counts, "kind int, word string, period boolean, stop boolean, next string, capital boolean, n bigint").groupBy(*keys).agg(F.sum("n").alias("n"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(word, score, n_period, n_plain): words that occur with a final period; 0.3 and more is an abbreviation."""
    pairs = counts.filter(F.col("kind") == WORD)
    by = pairs.groupBy("word").agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("n_period"), F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("n_plain"))
    totals = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("periods"))
    rows = by.filter("n_period > 0 AND word <> '##number##'").join(totals)  # one row of totals
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    inner = F.length("word") - letters + 1
    ratio = log_likelihood(F.col("n_period"), F.col("n_period") + F.col("n_plain"), F.col("periods"), F.col("total"))
    score = ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -F.col("n_plain"))
    return rows.filter(letters > 0).select("word", score.alias("score"), "n_period", "n_plain")


def learn(docs: DataFrame, text_col: str = "text", most: int = MOST) -> Model | Tables:
    """The model of a corpus: null and empty texts have no tokens, repeated rows count each, an empty table gives a model without words.

    All words are kept: a kind of more than `most` makes it Tables, which cut sentences at the same places.
    """
    counts = written(counted(docs, text_col), "tokens")
    scores = written(abbreviation_scores(counts), "abbreviations")
    abbreviations = scores.filter(F.col("score") >= ABBREVIATION).select("word")
    abbreviated = abbreviations.withColumn("short", F.lit(True))
    marked = counts.filter(F.col("kind") == END).join(abbreviated, "word", "left").withColumn("short", F.coalesce("short", F.lit(False)) | (F.length("word") == 1) | (F.col("word") == "##number##"))
    marked = written(marked, "marked")
    each = counts.filter(F.col("kind") == NEXT).select("next", F.col("n").alias("all"))
    breaking = F.col("period") & ~F.col("short") | F.col("stop")
    totals = each.agg(F.sum("all").alias("total")).join(marked.agg(F.coalesce(F.sum(F.when(breaking, F.col("n"))), F.lit(0)).alias("breaks")))  # one row each
    each = each.join(marked.groupBy("next").agg(F.sum(F.when(breaking & F.col("capital"), F.col("n")).otherwise(0)).alias("first")), "next", "left")
    starting = each.filter("first > 0 AND next <> '##number##'").join(totals)
    starters = starting.select("next", log_likelihood(F.col("first"), F.col("breaks"), F.col("all"), F.col("total")).alias("score"), "first", "all").filter(F.col("first") / F.col("all") > OFTEN)
    begins = written(starters.filter(F.col("score") >= STARTER).select("next"), "starters")
    met = marked.filter("period AND short").groupBy("word", "next").agg(F.sum("n").alias("both"))
    firsts = marked.filter("period AND short").groupBy("word").agg(F.sum("n").alias("one"))
    pairs_of = met.join(firsts, "word").join(each.select("next", "all"), "next").join(totals).filter("both > 1")
    together = pairs_of.select("word", "next", log_likelihood(F.col("both"), F.col("one"), F.col("all"), F.col("total")).alias("score"))
    collocations = written(together.filter(F.col("score") >= COLLOCATION).join(begins, "next", "left_anti").select("word", "next"), "collocations")
    kinds = []
    for rows in (abbreviations, collocations, begins):
        held = rows.limit(most + 1).collect()
        kinds.append(rows if len(held) > most else frozenset(r[0] if len(r) == 1 else tuple(r) for r in held))
    return (Model if all(isinstance(k, frozenset) for k in kinds) else Tables)(*kinds)


def breaks_after(token: str, follower: str | None, model: Model) -> bool:
    """Is there a sentence boundary after this white-space token?"""
    if not ENDS.search(token):
        return False
    bare = token.strip(OPENING).rstrip(CLOSING)
    if follower is None or not bare.endswith(".") or bare.endswith(("!", "?")):
        return True
    word = bare.rstrip(".!?").lower()
    number = re.fullmatch(r"[\d.,\-]+", word) is not None
    if not (word in model.abbreviations or len(word) == 1 or number):
        return True
    after = follower.strip(OPENING).rstrip(CLOSING)
    plain = after.rstrip(".!?").lower()
    key = "##number##" if number else word
    return after[:1].isupper() and plain in model.starters and (key, plain) not in model.collocations


def sentence_offsets(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of sentences, without the white space between them. Only tokens with an end mark are looked at."""
    first, last = TOKEN.search(text), len(text.rstrip())
    if first is None:
        return []
    out, start = [], first.start()
    for mark in LAST_MARKS.finditer(text):
        end, at = mark.end(), mark.start()
        if end == last:
            break
        while at > start and not text[at - 1].isspace():
            at -= 1
        follower = TOKEN.search(text, end)
        if breaks_after(text[at:end], follower.group(), model):
            out.append((start, end))
            start = follower.start()
    return [*out, (start, last)]


class _Asked(set):
    """Holds all that is asked of it, and remembers it."""

    def __contains__(self, x) -> bool:
        self.add(x)
        return True


def _kinds(model: Model | Tables) -> dict[int, frozenset | DataFrame]:
    return {WORD: model.abbreviations, END: model.collocations, NEXT: model.starters}


def _questions(held: dict[int, frozenset]):
    """(row, text) to what a text asks of the kinds that aren't held: (row, kind, word, next), each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                out = []
                for row, text in zip(*(c.to_pylist() for c in whole.slice(start, ROWS).columns), strict=True):
                    asked = {kind: _Asked() for kind in (WORD, END, NEXT) if kind not in held}
                    of = asked | held
                    sentence_offsets(text or "", Model(of[WORD], of[END], of[NEXT]))
                    out += [(row, kind, *((x, "") if kind == WORD else ("", x) if kind == NEXT else x)) for kind, words in asked.items() for x in words]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["row", "kind", "word", "next"])

    return run


def informed(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """docs (doc_id, text) for the `cutter` of a model: with Tables they get known, the words and pairs in them that a text asks for."""
    if isinstance(model, Model):
        return docs.select("doc_id", "text")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    held = {kind: words for kind, words in _kinds(model).items() if isinstance(words, frozenset)}
    column = lambda words, name: F.col(name) if name in words.columns else F.lit("").alias(name)
    tables = [words.select(F.lit(kind).alias("kind"), column(words, "word"), column(words, "next")) for kind, words in _kinds(model).items() if kind not in held]
    words = functools.reduce(DataFrame.unionByName, tables).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    asked = rows.select("row", "text").mapInArrow(_questions(held), "row bigint, kind int, word string, next string").withColumn("share", F.pmod(F.hash("row"), F.lit(SHARES)))
    known = asked.join(words, ["kind", "word", "next", "share"]).groupBy("row").agg(F.collect_list(F.struct("kind", "word", "next")).alias("known"))
    return rows.join(known, "row", "left").select("doc_id", "text", "known")


def cutter(model: Model | Tables):
    """sentence_offsets of the texts that `informed` gives, with what is known for each."""
    whole = model if isinstance(model, Model) else None
    held = {kind: words for kind, words in _kinds(model).items() if isinstance(words, frozenset)}

    def cut(text: str, known: list[dict] | None = None) -> list[tuple[int, int]]:
        if whole is not None:
            return sentence_offsets(text, whole)
        of = {WORD: set(), END: set(), NEXT: set()}
        for k in known or []:
            of[k["kind"]].add({WORD: k["word"], END: (k["word"], k["next"]), NEXT: k["next"]}[k["kind"]])
        of |= held
        return sentence_offsets(text, Model(of[WORD], of[END], of[NEXT]))

    return cut


def sentences(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """(doc_id, sentence_no, char_start, char_end, text) of docs (doc_id, text)."""
    ship(docs.sparkSession)

    names, offsets = ["doc_id", "sentence_no", "char_start", "char_end", "text"], cutter(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                texts, *known = (c.to_pylist() for c in part.columns[1:])
                found = [offsets(t, *k) if t else [] for t, *k in zip(texts, *known, strict=True)]
                sizes = np.array([len(f) for f in found])
                at = np.repeat(np.arange(len(found)), sizes)
                spans = np.array([s for f in found for s in f], np.int32).reshape(-1, 2)
                no = (np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                cut = pa.array([t[a:b] for t, f in zip(texts, found, strict=True) for a, b in f], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(no), pa.array(spans[:, 0]), pa.array(spans[:, 1]), cut], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return informed(docs, model).mapInArrow(run, f"doc_id {kind}, sentence_no int, char_start int, char_end int, text string")
