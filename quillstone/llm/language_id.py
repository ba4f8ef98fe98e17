"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over all its segmentations
into pieces of the product of their probabilities, which the forward algorithm gives in one pass; a text's is the product over its words. Letters
that no piece covers count as an unknown piece. Distributions are fitted by expectation-maximisation: expected piece counts come from forward and
backward sums over the word types of a sample of labelled rows (at most ROWS_PER_LANG rows a language, chosen by a hash of id and text).

Scoring is one pass over whole texts. Words of a batch are scored once each, all at the same time, position by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal, ship, slices

#: Labelled rows used for each language, about; rounds of expectation-maximisation; added to every expected count.
ROWS_PER_LANG, ROUNDS, SMOOTHING = 1_500, 2, 0.01
#: Probability of one letter that no piece covers, the same in every language.
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Positions after which forward and backward sums are scaled.
SCALED = 12
#: Bytes of scores and, about, of words that a model remembers within one task.
MEMO_BYTES = 32_000_000
#: A run of letters, which are the categories L* of Unicode: digits in rings or in superscript are none.
_WORD = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that consist of letters, lower-cased, with or without the mark of a word's start, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in pieces if (q := p.removeprefix("▁")) and _WORD.fullmatch(q) and _WORD.fullmatch(q.lower())})


class Lattice:
    """All pieces at all positions of many words at once, through a trie whose edges are sorted (node, letter) pairs."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.letters = pieces, {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        nodes, edges, self.longest = 1, {}, max(map(len, pieces), default=1)
        ends: dict[int, int] = {}
        for n, piece in enumerate(pieces):
            at = 0
            for c in piece:
                key = at * (len(self.letters) + 1) + self.letters[c]
                if key not in edges:
                    edges[key], nodes = nodes, nodes + 1
                at = edges[key]
            ends[at] = n
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(nodes, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.code = np.zeros(0x110000, np.int32)
        for c, i in self.letters.items():
            self.code[ord(c)] = i

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes (0: none) with the start mark before each word, padded with -1; lengths."""
        n = np.array([len(w) + 1 for w in words])
        flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), np.uint32)
        out = np.full((len(words), int(n.max(initial=1))), -1, np.int32)
        out[np.arange(out.shape[1]) < n[:, None]] = self.code[flat]
        return out, n

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node * (len(self.letters) + 1) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((letter > 0) & (self.keys[at] == key), self.to[at], -1)

    def edges_from(self, codes: np.ndarray, i: int):
        """(rows, length, piece or -1 for an unknown letter) of every edge that begins at position i."""
        rows = np.flatnonzero(codes[:, i] >= 0)
        yield rows, 1, None
        node = np.zeros(len(rows), np.int64)
        for k in range(min(self.longest, codes.shape[1] - i)):
            node = self.step(node, codes[rows, i + k])
            rows, node = rows[node >= 0], node[node >= 0]
            if not len(rows):
                return
            piece = self.piece[node]
            full = piece >= 0
            if full.any():
                yield rows[full], k + 1, piece[full]

    def forward(self, codes: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward sums (words, positions + 1, languages), the log of the scale at each position, log probability of each word."""
        m, width = codes.shape
        alpha = np.zeros((m, width + self.longest + 1, p.shape[1]))
        alpha[:, 0] = 1
        scale = np.zeros((m, width + 1, 1))
        for i in range(width):
            if i and i % SCALED == 0:  # keep long words away from underflow
                top = alpha[:, i].max(1, keepdims=True)
                top[top <= 0] = 1
                alpha[:, i : i + self.longest + 1] /= top[:, None]
                scale[:, i:] += np.log(top)[:, None]
            for rows, k, piece in self.edges_from(codes, i):
                alpha[rows, i + k] += alpha[rows, i] * (UNKNOWN if piece is None else p[piece])
        rows = np.arange(m)
        return alpha, scale, np.log(np.maximum(alpha[rows, n], 1e-300)) + scale[rows, n]

    def expected(self, codes: np.ndarray, n: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts (pieces, languages) when word i occurs weight[i, l] times in language l. Words may have any length."""
        alpha, scale, total = self.forward(codes, n, p)
        m, width = codes.shape
        beta, beta_scale = np.zeros_like(alpha), np.zeros((m, 1))
        beta[np.arange(m), n] = 1
        out = np.zeros_like(p)
        for i in range(width - 1, -1, -1):
            if i % SCALED == 0:
                top = beta[:, i + 1].max(1, keepdims=True)
                top[top <= 0] = 1
                beta[:, i + 1 : i + self.longest + 1] /= top[:, None]
                beta_scale += np.log(top)
            # what alpha[i] * beta[i + k] stands for, as a share of the word's probability
            true = weight * np.exp(scale[:, i] + beta_scale - total)
            for rows, k, piece in self.edges_from(codes, i):
                through = (UNKNOWN if piece is None else p[piece]) * beta[rows, i + k]
                beta[rows, i] += through
                if piece is not None:
                    np.add.at(out, piece, alpha[rows, i] * through * true[rows])
        return out


def _by_length(words: list[str], cells: int = 60_000):
    """Index lists of words of like length, so that little is padding."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for i, at in enumerate(order):
        if i > start and (i - start + 1) * (len(words[at]) + 2) > cells:
            yield order[start:i]
            start = i
    if start < len(order):
        yield order[start:]


class Model:
    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.lattice, self.languages, self.p = Lattice(pieces), languages, p
        self._forget()

    def _forget(self) -> None:
        self.row, self.scores, self.held = {}, np.zeros((0, len(self.languages)), np.float32), 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at in _by_length(words, max(2_000, 240_000 // max(1, len(self.languages)))):
            codes, n = self.lattice.matrix([words[i] for i in at])
            out[at] = self.lattice.forward(codes, n, self.p)[2]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language for each text and its share of the probability; 'und' with 0 for a text without letters."""
        found = [_WORD.findall((t or "").lower()) for t in texts]
        new = list({w for ws in found for w in ws if w not in self.row})
        if self.held > MEMO_BYTES:
            self._forget()
            new = list({w for ws in found for w in ws})
        if new:
            self.held += sum(map(len, new)) + len(new) * (100 + 4 * len(self.languages))
            self.row.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.word_scores(new).astype(np.float32)])
        n = np.array([len(ws) for ws in found])
        flat = self.scores[np.array([self.row[w] for ws in found for w in ws], np.int64)]
        total = np.zeros((len(texts), len(self.languages)))
        if len(flat):
            total[n > 0] = np.add.reduceat(flat.astype(np.float64), (np.cumsum(n) - n)[n > 0])
        share = np.exp(total - total.max(1, keepdims=True, initial=-np.inf))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)], np.where(n > 0, share[np.arange(len(best)), best], 0.0)


def fit(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(pieces, languages, probabilities) learned from rows whose lang and text aren't null: of each language the rows_per_lang rows with the smallest
    hash of id and text, or all if it has fewer. Null and repeated ids are ids like others, and repeated rows count each."""
    ship(spark := docs.sparkSession)
    pieces = vocabulary(vocabulary_path)
    base = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return pieces, [], np.zeros((len(pieces), 0))
    key = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 40))
    # twice the share that is wanted; a language of which too few rows are below it, as with repeated rows, goes whole to the ranking
    share = {k: min(1.0, 2 * rows_per_lang / counts[k]) for k in languages}
    below = lambda: key < F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, share[k])]), F.col("lang")) * (1 << 40)
    enough = {r["lang"]: r["n"] for r in base.filter(below()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share |= {k: 1.0 for k in languages if enough.get(k, 0) < min(rows_per_lang, counts[k])}
    # Spark keeps the smallest rows_per_lang of each task before it shuffles
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = base.filter(below()).withColumn("key", key).withColumn("place", place).filter(F.col("place") <= rows_per_lang)
    types = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    types = Scratch(spark, "langid").table(types.repartition(8), "types")
    index = {k: i for i, k in enumerate(languages)}
    p = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))

    def e_step(probabilities):
        def run(batches):
            lattice, out = Lattice(pieces), np.zeros_like(probabilities)
            for batch in batches:
                langs, words = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
                n = batch.column("n").to_numpy()
                for at in _by_length(words, 120_000 // len(languages)):
                    weight = np.zeros((len(at), len(languages)))
                    weight[np.arange(len(at)), [index[langs[i]] for i in at]] = n[at]
                    out += lattice.expected(*lattice.matrix([words[i] for i in at]), probabilities, weight)
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(out[piece, lang])], ["piece", "lang_at", "n"])

        return run

    for _ in range(rounds):
        rows = types.mapInArrow(frugal(e_step(p)), "piece bigint, lang_at bigint, n double").groupBy("piece", "lang_at").agg(F.sum("n").alias("n")).collect()  # at most pieces * languages
        p = np.full_like(p, SMOOTHING)
        for r in rows:
            p[r["piece"], r["lang_at"]] += r["n"]
        p /= p.sum(0)
    return pieces, languages, p


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All rows and columns of docs in a struct `row`, plus lang_pred and score (0 to 1).

    'und' with score 0 for a text that is null or has no letter, and for every text if the model has learned no language. Texts are scored whole.
    """
    ship(spark := docs.sparkSession)
    pieces, languages, p = model
    shared = spark.sparkContext.broadcast((pieces, languages, p))  # vocabulary times languages
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        model = Model(*shared.value) if languages else None
        for batch in batches:
            for part in slices(batch, "text"):
                if model:
                    lang, score = model.predict(part.column("text").to_pylist())
                else:
                    lang, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    kind = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(frugal(run), f"`row` {kind}, lang_pred string, score double")


def held_out_fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0
