"""Numerical parts against brute force: Huffman codes, tokenisation, sketches, lattices, packing plans."""

import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import language_id, packing, setsketch, textbytes, token_codec
from quillstone.llm.tokenizing import Encoder, default_path


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=300))
def test_code_lengths(counts):
    lengths = token_codec.code_lengths(np.array(counts), 12)
    assert lengths.max() <= 12 and (2.0 ** -lengths.astype(float)).sum() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=7), st.integers(3, 5))
def test_code_lengths_are_the_shortest(counts, limit):
    # every multiset of lengths that Kraft's inequality allows, the longest for the rarest
    best = min(
        sum(n * k for n, k in zip(sorted(counts), sorted(lengths, reverse=True), strict=True))
        for lengths in itertools.combinations_with_replacement(range(1, limit + 1), len(counts))
        if sum(2.0**-k for k in lengths) <= 1
    )
    assert (np.array(counts) * token_codec.code_lengths(np.array(counts), limit)).sum() == best


def test_round_trip():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.2, 20_000), 3_000).astype(np.int64)
    begin = np.array([0, 0, 1, 700, 20_000])
    symbols = np.unique(ids)
    lengths = np.zeros(3_001, np.int64)
    lengths[symbols] = token_codec.code_lengths(np.bincount(ids)[symbols])
    data, first, at = token_codec.pack_bits(ids, begin, token_codec.canonical_codes(lengths), lengths)
    starts = np.concatenate([np.arange(a, b, token_codec.LANE) for a, b in zip(begin[:-1], begin[1:], strict=True)]).astype(int)
    counts = np.minimum(token_codec.LANE, begin[1:][np.searchsorted(begin[1:], starts, "right")] - starts)
    assert (token_codec.decoder(symbols, lengths[symbols])(data, at[starts], counts) == ids).all() and first[-1] == len(data)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenising_equals_the_library(name):
    rnd, code = random.Random(1), Encoder(default_path(name))
    odd = ["", " ", "a  b", " lead", "trail ", "it's  we'll 's", "a b　c", "x\x1cy", "<|endoftext|> hi", "hello <|endoftext|> world", "a<|startoftext|>b <|endoftext|>", "<|endoftext|", "|>", "a b\n\nc", "ΑΣ ẞ İ", "\n\n\nab\n\n", "é é ́a", "12 345 6", None]
    texts = odd + ["".join(rnd.choice(" \n\t ab's1.é日_…") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    ids, begin = code.encode(pa.array(texts))
    library = Tokenizer.from_file(default_path(name))  # as a user has it
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want


def test_words_and_shingles():
    texts = ["one two\tthree\x0bfour five", None, "", "  ", "solo", "one two three four five"]
    at, data = textbytes.utf8(pa.array(texts))
    starts, ends, first = textbytes.words(at, data)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == b"one two three four five solo one two three four five".split()
    hashes, begin = textbytes.shingles(textbytes.span_hashes(data, starts, ends), first, 4)
    assert np.diff(begin).tolist() == [2, 0, 0, 0, 1, 2] and (hashes[:2] == hashes[3:]).all()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 600
        both = int(2 * n * j / (1 + j))
        pairs = [(x := rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64), np.concatenate([x[:both], x[n : 2 * n - both]])) for _ in range(40)]
        sets = [s for x, y in pairs for s in (x[:n], y)]
        registers = setsketch.sketches(np.concatenate(sets), np.arange(0, n * 81, n), 288)
        found, doubt = setsketch.joint_estimate(registers[::2], registers[1::2], np.full(40, n), np.full(40, n))
        assert abs(found.mean() - j) < 0.02 and (j < 0.8 or doubt.max() < 12) and (j > 0.5 or doubt.min() > 12)
        union = setsketch.sketches(np.concatenate([np.union1d(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)]), np.concatenate([[0], np.cumsum([len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)])]), 288)
        assert (union == setsketch.merged(registers[::2], registers[1::2])).all()


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁a", "a", "b", "ab", "▁ab", "ba"])
    lattice, p = language_id.Lattice(pieces), np.random.default_rng(0).dirichlet(np.ones(6), 2).T

    def brute(word, at=0):
        if at == len(word):
            return np.ones(2)
        total = language_id.UNKNOWN * brute(word, at + 1)
        for k in range(1, 4):
            if word[at : at + k] in pieces and at + k <= len(word):
                total = total + p[pieces.index(word[at : at + k])] * brute(word, at + k)
        return total

    words = ["a", "ab", "abba", "xa", "abab", "bbab"]
    codes, n = lattice.matrix(words)
    assert np.allclose(lattice.forward(codes, n, p)[2], [np.log(brute("▁" + w)) for w in words])
    twelve = ["ab" * 5 + "a", "ab" * 6, "b" * 12]  # ends at and beside a scaling
    codes, n = lattice.matrix(twelve)
    assert np.allclose(lattice.forward(codes, n, p)[2], [np.log(brute("▁" + w)) for w in twelve])


def test_expected_counts_sum_all_segmentations():
    pieces = sorted(["▁a", "a", "b", "ab", "▁ab", "ba"])
    lattice, p = language_id.Lattice(pieces), np.random.default_rng(1).dirichlet(np.ones(6), 2).T

    def paths(word, at=0):
        if at == len(word):
            yield [], np.ones(2)
            return
        for rest, q in paths(word, at + 1):
            yield rest, language_id.UNKNOWN * q
        for k in range(1, 4):
            if at + k <= len(word) and word[at : at + k] in pieces:
                i = pieces.index(word[at : at + k])
                for rest, q in paths(word, at + k):
                    yield [i, *rest], p[i] * q

    words, weight = ["ab", "abba", "xa", "abababababab", "ababababababab"], np.array([[1.0, 2], [3, 0], [1, 1], [2, 5], [1, 1]])
    want = np.zeros_like(p)
    for w, n in zip(words, weight, strict=True):
        found = list(paths("▁" + w))
        total = sum(q for _, q in found)
        for used, q in found:
            for i in used:
                want[i] += n * q / total
    assert np.allclose(lattice.expected(*lattice.matrix(words), p, weight), want)
    long = lattice.expected(*lattice.matrix(["ab" * 300]), p, np.ones((1, 2)))
    assert np.isfinite(long).all() and np.allclose((long * [[len(x.strip("▁"))] for x in pieces]).sum(0), 600, rtol=0.02)


def test_forward_of_a_long_word():
    pieces = sorted(["▁a", "a", "b", "ab", "▁ab", "ba"])
    lattice, p = language_id.Lattice(pieces), np.random.default_rng(0).dirichlet(np.ones(6), 2).T
    long = lattice.matrix(["ab" * 400])
    assert np.isfinite(lattice.forward(*long, p)[2]).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_sweep_plan_is_best_fit_decreasing(counts):
    first, sequence, each, offset, length = packing.sweep_plan(counts, 64)
    used: dict[int, list] = {}
    for rank, size in enumerate(s for s in sorted(counts, reverse=True) for _ in range(counts[s])):
        run = int(np.searchsorted(first, rank, "right") - 1)
        nth = rank - first[run]
        assert length[run] == size
        used.setdefault(int(sequence[run] + nth // each[run]), []).append((int(offset[run] + nth % each[run] * size), size))
    for spans in used.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= 64
    gaps: list[int] = []
    for size in (s for s in sorted(counts, reverse=True) for _ in range(counts[s])):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 64) - size)
    assert len(used) == len(gaps)


def sweeps(lengths, capacity):
    """Sequences that bulk-synchronous sweeps open: in each, pieces from the longest down take the smallest gap that no other piece has taken."""
    left, gaps, opened = sorted(lengths, reverse=True), [], 0
    while left:
        if not any(g >= left[-1] for g in gaps):
            more = -(-sum(left) // capacity)
            gaps, opened = gaps + [capacity] * more, opened + more
        gaps.sort(reverse=True)
        free, later, kept, at = [], [], [], 0
        for size in left:
            while at < len(gaps) and gaps[at] >= size:
                free.append(gaps[at])
                at += 1
            if free:
                kept.append(free.pop() - size)
            else:
                later.append(size)
        gaps, left = [g for g in kept + free + gaps[at:] if g], later
    return opened


def test_sweep_plan_is_within_a_sequence_of_plain_sweeps():
    # neither is always the better one: of the first draw the sweeps need 1523 sequences, the plan 1524
    rnd = np.random.default_rng(5)
    for draw in (rnd.integers(1, 2049, 3000), rnd.integers(1, 60, 5000), rnd.lognormal(6, 1, 3000).astype(int).clip(1, 2048)):
        counts = dict(zip(*(x.tolist() for x in np.unique(draw, return_counts=True)), strict=True))
        first, sequence, each, _, _ = packing.sweep_plan(counts, 2048)
        opened = int((sequence + (np.diff([*first, len(draw)]) - 1) // each).max()) + 1
        assert -(-int(draw.sum()) // 2048) <= opened <= sweeps(draw.tolist(), 2048) + 1


def test_language_sample_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    words = {"en": "the house is big and the garden was green with many trees".split(), "de": "das haus ist gross und der garten war schön mit vielen bäumen".split()}
    text = lambda k: " ".join(rng.choices(words[k], k=12))
    schema = "doc_id bigint, text string, lang string"
    nulls = spark.createDataFrame([(None, text(k), k) for k in words for _ in range(3000)], schema)
    few = spark.createDataFrame([(i % 3, text(k), k) for k in words for i in range(3000)], schema)
    same = spark.createDataFrame([(1, " ".join(words[k]), k) for k in words for _ in range(3000)], schema)
    asked = spark.createDataFrame([(1, "the house is big"), (2, "das haus ist gross"), (3, None), (4, "123")], "doc_id bigint, text string")
    for docs in (nulls, few, same):
        model = language_id.fit(docs, default_path("piece_bpe_32k.model"), rows_per_lang=200, rounds=2)
        found = {r.row.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()}
        assert found == {1: "en", 2: "de", 3: "und", 4: "und"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_language_of_held_out_documents(spark):
    from quillstone.llm import queries

    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in queries.op4_segment_unigrams(spark, "/root/testdata/sf0.01").collect() if r.held_out and langs[r.doc_id]]
    assert len(rows) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.99 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
