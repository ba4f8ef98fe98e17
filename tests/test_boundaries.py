"""Learned sentence boundaries: held-out text, counts and scores against plain loops, odd rows."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import boundaries

NAMES, VERBS, THINGS = ["Smith", "Jones", "Brown", "Miller"], ["saw", "sold", "found", "kept"], ["pumps", "valves", "gears", "seals"]


def corpus(rng, n):
    """Texts and their true sentences."""
    out = []
    for _ in range(n):
        said = []
        for _ in range(12):
            kind = rng.randrange(7)
            who, verb, what = rng.choice(NAMES), rng.choice(VERBS), rng.choice(THINGS)
            said.append([f"Then Dr. {who} {verb} the {what} again.", f"The {what} and e.g. the gears were {verb} by us.", f"However the old {what} were fine!", f"It was Mr. {who} who {verb} them.", f"The shop of J. {who} had no. 7 and no. 8 of the {what}.", f"They told us again that we sold them to us and them again and again with {what} here.", f"The men here gave us and them some {what} again and again as told by us all."][kind])
        out.append(said)
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(s)) for i, s in enumerate(corpus(random.Random(1), 300))] + [(None, None), (1, "")]
    return boundaries.learn(spark.createDataFrame(rows, "doc_id int, text string"))


def test_held_out_text(spark, model):
    assert {"dr", "e.g", "mr", "no"} <= model.abbreviations and not {"again", "us", "them", "gears", "pumps"} & model.abbreviations
    assert {"then", "the", "however", "it"} <= model.starters
    held = corpus(random.Random(2), 40)
    docs = spark.createDataFrame([(i, "  " + "\n".join(s) + " ") for i, s in enumerate(held)] + [(90, None), (91, "  "), (92, "no end")], "doc_id int, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {}
    for r in boundaries.sentences(docs, model).orderBy("doc_id", "sentence_no").collect():
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text
        found.setdefault(r.doc_id, []).append(r.text)
    assert [found[i] for i in range(40)] == held and found[92] == ["no end"] and 90 not in found and 91 not in found


def test_breaks():
    m = boundaries.Model(frozenset({"dr", "e.g", "etc"}), frozenset({("etc", "the")}), frozenset({"the", "then"}))
    cases = {("Dr.", "Smith"): False, ("etc.", "Then"): True, ("etc.", "The"): False, ("etc.", "then"): False, ("end.", "then"): True, ("5.", "Then"): True, ("5.", "June"): False, ("J.", "Brown"): False, ('so."', "Yes"): True, ("what?", "no"): True, ("(e.g.", "this"): False, ("word", "The"): False, ("end.", None): True}
    assert {k: boundaries.breaks_after(*k, m) for k in cases} == cases


def test_scores_against_plain_loops(spark):
    rng = random.Random(3)
    texts = [" ".join(w + rng.choice(["", "", ".", "!", ","]) for w in rng.choices(["ab", "e.g", "Word", "u.s.a", "7", "x", "(quoted", "longer"], k=40)) for _ in range(30)]
    pieces = [[re.sub(r"""^["'“‘(\[]+|["'”’)\],;:]+\Z""", "", t) for t in x.split()] for x in texts]
    total, with_period, plain = 0, Counter(), Counter()
    for t in (t for p in pieces for t in p):
        bare = re.sub(r"[.!?]+\Z", "", t).lower()
        word = "##number##" if re.fullmatch(r"[\d.,-]+", bare) else bare
        total += 1
        (with_period if t.endswith(".") else plain)[word] += 1
    periods = sum(with_period.values())

    def ratio(k, n, second, total):
        def rate(p, a, b):
            return a * math.log(max(p, 1e-12)) + (b - a) * math.log(max(1 - p, 1e-12))

        p, p1, p2 = second / total, k / n, (second - k) / (total - n)
        return 2 * (rate(p1, k, n) + rate(p2, second - k, total - n) - rate(p, k, n) - rate(p, second - k, total - n)) if p1 > p2 else 0.0

    want = {}
    for w, k in with_period.items():
        if w != "##number##":
            letters = len(w.replace(".", ""))
            want[w] = ratio(k, k + plain[w], periods, total) * math.exp(-letters) * (w.count(".") + 1) * float(letters) ** -plain[w]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.word: r.score for r in boundaries.abbreviation_scores(boundaries.counted(docs)).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[w], want[w], rel_tol=1e-9, abs_tol=1e-12) for w in want) and any(want.values())
    assert boundaries.learn(docs.filter(F.lit(False))) == boundaries.Model(frozenset(), frozenset(), frozenset())


def test_chunks_of_learned_sentences(spark, model):
    from quillstone.operators import chunking

    docs = spark.createDataFrame([(1, "Then Dr. Smith saw it. However it was fine. " * 30)], "doc_id bigint, text string")
    rows = chunking.sentence_spans(docs, 60, 0, model).collect()
    assert all(r.text.endswith(("it.", "fine.")) and len(r.text) <= 60 for r in rows) and any("Dr. Smith saw" in r.text for r in rows)


def test_query_takes_all_documents(spark):
    from test_oracles import SF

    import __spark_entry__ as entry

    rows = entry.queries()["k03_learned_sentences"](spark, str(SF)).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if (r.text or "").strip()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.sentence_no)):
        by.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    assert by.keys() == texts.keys() and all(not texts[d][: spans[0][0]].strip() and not texts[d][spans[-1][1] :].strip() for d, spans in by.items())
    assert all(not texts[d][b:c].strip() for d, spans in by.items() for (_, b), (c, _) in zip(spans, spans[1:]))


def test_counts_are_those_of_all_tokens_and_few_rows(spark, monkeypatch):
    texts = ["Dr. Who said (3.5) \"Stop!\" then 7. The end.", "", None, "- ... \"quoted.\" Next\tone two? Ünï X. x", "a b " * 50, "1. 2, A-1. Ça va. ½ Ⅷ. É"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words, nexts, ends = Counter(), Counter(), Counter()
    for t in texts:
        kept = []
        for raw in re.split(r"[ \t\n\x0b\f\r]+", t or ""):
            token = re.sub(r"""^["'“‘(\[]+|["'”’)\],;:]+\Z""", "", raw)
            if any(unicodedata.category(c)[0] in "LN" for c in token):
                bare = re.sub(r"[.!?]+\Z", "", token).lower()
                number = all(c in ".,-" or unicodedata.category(c)[0] == "N" for c in bare)
                kept.append(("##number##" if number else bare, token.endswith("."), token[-1] in "!?", unicodedata.category(token[0]) == "Lu"))
        words.update((w, p) for w, p, _, _ in kept)
        nexts.update(w for w, *_ in kept[1:])
        ends.update((a[0], a[1], a[2], b[0], b[3]) for a, b in zip(kept, kept[1:], strict=False) if a[1] or a[2])
    for size in (8_000_000, 40):
        monkeypatch.setattr(boundaries, "BYTES", size)
        rows = boundaries.counted(docs).collect()
        assert {(r.word, r.period): r.n for r in rows if r.kind == boundaries.WORD} == words
        assert {r.next: r.n for r in rows if r.kind == boundaries.NEXT} == nexts
        assert {(r.word, r.period, r.stop, r.next, r.capital): r.n for r in rows if r.kind == boundaries.END} == ends
        # plain tokens are not counted as pairs, of which there are as many as tokens
        assert len(rows) == len(words) + len(nexts) + len(ends)


def test_a_model_beyond_memory_keeps_all_its_words(spark, model):
    from quillstone.operators import chunking

    train = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(corpus(random.Random(1), 300))], "doc_id int, text string")
    sizes = [len(model.abbreviations), len(model.collocations), len(model.starters)]
    assert boundaries.learn(train, most=max(sizes)) == model and min(sizes[0], sizes[2]) > 1
    tables = boundaries.learn(train, most=1)
    words = lambda rows: sorted(rows if isinstance(rows, frozenset) else map(tuple, rows.collect()))
    assert words(tables.abbreviations) == sorted((w,) for w in model.abbreviations) and words(tables.starters) == sorted((w,) for w in model.starters) and words(tables.collocations) == sorted(model.collocations)
    held = [" ".join(s) for s in corpus(random.Random(4), 30)]
    docs = spark.createDataFrame([*enumerate(held), (3, held[3]), (3, held[4]), (None, held[5]), (91, None), (92, ""), (93, " no end")], "doc_id int, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(boundaries.sentences(docs, tables)) == rows(boundaries.sentences(docs, model))
    assert rows(chunking.sentence_spans(docs, 90, 1, tables)) == rows(chunking.sentence_spans(docs, 90, 1, model))


def test_tables_answer_all_that_a_model_does(spark):
    m = boundaries.Model(frozenset({"dr", "e.g", "etc"}), frozenset({("etc", "the"), ("##number##", "then"), ("x", "then")}), frozenset({"the", "then"}))
    of = lambda words, names: spark.createDataFrame([w if isinstance(w, tuple) else (w,) for w in words], names)
    tables = boundaries.Tables(of(m.abbreviations, "word string"), of(m.collocations, "word string, next string"), of(m.starters, "next string"))
    tokens = ["Dr.", "etc.", "(e.g.", "5.", "X.", "Q.", "end.", 'so."', "what?", "plain", "The", "the", "Then", "then", "Smith", '"The']
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(tokens, k=40))) for i in range(40)], "doc_id bigint, text string")
    rows = lambda model: sorted(map(repr, boundaries.sentences(docs, model).collect()))
    for part in (boundaries.Tables(m.abbreviations, tables.collocations, tables.starters), boundaries.Tables(m.abbreviations, m.collocations, tables.starters), boundaries.Tables(tables.abbreviations, m.collocations, m.starters)):
        assert rows(part) == rows(m)
    assert rows(tables) == rows(m) != rows(boundaries.Model(m.abbreviations, frozenset(), m.starters))
