"""Search and ground truth as passes over the chunks: the same rows as an index or brute force, without a shuffle of texts or postings."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluate, lexical_index, retrieval

ODD = ["", " ", "a", "Ünï-code x9 İstanbul Kelvin", "one two  two\none", "...", "é", "x" * 300, "the end a_b", "日本 z"]


def test_split_words_is_words(spark):
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "i int, text string").select("i", T.words(F.col("text")).alias("w"), T.plain(F.col("text")).alias("p")).orderBy("i").collect()
    texts = pa.array([r.p for r in rows])
    assert T.split_words(texts).to_pylist() == [r.w for r in rows]
    for a, n in ((3, 4), (7, 0), (9, 12)):
        assert T.split_words(texts.slice(a, n)).to_pylist() == [r.w for r in rows[a : a + n]]
    assert T.split_words(pa.array(["a\tb c", "d"]), T.NO_SPACE).to_pylist() == [["a\tb", "c"], ["d"]]


@pytest.fixture
def library(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab abc b c common common word w1 w2 rare".split()) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)


def test_bm25_of_a_table_is_that_of_its_index(spark, library, monkeypatch):
    asked = spark.createDataFrame([("q1", "common WORD rare rare"), ("q2", "b"), ("q3", ""), ("q4", "nowhere"), ("q5", "common common x9"), ("q5", "w1"), ("q6", None)], "query_id string, text string")
    index = lexical_index.build(library, shard=16)
    monkeypatch.setattr(lexical_index, "build", lambda *a, **k: pytest.fail("a table is not indexed for one search"))
    monkeypatch.setattr(lexical_index, "MOST_CELLS", 64 * 5)
    for n in (1, 7, 500):
        want = sorted(map(tuple, index.search(asked, n).collect()))
        assert want == sorted(map(tuple, retrieval.bm25_top(asked, library, n).collect())) == sorted(map(tuple, retrieval.bm25_top(asked, library, n, block_queries=2).collect()))
    assert retrieval.bm25_top(asked, library.limit(0)).count() == 0 == retrieval.bm25_top(asked.limit(0), library).count()


def test_ground_truth_looks_in_few_chunks(spark, library, monkeypatch):
    bodies = {r.chunk_id: re.sub(r"\s+", " ", r.text).strip() for r in library.collect()}
    whole = [b for b in bodies.values() if b.count(" ") > 6][:9]
    parts = [(i, 0, b[3:-2]) for i, b in enumerate(whole)] + [(90, 1, "one two   two one"), (91, 0, "not in any"), (92, 5, " ")]
    truth = lambda rows: {tuple(r) for r in evaluate.ground_truth(spark.createDataFrame(rows, "query_id int, snippet_id int, text string"), library).collect()}
    want = lambda rows: {(q, s, c) for q, s, t in rows if t.strip() for c, b in bodies.items() if re.sub(r"\s+", " ", t).strip() in b}
    short = [*parts, (93, 0, "rar"), (94, 0, "n w"), (95, 0, "z")]
    assert truth(short) == want(short)
    monkeypatch.setattr(evaluate, "_held", lambda *a: pytest.fail("no snippet is short, so no runs of letters are made"))
    monkeypatch.setattr(evaluate, "SNIPPETS", 3)
    assert truth(parts) == want(parts) and len(want(parts)) >= 10
    assert truth([(92, 5, " ")]) == set()
