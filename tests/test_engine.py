"""The answer life cycle on a small library."""

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import context


@pytest.fixture(scope="module")
def library(spark):
    body = " ".join(f"Fact {i} says that the pump of hall {i} runs at {80 + i} bar." for i in range(40))
    rows = [(1, "ann", "a.txt", body), (2, "ann", "b.txt", "The valve is made of steel. It opens slowly."), (3, "bob", "c.txt", "The valve is made of brass."), (4, "ann", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, user_id string, source string, text string")


def test_answers_hold_prompts_and_signals(spark, library):
    engine = Engine(spark, library, size=200, overlap=20, user_id="ann")
    asked = spark.createDataFrame([(1, "what is the valve made of"), (2, "at how many bar runs the pump of hall 7"), (3, "zzzz")], "query_id bigint, text string")
    replies = spark.createDataFrame([(1, "none"), (2, "")], "query_id bigint, reply string")
    out = engine.answer(asked, 3, replies=replies)
    sources = {(r.query_id, r.rank): r for r in out["sources"].collect()}
    assert {r.doc_id for r in sources.values()} <= {1, 2}  # no one else's
    prompts = {r.query_id: r for r in out["prompts"].collect()}
    assert set(prompts) == {1, 2, 3} and all(p.tokens <= context.INPUT_TOKENS for p in prompts.values())
    wide = {(r.query_id, r.rank): r.text for r in engine.widened(out["sources"]).collect()}
    assert set(wide) == set(sources) and all(sources[k].text in wide[k] for k in wide) and any(len(wide[k]) > len(sources[k].text) for k in wide)
    assert all(wide[k] in prompts[k[0]].prompt for k in wide)
    signals = {r.answer_id: r for r in out["signals"].collect()}
    assert set(signals) == {1, 2, 3} and signals[1].verified and signals[1].groundedness == 1.0 and not signals[2].verified and signals[2].groundedness == 0.0
    valid = {r.answer_id: r.n for r in out["citations"].filter("state = 'valid'").groupBy("answer_id").agg(F.count("*").alias("n")).collect()}
    assert all(signals[i].n_valid == valid.get(i, 0) for i in signals) and all(0 <= s.citation_coverage <= 1 for s in signals.values())


def test_another_user_sees_nothing(spark, library):
    engine = Engine(spark, library, user_id="eve")
    asked = spark.createDataFrame([(1, "what is the valve made of")], "query_id bigint, text string")
    assert engine.chunks.isEmpty() and "(no sources retrieved)" in engine.answer(asked)["prompts"].first().prompt
