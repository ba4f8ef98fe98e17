"""Queries take whole tables and whole texts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.operators import retrieval
from quillstone.plans import base

from test_oracles import SF

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def run(spark, name):
    return entry.queries()[name](spark, str(SF))


def test_scoped_search_takes_all_chunks_of_a_source(spark):
    found = run(spark, "r03_bm25_scoped").toPandas()
    docs = base.read(spark, str(SF), "documents").select("doc_id", "source")
    names = sorted({r["source"] or "" for r in docs.distinct().collect()})
    rows = base.chunks(spark, str(SF)).join(docs, "doc_id")
    asked = base.questions(spark, str(SF)).filter(F.col("query_id") % len(names) == 3)
    alone = retrieval.bm25_top(asked, rows.filter(F.col("source") == names[3]), 10).toPandas()
    of = found[found.query_id % len(names) == 3]
    assert len(of) and sorted(zip(of.query_id, of.chunk_id, of.bm25_rank)) == sorted(zip(alone.query_id, alone.chunk_id, alone.bm25_rank))


def test_sources_take_all_rows(spark):
    read = lambda t: base.read(spark, str(SF), t)
    values = {r["event_id"]: r["value"] for r in read("events").collect()}
    assert {r["event_id"]: r["distance"] for r in run(spark, "s13_distance").collect()} == {k: 1 - v for k, v in values.items()}
    assert {r["query_id"] for r in run(spark, "s11_fan_out").select("query_id").distinct().collect()} == {r["vec_id"] for r in read("embeddings").filter("vec_id % 50 = 0").collect()}
    known = {r["conv_id"] for r in read("conversations").select("conv_id").distinct().collect()}
    assert {r["conv_id"] for r in run(spark, "b04_blank_sessions").collect()} == set(range(max(known) + 1)) - known


def test_stream_takes_all_documents(spark):
    rows = base.chunks(spark, str(SF))
    want = rows.agg(F.count("*"), F.countDistinct("doc_id"), F.sum("token_count")).first()
    assert tuple(run(spark, "s10_ingest_stream").select("chunks", "documents", "tokens").first()) == tuple(want)


def test_answers_take_all_chunks_and_questions(spark):
    found = run(spark, "g01_expand").collect()
    assert sorted(r["key"] for r in found) == sorted(r["chunk_id"] for r in base.chunks(spark, str(SF)).collect())
    assert run(spark, "l01_agent_loop").count() == base.questions(spark, str(SF)).count() > 5


def test_truth_takes_whole_texts(spark):
    from quillstone.plans import queries_reports as reports

    texts = {r["query_id"]: r["text"] for r in base.questions(spark, str(SF)).collect()}
    parts: dict[int, list] = {}
    for r in reports._snippets(spark, str(SF)).orderBy("query_id", "snippet_id").collect():
        parts.setdefault(r["query_id"], []).append(r["text"])
    assert {q: "".join(p) for q, p in parts.items()} == texts and max(map(len, texts.values())) > 120 >= max(len(x) for p in parts.values() for x in p)
    found = run(spark, "v01_ground_truth").collect()
    bodies = {r["chunk_id"]: " ".join(r["text"].split()) for r in base.chunks(spark, str(SF)).collect()}
    want = {(q, i, c) for q, p in parts.items() for i, x in enumerate(p) for c, b in bodies.items() if " ".join(x.split()) in b}
    assert {tuple(r) for r in found} == want and any(i > 0 for _, i, _ in want)
    left = {(q, i) for q, p in parts.items() for i in range(len(p))} - {(q, i) for q, i, _ in want}
    assert {tuple(r) for r in run(spark, "v01_unmatched").collect()} == left
