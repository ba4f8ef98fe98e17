"""Inputs whose sizes don't fit a query's lists, and steps whose tasks must stay small."""

import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import text as T
from quillstone.functions import workspace
from quillstone.llm import nn_descent
from quillstone.operators import chunking, context, dense_index, embedding, index


@pytest.mark.parametrize("rows", [25 + 8, 25 + 5, 25 + 3])
def test_mmr_of_a_last_short_list(spark, tmp_path, rows):
    x = np.random.default_rng(rows).normal(size=(rows, 64)).astype("f4")
    pq.write_table(pa.table({"vec_id": pa.array(range(rows), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = [tuple(r) for r in entry.queries()["r10_mmr"](spark, str(tmp_path)).select("query_id", "rank", "chunk_id").collect()]
    assert sorted(found, key=repr) == sorted(con.sql(entry.oracle_sql()["r10_mmr"]).fetchall(), key=repr)


def test_offline_agent_searches_every_sub_question(spark, tmp_path):
    text = "red pump and blue valve and green filter and black motor; white tank"
    pq.write_table(pa.table({"item_id": pa.array([7], pa.int64()), "text": [text]}), tmp_path / "benchmark.parquet")
    docs = ["red pump here", "blue valve here", "green filter here", "black motor here", "white tank here", "nothing"]
    pq.write_table(pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": docs}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    found = entry.queries()["l06_offline_agent"](spark, str(tmp_path)).select("query_id", "step", "chunk_id", "rank", "seen").collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(entry.oracle_sql()["l06_offline_agent"]).fetchall()) and {r.step for r in found} == {1, 2, 3, 4, 5}


def test_dense_search_carries_no_vectors_between_tasks(spark):
    """Neither a vector for each pair of query and block is shuffled, nor may one file hold many blocks."""
    rng = np.random.default_rng(3)
    frame = lambda n, key: spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(rng.integers(0, 4, (n, 512)).astype(float).tolist())], f"{key} string, vector array<float>")
    index = dense_index.build(frame(600, "chunk_id"), cells=20)
    found = index.search(frame(30, "query_id"), 5, exact=True)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(f"{index.path}/cells/*").withColumn("file", F.input_file_name()).groupBy("file").count()
    assert found.count() == 150 and files.agg(F.max("count")).first()[0] <= dense_index.FILE_BYTES // (4 * 512 * dense_index.BLOCK)


def test_words_are_not_shuffled(spark):
    """Postings and hashed vectors shuffle texts, once; rows of one key are counted together."""
    rows = spark.createDataFrame([("a", "x y x"), ("a", "y z z"), ("b", ""), ("c", None), (None, "x")], "chunk_id string, text string").coalesce(1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    listed, vectors = index.postings(rows), embedding.sparse_vectors(rows, "chunk_id")
    assert plan(listed).count("Exchange") == 1 and plan(vectors).count("Exchange") == 1
    assert sorted(((r.chunk_id or "", r.term, r.tf, r.dl) for r in listed.collect())) == [("", "x", 1, 1), ("a", "x", 2, 3), ("a", "y", 2, 3), ("a", "z", 2, 3)]
    assert sorted((r.chunk_id or "", r.tf, r.norm2) for r in vectors.collect()) == [("", 1, 1), ("a", 2, 12), ("a", 2, 12), ("a", 2, 12)]


def test_few_texts_are_python_objects_at_a_time():
    """A batch of Spark's 10,000 rows is packed in parts, so what Python holds doesn't grow with the batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(["One. Two."] * 1000)], ["doc_id", "text"])
    parts = list(chunking._packed(chunking.pack_paragraphs)(iter([batch])))
    assert max(p.num_rows for p in parts) <= chunking.PACK_ROWS and sum(p.num_rows for p in parts) == 1000


def test_nfkc_of_long_columns(spark):
    rows = [(i, None if i % 7 == 0 else "plain" if i % 3 else "ﬁ①é") for i in range(1500)] + [(1500, "")]
    found = spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", T.nfkc(F.col("t")).alias("n"))
    assert "], 200" not in found._jdf.queryExecution().executedPlan().toString()  # 200: a UDF that makes Python objects of a whole batch
    assert {r.i: r.n for r in found.collect()} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in rows}


def test_search_frees_the_driver_after_each_step(spark, monkeypatch):
    """Broadcasts, shuffles and generated classes of finished steps are not kept until the driver's heap is full."""
    steps, freed, advanced = [], [], nn_descent._advanced
    monkeypatch.setattr(nn_descent, "_advanced", lambda *a: steps.append(1) or advanced(*a))
    x = np.random.default_rng(5).normal(size=(300, 8))
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    index = nn_descent.build(rows)
    monkeypatch.setattr(index.work, "release", lambda: freed.append(1))
    assert nn_descent.search(index, rows.filter("vec_id % 50 = 0"), 5).count() == 30
    assert len(freed) >= len(steps) - 1 > 0


def test_expanding_all_chunks_shuffles_texts_once(spark):
    """The texts move to number the chunks, and not again to meet their neighbours; no span differs from what the join of hits gives."""
    docs = spark.createDataFrame([(i, "abcdefghij" * (40 * i)) for i in range(1, 9)] + [(90, None), (91, ""), (92, " ")], "doc_id bigint, text string")
    rows = chunking.chunks(docs).withColumn("key", F.col("chunk_id"))
    assert context.expand_all(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rng = np.random.default_rng(5)
    odd = [(i % 7 or None, f"o{i}", int(rng.integers(0, 12)) if i % 5 else None, a := int(rng.integers(0, 90)), a + int(rng.integers(-1, 12)), f"text {i}") for i in range(80)]
    odd = spark.createDataFrame(odd, "doc_id bigint, chunk_id string, chunk_index int, char_start int, char_end int, text string").withColumn("key", F.col("chunk_id"))
    for chunks in (rows, odd):
        for window in (0, 1, 3):
            assert sorted(map(repr, context.expand_all(chunks, window).collect())) == sorted(map(repr, context.expand(chunks, chunks, window).collect()))


def test_expand_fixture_stores_no_table(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": [f"{i} word" * 300 for i in range(6)]}), tmp_path / "documents.parquet")
    monkeypatch.setattr(workspace, "new_folder", lambda *a: pytest.fail("a table is written"))
    plan = entry.queries()["g01_expand_fixture"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # one of the chunks, one of the odd spans
