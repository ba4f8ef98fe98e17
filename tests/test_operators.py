"""Operators on small inline tables and by their properties."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import agent, chunking, context, embedding, evaluate, index, lexical_index, library, retrieval, stats, understanding, verify
from quillstone.sources import store, uploads
from quillstone.streaming import cache, ingest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(42)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() + rnd.choice(["", "", ",", ".", "!"]) for _ in range(n))
    rows = [(i, text(rnd.randint(1, 400))) for i in range(30)] + [(90, ""), (91, None), (92, "   "), (93, "x" * 3000), (94, "Short. One. Two. Three. Four.")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").persist()


def test_clean(spark):
    c = lambda s, **k: one(spark, T.clean(F.lit(s), **k))
    assert c("a-\nb-\nc compre-\nhension") == "abc comprehension"
    assert c("x\x00y  \t z ") == "xy z" and c("ab\n\n\n\ncd") == "ab\n\ncd" and c("a Page 3 of 45 b") == "a b" and c("a\n 12 \nb") == "a\n\nb"
    assert c("ﬁle", normalise=True) == "file"


@pytest.mark.parametrize("strategy", ["fixed", "sentence", "paragraph"])
def test_chunks_keep_their_place(docs, strategy):
    rows = chunking.chunks(docs, strategy).join(docs.withColumnRenamed("text", "whole"), "doc_id").collect()
    assert rows and all(r.whole[r.char_start : r.char_end] == r.text and r.text.strip() for r in rows)
    assert {r.doc_id for r in rows}.isdisjoint({90, 91, 92})
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_sentence_packing_shrinks_at_the_end():
    spans = chunking.sentence_offsets("Short. One. Two. Three. Four.")
    assert chunking.pack(spans, 800, 2) == [(0, 29), (17, 29), (24, 29)]
    assert chunking.pack([(0, 900), (901, 910)], 800, 2) == [(0, 900), (901, 910)]


def test_paragraphs_break_before_long_ones():
    text = "a" * 100 + "\n\n" + ("Long sentence here. " * 80).strip() + "\n\n" + "b" * 50
    spans = chunking.pack_paragraphs(text)
    assert spans[0] == (0, 100) and spans[-1] == (len(text) - 50, len(text)) and all(b - a <= 1000 for a, b in spans)


def test_window_overlap_is_cut(spark):
    d = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    assert [r.text for r in chunking.fixed_spans(d, 3, 9).orderBy("char_start").collect()] == ["abc", "bcd", "cde", "def"]


def test_page_mapping(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, "b" * 30), (1, 3, "c" * 5)], "doc_id bigint, page_number int, text string")
    joined = chunking.join_pages(pages)
    row = joined.first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["a" * 30, "b" * 30, "c" * 5] and row.spans[-1].end == len(row.text)
    rows = chunking.assemble(chunking.fixed_spans(joined, 20, 0), "fixed", joined).orderBy("char_start").collect()
    assert [(r.page_number, r.spans_pages) for r in rows] == [(1, None), (1, [1, 2]), (2, None), (2, [2, 3])]


def test_vectors(spark, docs):
    rows = docs.filter("text is not null and trim(text) <> ''").select("doc_id", "text")
    norms = embedding.dense_vectors(rows, "doc_id").select(F.round(embedding.norm(F.col("embedding")), 4).alias("n")).distinct().collect()
    assert [r.n for r in norms] == [1.0]
    assert one(spark, embedding.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, T.hash_bucket(F.lit("alpha"))) == 44
    broken = embedding.embed_with(rows, "doc_id", lambda texts: 1 / 0).select("embedding").distinct().collect()
    assert [r.embedding for r in broken] == [None]


def test_bm25_floor_and_repeats(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "x z"), ("c", "x x w"), ("d", "q")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "x"), (2, "z"), (3, "z z"), (4, ""), (5, "none")], "query_id int, text string")
    rows = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25_top(asked, chunks).collect()}
    assert set(q for q, _ in rows) == {1, 2, 3} and rows[3, "b"] == pytest.approx(2 * rows[2, "b"], abs=2e-6)
    idf = {t: np.log(4 - n + 0.5) - np.log(n + 0.5) for t, n in {"x": 3, "y": 1, "z": 1, "w": 1, "q": 1}.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    assert rows[1, "a"] == pytest.approx(floor * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)), abs=1e-6)


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, dense_rank int")
    words = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, bm25_rank int")
    rows = retrieval.rrf_fuse(dense, words).orderBy("place").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"] and rows[0].fused_score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.chunk_id for r in retrieval.rrf_fuse(dense, words.limit(0)).orderBy("place").collect()] == ["a", "b"]


def test_mmr(spark):
    same = [1.0, 0.0]
    rows = [(1, c, i + 1, r, v) for i, (c, r, v) in enumerate([("a", 1.0, same), ("b", 0.9, same), ("c", 0.5, [0.0, 1.0]), ("d", 0.1, [0.6, 0.8])])]
    table = spark.createDataFrame(rows, "query_id int, chunk_id string, place int, relevance double, embedding array<double>")
    order = lambda **k: [r.chunk_id for r in retrieval.mmr(table, **k).orderBy("rank").collect()]
    assert order(k=2, weight=0.5) == ["a", "c"] and order(k=2) == ["a", "b"] and order(k=2, weight=1.0) == ["a", "b"] and order(k=9) == ["a", "b", "c", "d"] and order(k=2, weight=0.0) == ["a", "c"]


def test_reconcile(spark):
    kind = "chunk_id string, content_hash string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], kind), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], kind)
    assert {r.chunk_id: r.action for r in index.reconcile(old, new).collect()} == {"a": "delete", "b": "unchanged", "c": "upsert", "d": "upsert"}
    assert {r.action for r in index.reconcile(old, old).collect()} == {"unchanged"} and {r.action for r in index.reconcile(old.limit(0), new).collect()} == {"upsert"}


def test_filters_never_pass_silently(docs):
    with pytest.raises(ValueError):
        index.where_equal(docs, {"doc_id": [1, 2]})
    with pytest.raises(ValueError):
        index.delete(docs, where={"doc_id": {"$gt": 1}})


def test_understanding(spark):
    kind = lambda q: one(spark, understanding.query_type(F.lit(q)))
    assert [kind(q) for q in ("What is the difference between a and b", "what is x", "Chapter 3", "how fast", "", None)] == ["analytical", "definitional", "navigational", "informational", "informational", "informational"]
    assert one(spark, understanding.answer_task(F.lit("list all in one sentence"))) == "enumerate"
    assert one(spark, understanding.sub_questions(F.lit("pump load and pump load; valve"))) == ["pump load", "valve"]
    assert one(spark, understanding.broadened(F.lit("what is the GX-4200 pump"))) == "pump" and one(spark, understanding.broadened(F.lit("what is the"))) == "what is the"


def test_budget_keeps_the_first():
    texts = ["a" * 4000, "b" * 4000, "c" * 400]
    out = context.fit_budget(texts, 1500)
    assert out[0] == texts[0] and len(out[2]) < 400 and context.CUT in out[1] and context.fit_budget(texts, 9999) == texts


def test_verification(spark):
    assert one(spark, verify.cited(F.lit("x [1][2, 5] [9-7] [0] [a]"))) == [1, 2, 5, 7, 8, 9]
    assert one(spark, verify.verdict(F.lit("It holds 45°C [1]"), F.lit("rated 145°C"))) == "supported"  # substrings count
    assert one(spark, verify.verdict(F.lit("It holds 85°C [1]"), F.lit("rated 45°C"))) == "unverified"
    assert one(spark, verify.parse_judge(F.lit("not supported"))) == "not_mentioned"
    g = one(spark, verify.groundedness(F.lit(""), F.lit("a. b.")))
    assert not g.grounded and not g.verified and g.confidence == 0


def test_metrics_grow_with_k(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcdef", 1)], "query_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "c"), (1, "e"), (2, "z")], "query_id int, chunk_id string")
    rows = [{r.query_id: r for r in evaluate.retrieval_metrics(q, hits, truth, k).collect()} for k in (1, 3, 5)]
    assert [r[1].recall_at_k for r in rows] == [0.0, 1.0, 1.0] and rows[2][1].precision_at_k == 0.4 and rows[2][1].first_rank == 3 and rows[2][2].first_rank is None
    c = {r.query_id: r for r in evaluate.context_metrics(q, hits.filter("rank <= 5"), truth).collect()}
    assert c[1].context_precision == pytest.approx((1 / 3 + 2 / 5) / 2, abs=1e-4) and c[1].context_recall == 1.0 and c[2].context_recall == 0


def test_ground_truth_equals_all_pairs(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["ab", "cd", "ef", "gh", "abcd"]) for _ in range(40)) for _ in range(30)]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    snips = [(i, i, (t := rnd.choice(texts))[(a := rnd.randrange(60)) : a + rnd.randrange(1, 30)]) for i in range(60)]
    snips = [s for s in snips if s[2].strip()]
    found = evaluate.ground_truth(spark.createDataFrame(snips, "query_id int, snippet_id int, text string"), chunks)
    want = {(i, str(j)) for i, _, s in snips for j, t in enumerate(texts) if " ".join(s.split()) in " ".join(t.split())}
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == want


def test_agent_loop(spark):
    replies = {
        "a": ['{"tool": "retrieve_docs", "args": {"query": "x"}}', '{"tool": "retrieve_docs", "args": {"query": "x"}}'], "b": ["nonsense"], "c": ['{"tool": "nope"}', '{"tool": "fetch_document", "args": {}}', '{"tool": "finish"}'],
        "d": ['{"tool": "retrieve_docs", "args": {"query": "x"}}', '{"tool": "retrieve_docs", "args": {"query": "y"}}'], "e": [None], "f": ['{"tool": "retrieve_docs", "args": {"query": "none"}}'] + [f'{{"tool": "retrieve_docs", "args": {{"query": "none", "k": {i}}}}}' for i in range(9)],
        "g": ['{"tool": "nope"}', '{"tool": "nope"}', "nonsense", "nonsense", '{"tool": "finish"}'],
    }

    def planner(q, history):
        return replies[q][len(history)].strip()

    def retrieve(calls):
        return calls.filter("arguments['query'] <> 'none'").selectExpr("query_id", "explode(array('c1', 'c2', 'c1')) AS item").selectExpr("query_id", "item", "1 AS rank")

    out = agent.run_loop(spark.createDataFrame([(q, q) for q in replies], "query_id string, text string"), planner, {"retrieve_docs": retrieve, "fetch_document": lambda calls: None})
    state = {r.query_id: (r.stop, r.steps, r.chunks) for r in out["outcome"].collect()}
    assert state == {"a": ("repeated", 1, 2), "b": ("unreadable", 1, 0), "c": ("finish", 2, 0), "d": ("no_progress", 2, 2), "e": ("planner_failed", 0, 0), "f": (None, 5, 0), "g": ("finish", 4, 0)}
    assert [r.status for r in out["history"].filter("query_id = 'c'").orderBy("step").collect()] == ["unknown_tool", "missing_argument"]
    assert sorted(map(tuple, out["collected"].collect())) == [(q, c, 1, 1) for q in "ad" for c in ("c1", "c2")]
    nothing = agent.run_loop(spark.createDataFrame([], "query_id string, text string"), planner, {"retrieve_docs": retrieve})
    assert nothing["outcome"].count() == nothing["history"].count() == 0
    assert agent.parse_action('x {"action": "go", "k": "}"} y') == {"tool": "go", "args": {"k": "}"}} and agent.parse_action("{") is None


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>p{i}</w:t></w:r></w:p><w:p/>" for i in range(41)) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    pages = uploads.docx_pages(out.getvalue())
    assert len(pages) == 3 and pages[0].count("\n\n") == 39 and pages[1:] == ["p40", "a | b"]


def test_collection_versions(spark, tmp_path):
    c = store.Collection(spark, tmp_path.as_uri() + "/c", "chunk_id string, v int")
    assert c.count() == 0
    c.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int"))
    c.upsert(spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "chunk_id string, v int"))
    c.delete(where={"chunk_id": "a"})
    assert sorted(map(tuple, c.table().collect())) == [("b", 3), ("c", 1)] and c.get(["c"]).count() == 1 and len(c.log.versions()) == 3
    c.drop()
    assert c.log.versions() == []


def test_ingest_is_idempotent(spark, tmp_path):
    sink, root = ingest.Ingest(spark, tmp_path.as_uri() + "/i"), tmp_path.as_uri()
    rows = lambda *r: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in r], "doc_id long, text string, lang string, source string, n_chars long")
    rows((1, "alpha beta " * 80), (2, "gamma")).write.parquet(f"{root}/in/1")
    run = lambda: sink.stream(ingest.read_documents(spark, f"{root}/in/*"), f"{root}/cp").awaitTermination()
    run()
    first = sorted(map(tuple, sink.chunks.table().collect()))
    run()
    sink.batch(spark.read.parquet(f"{root}/in/1"))  # a replayed batch
    assert sorted(map(tuple, sink.chunks.table().collect())) == first and len(sink.chunks.log.versions()) == 1
    rows((1, "alpha")).write.parquet(f"{root}/in/2")
    run()
    assert {r.doc_id: r.text for r in sink.chunks.table().collect()} == {1: "alpha", 2: "gamma"}
    sink.batch(rows((2, "beta"), (2, ""), (2, "delta"), (2, "delta")))  # several texts of one id
    assert {r.doc_id: r.text for r in sink.chunks.table().collect()} == {1: "alpha", 2: "delta"}
    assert {r.chunk_id for r in sink.vectors.table().collect()} == {r.chunk_id for r in sink.chunks.table().collect()} == {r.chunk_id for r in sink.lexical.postings().collect()}


def test_cache_stream(spark, tmp_path):
    spark.sql("SELECT 'k' AS key, timestamp_seconds(1700000000 + id * 2000) AS ts FROM range(4)").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = cache.cached_stream(source).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.hit for r in spark.table("hits").orderBy("ts").collect()] == [False, True, False, True]


def test_library(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert [(r.i, r.total, r.total_pages) for r in library.page(rows, [F.col("i")], 2, 2).collect()] == [(2, 5, 3), (3, 5, 3)]
    assert one(spark, library.next_action(F.lit("chunking"), F.lit(3))) == "embed"
    assert stats.labels() == ["0-200", "200-400", "400-600", "600-800", "800+"]


def test_queries_in_several_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", f"word{i % 7} alpha beta{i % 3} gamma{i % 11}") for i in range(60)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, f"word{i % 7} beta{i % 3} delta{i}") for i in range(23)] + [(99, "nothing"), (100, "")], "query_id int, text string")
    def dense(n):
        return retrieval.dense_top(queries, chunks, 8, block_queries=n)

    def lexical(n):
        monkeypatch.setattr(lexical_index, "QUERIES", n)
        return retrieval.bm25_top(queries, chunks, 8)

    for leg in (dense, lexical):
        found = [sorted(map(tuple, leg(n).collect())) for n in (4096, 4, 1)]
        assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_prompts_keep_to_the_input_budget(spark):
    long = "w" * 6000
    rows = [(1, 1, "s", 1, long), (1, 2, "s", 2, long), (1, 3, "", None, "x" * 2000), (2, 1, "s", 1, "short"), (2, 2, None, 3, None)]
    sources = spark.createDataFrame(rows, "query_id int, rank int, source string, page_number int, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id int, text string").selectExpr("*", "'informational' AS kind", "'answer' AS task", "false AS thin")
    capped, free = ({r.query_id: r for r in context.prompts(sources, asked, most).collect()} for most in (3000, 0))
    assert free[1].tokens > 3500 and capped[1].tokens <= 3010 and long in capped[1].prompt
    overhead = (len(free[1].prompt) - 14000) // 4
    texts = context.fit_budget([long, long, "x" * 2000], 3000 - overhead)
    assert all(f"\n{t}\n\n" in capped[1].prompt for t in texts) and "[3] (unknown, p.0)" in capped[1].prompt
    assert capped[2] == free[2] and "[2] (unknown, p.3)" in free[2].prompt and "(no sources retrieved)" in capped[3].prompt
    narrow = {r.query_id: r for r in context.prompts(sources, asked, 0, 2000).collect()}
    assert all(f"\n{t}\n\n" in narrow[1].prompt for t in context.fit_budget([long, long, "x" * 2000], 2000)) and narrow[2] == free[2]


def test_chunk_options(docs):
    small, own = chunking.chunks(docs, "fixed", 100, 10), chunking.chunks(docs, "fixed")
    assert small.selectExpr("max(length(text))").first()[0] <= 100 and own.exceptAll(chunking.chunks(docs, "fixed", 500, 50)).isEmpty()
    for bad in (("other",), ("fixed", 0), ("sentence", 10, -1)):
        with pytest.raises(ValueError):
            chunking.chunks(docs, *bad)


def test_short_snippets_are_found_by_runs(spark):
    texts = ["a bc def", "abc", "é x", "", None, "xyz  def", "zz"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    snips = ["a", "bc", "c d", "def", "é x", "z d", "nope", "", "yz def", "a bc def", "zz zz"]
    found = evaluate.ground_truth(spark.createDataFrame(list(enumerate(snips)), "query_id int, text string").selectExpr("query_id", "query_id AS snippet_id", "text"), chunks)
    want = {(i, str(j)) for i, s in enumerate(snips) for j, t in enumerate(texts) if s and t and s in " ".join(t.split())}
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
