"""What is kept on disk: the log of versions, bucketed collections, the word index, embedding jobs, and an engine over an ingested library."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import dense_index, lexical_index, retrieval, verify
from quillstone.operators.lexical_index import LexicalIndex
from quillstone.sources.log import Conflict, Log
from quillstone.sources.store import Collection
from quillstone.streaming.embed_job import EmbeddingJob
from quillstone.streaming.ingest import Ingest

ROW = "chunk_id string, v int"


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), ROW)


def test_log(spark, tmp_path):
    a, b = (Log(spark, tmp_path.as_uri() + "/log") for _ in range(2))
    assert a.latest() == (-1, {})
    a.commit(0, {"x": "é"})
    with pytest.raises(Conflict):
        b.commit(0, {"x": 2})
    b.commit(1, {"x": 3})
    assert a.latest() == (1, {"x": 3}) and a.read(0) == {"x": "é"} and a.versions() == [0, 1]
    (tmp_path / "log" / f"{2:012d}.lock").touch()  # a writer that died
    with pytest.raises(Conflict):
        a.commit(2, {})
    a.break_lock(2)
    a.commit(2, {"x": 4})
    assert b.latest() == (2, {"x": 4})


def test_changes_touch_their_buckets_only(spark, tmp_path):
    c = Collection(spark, tmp_path.as_uri(), ROW, buckets=64)
    c.upsert(rows(spark, ((f"k{i}", i) for i in range(2000))))
    before = c.snapshot()["folders"]
    part = rows(spark, ((f"k{i}", -i) for i in range(20)))  # 1 %
    c.upsert(part)
    after, touched = c.snapshot()["folders"], c.buckets_of(part)
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched} and len(touched) <= 20
    want = {f"k{i}": -i if i < 20 else i for i in range(2000)}
    assert {r.chunk_id: r.v for r in c.table().collect()} == want
    assert {r.chunk_id: r.v for r in c.table(0).collect()} == {f"k{i}": i for i in range(2000)}  # the first version is still there
    c.delete(where={"v": 1999})
    assert len(c.snapshot()["touched"]) == 1 and c.count() == 1999 and c.get(["k5", "none"]).collect()[0].v == -5
    c.delete(rows(spark, [(f"k{i}", 0) for i in range(1000)]))
    assert {r.chunk_id for r in c.table().collect()} == {f"k{i}" for i in range(1000, 1999)}
    assert c.expire(1) == [0, 1, 2] and c.count() == 999 and c.log.versions() == [3]
    kept = {f.split("/")[1] for f in c.snapshot()["folders"].values()}
    assert {p.name for p in (tmp_path / "data").iterdir()} == kept


def test_new_rows_are_put_beside_and_merged_by_levels(spark, tmp_path):
    c = Collection(spark, tmp_path.as_uri(), ROW, buckets=4)
    put = lambda pairs, at: c.add(c.stage(rows(spark, pairs), at)[0], at["version"])
    written = []
    for n in range(8):
        put([(f"k{n}-{i}", i) for i in range(40)], c.snapshot())
        written.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        c.merge(fan=100)
    assert written[7] < 9 * written[0]  # eight batches of one size: no row was written twice
    want = sorted((f"k{n}-{i}", i) for n in range(8) for i in range(40))
    found = lambda: sorted(map(tuple, c.table().collect()))
    assert found() == want and {len(p) for p in c.snapshot()["parts"].values()} == {8}
    c.merge(fan=2)  # a merge takes all parts of a level
    assert found() == want and {tuple(at for _, at in p) for p in c.snapshot()["parts"].values()} == {(1,)}
    old = c.snapshot()
    c.upsert(rows(spark, [("k0-0", 7)]))  # rewrites its bucket with its parts
    put([("k0-0", 8), ("new", 1)], old)  # compared with a version that others have changed since: no key comes twice
    want = sorted([w for w in want if w[0] != "k0-0"] + [("k0-0", 8), ("new", 1)])
    assert found() == want and c.expire(1) and found() == want


def test_ingesting_new_documents_rewrites_nothing(spark, tmp_path):
    sink = Ingest(spark, tmp_path.as_uri(), buckets=2)
    batch = lambda ids: spark.createDataFrame([(i, f"text of document {i} " * 40) for i in ids], "doc_id long, text string")
    sink.batch(batch(range(20)), 0, "s")
    kept = [{p: p.stat().st_mtime_ns for p in (tmp_path / c / "data").rglob("*.parquet")} for c in ("chunks", "vectors")]
    rows_of = lambda c: set(c.table(0).inputFiles())
    first = [rows_of(c) for c in (sink.chunks, sink.vectors)]
    sink.batch(batch(range(20, 40)), 1, "s")
    for c, files, times in zip((sink.chunks, sink.vectors), first, kept, strict=True):
        assert files <= set(c.table().inputFiles()) and c.count() == 2 * len(c.table(0).collect())
        assert all(p.stat().st_mtime_ns == t for p, t in times.items())
    sink.batch(batch([5]).withColumn("text", F.lit("changed")), 2, "s")  # a known document: its chunks are replaced
    assert [r.text for r in sink.chunks.table().filter("doc_id = 5").collect()] == ["changed"]
    assert sink.vectors.table().filter("doc_id = 5").count() == 1 and sink.chunks.table().select("doc_id").distinct().count() == 40


def test_replayed_batches_and_other_writers(spark, tmp_path):
    a, b = (Collection(spark, tmp_path.as_uri(), ROW, buckets=8) for _ in range(2))
    assert a.upsert(rows(spark, [("x", 1)]), ("s", 0)) and not b.upsert(rows(spark, [("x", 9)]), ("s", 0))
    assert a.upsert(rows(spark, [("x", 2)]), ("t", 0)) and a.table().collect()[0].v == 2

    def race(mine, theirs):
        """The other writer commits between this writer's reading and its commit."""
        real, left = a.log.commit, [theirs]

        def late(version, entry):
            if left:
                b.upsert(rows(spark, left.pop()))
            real(version, entry)

        a.log.commit = late
        try:
            a.upsert(rows(spark, mine))
        finally:
            a.log.commit = real

    ids = [f"k{i}" for i in range(50)]
    bucket = {r.chunk_id: r.b for r in rows(spark, [(i, 0) for i in ids]).select("chunk_id", a.bucket(8).alias("b")).collect()}
    one = ids[0]
    same, other = next(i for i in ids[1:] if bucket[i] == bucket[one]), next(i for i in ids if bucket[i] != bucket[one])
    race([(one, 1)], [(other, 2)])
    assert {r.chunk_id: r.v for r in a.table().collect()} == {"x": 2, one: 1, other: 2}
    race([(one, 3)], [(same, 4)])  # the same bucket: computed anew on the other's version
    assert {r.chunk_id: r.v for r in b.table().collect()} == {"x": 2, one: 3, other: 2, same: 4}


def words(rng, n, of=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), of)}" for _ in range(n))


def found(frame):
    return sorted((r.query_id, r.bm25_rank, r.chunk_id, r.score) for r in frame.collect())


def bm25(chunks, queries, n):
    """By plain loops: chunks {(scope, id): text}, queries (id, scope, text)."""
    import decimal
    import math

    out = []
    for q, scope, text in queries:
        mine = {i: re.findall("[a-z0-9]+", (t or "").lower()) for (s, i), t in chunks.items() if s == scope}
        df = {}
        for ws in mine.values():
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        idf = {w: math.log(len(mine) - n_ + 0.5) - math.log(n_ + 0.5) for w, n_ in df.items()}
        floor = sum(idf.values()) / len(idf) * 0.25 if idf else 0
        avg = sum(map(len, mine.values())) / max(len(mine), 1)
        scores = {}
        for i, ws in mine.items():
            asked = [w for w in re.findall("[a-z0-9]+", text.lower()) if w in ws]
            if asked:
                parts = [(asked.count(w) * (idf[w] if idf[w] >= 0 else floor) * (f := ws.count(w)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / avg))) for w in set(asked)]
                scores[i] = round(float(sum(decimal.Decimal(p).quantize(decimal.Decimal("1e-10")) for p in parts)), 6)
        out += [(q, k + 1, i, scores[i]) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:n])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1024, 16])
def test_word_index_by_segments(spark, tmp_path, shard):
    rng = random.Random(shard)
    scope = F.col("s")
    frame = lambda d: spark.createDataFrame([(s, i, t) for (s, i), t in d.items()], "s string, chunk_id string, text string")
    index, held = LexicalIndex(spark, tmp_path.as_uri(), shard), {}
    queries = [(k, rng.choice(["a", "b", "c"]), words(rng, rng.choice([1, 2, 6, 30]))) for k in range(25)] + [(99, "a", "nothing"), (98, "zz", "w1"), (97, "a", "")]
    asked = spark.createDataFrame(queries, "query_id int, scope string, text string")
    assert found(index.search(asked, 7, scoped=True)) == []
    for step in range(3):
        new = {(rng.choice("aabc"), f"c{step}-{i}"): rng.choice([words(rng, rng.randrange(1, 40)), words(rng, 5), "", None]) for i in range(60)}
        old = dict(rng.sample(sorted(held.items(), key=str), min(len(held), 25)))
        changed = {k: words(rng, 12) for k in list(old)[:8]}  # removed and added under the same id
        assert index.apply(frame(new | changed), frame(old) if old else None, scope, ("s", step))
        assert not index.apply(frame(new), None, scope, ("s", step))  # replayed
        held = {k: v for k, v in held.items() if k not in old} | new | changed
        if step == 1:
            index.compact()
            index.expire()
            assert len(index.segments()) == 1
        want = bm25(held, queries, 7)
        assert found(index.search(asked, 7, scoped=True)) == want == found(index.search(asked, 7, scoped=True, prune=False))
        assert {(r.scope, r.term): r.df for r in index.frequencies().collect()} == {k: n for k, n in _frequencies(held).items()}
    assert found(retrieval.bm25_top(asked, frame(held), 7, scope)) == want


def _frequencies(held):
    out = {}
    for (s, _), t in held.items():
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())):
            out[s, w] = out.get((s, w), 0) + 1
    return out


def test_bounds_leave_shards_out(spark, monkeypatch):
    rng = random.Random(1)
    # topics lie together, as chunks of a document do
    texts = [(f"c{i:04d}", " ".join(rng.choices([f"t{i // 64}x{j}" for j in range(30)], k=20)) + " " + words(rng, 10)) for i in range(1024)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").coalesce(1)
    asked = spark.createDataFrame([(k, f"t{k}x1 t{k}x2 t{k}x3 w3 w5") for k in range(16)], "query_id int, text string")
    index, scored = lexical_index.build(chunks, shard=32), []
    real = LexicalIndex._score
    monkeypatch.setattr(LexicalIndex, "_score", lambda self, pairs, *a: (scored.append(pairs.count()), real(self, pairs, *a))[1])
    pruned = found(index.search(asked, 10))
    few, scored[:] = sum(scored), []
    assert pruned == found(index.search(asked, 10, prune=False)) and few <= sum(scored) / 3


def test_embedding_job_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Killed(BaseException):
        """Not caught by what catches a model's errors."""

    chunks = spark.createDataFrame([(d, i, f"{d}-{i}", f"text {d} {i}") for d, n in [(1, 75), (2, 5), (3, 1), (4, 33)] for i in range(n)] + [(None, 0, "x", "x")], "doc_id bigint, chunk_index int, chunk_id string, text string")

    def model(texts, dies=None, fails=()):
        if dies in texts:
            raise Killed
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return [None if t in fails else [float(len(t)), 1.0] for t in texts]

    def called():
        out = [p.read_text().split("\n") for p in calls.iterdir()]
        for p in calls.iterdir():
            p.unlink()
        return out

    make = lambda: EmbeddingJob(spark, tmp_path.as_uri() + "/job", batch=8, wave=2, slices=2)
    with pytest.raises(Exception):
        make().run(chunks, lambda t: model(t, dies="text 1 40", fails=("text 4 3", "text 3 0")))
    first = called()
    named = make()._tried().collect()
    assert 0 < len(named) < 114
    progress = {r.doc_id: r for r in make().progress(chunks).collect()}
    assert progress[1].status == "in_progress" and progress[1].checkpoint in (1, 3) and progress[1].completed == 8 * (progress[1].checkpoint + 1)
    bad = ("text 4 3", "text 3 0")
    assert make().run(chunks, lambda t: model(t, fails=bad)) > 0
    again = called()
    done = {r.chunk_id for r in named}
    assert not done & {t[5:].replace(" ", "-") for b in again for t in b}  # nothing that the ledger names
    assert all(len(b) <= 8 for b in first + again) and make().run(chunks, model) == 0 and called() == []
    assert {(r.doc_id, r.total, r.failed, r.checkpoint, r.status) for r in make().progress(chunks).collect()} == {(1, 75, 0, 9, "completed"), (2, 5, 0, 0, "completed"), (3, 1, 1, 0, "failed"), (4, 33, 1, 4, "completed_with_failures")}
    make().retry(chunks, lambda t: model(t, fails=bad[1:]))
    assert sorted(x for b in called() for x in b) == ["text 3 0", "text 4 3"] and {r.chunk_id for r in make().failed().collect()} == {"3-0"}
    make().retry(chunks, model)
    assert {r.chunk_id: r.embedding for r in make().vectors().collect()} == {r.chunk_id: [float(len(r.text)), 1.0] for r in chunks.collect() if r.doc_id}
    assert {r.status for r in make().progress(chunks).collect()} == {"completed"}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("library").as_uri()
    sink = Ingest(spark, path)
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string, source string")
    body = " ".join(f"Fact {i} says that the pump of hall {i} runs at {80 + i} bar." for i in range(60))
    sink.batch(docs((1, body, "a.txt"), (2, "The valve is made of steel. It opens slowly.", "b.txt"), (3, "The seal is made of rubber.", "c.txt")), 0, "s")
    sink.batch(docs((3, "The seal is made of cork now.", "c.txt"), (4, "A gasket holds the flange.", None)), 1, "s")
    sink.batch(docs((2, "", "b.txt")), 2, "s")
    return path


def test_engine_reads_what_ingestion_wrote(spark, library):
    engine = Engine.open(spark, library)
    asked = spark.createDataFrame([(1, "what is the seal made of"), (2, "valve of steel"), (3, "the pump of hall 7")], "query_id bigint, text string")
    assert len(engine.lexical.segments()) == 3
    hits = engine.search(asked, 5).collect()
    assert {r.text for r in hits if r.query_id == 1 and r["rank"] == 1} == {"The seal is made of cork now."} and not any("steel" in r.text or "rubber" in r.text for r in hits)
    plain = retrieval.bm25_top(asked, engine.chunks, 5)
    assert found(retrieval.bm25_top(asked, engine.lexical, 5)) == found(plain)


def test_answers_by_route(spark, library):
    engine = Engine.open(spark, library)
    asked = spark.createDataFrame([(1, "summarize the whole document", 1), (2, "what is cork", 1), (3, "what is the gasket GX-77", 4), (4, "what is the seal", None), (5, "summarize the whole document", 77)], "query_id bigint, text string, doc_id bigint")
    out = engine.retrieve(asked, 4).collect()
    legs = {}
    for r in out:
        legs.setdefault(r.query_id, []).append((r["rank"], r.leg, r.doc_id, r.chunk_index))
    n = engine.chunks.filter("doc_id = 1").count()
    assert sorted(legs[1]) == [(i + 1, "whole", 1, i) for i in range(n)]
    assert {d for _, _, d, _ in legs.get(2, [])} <= {1} and {d for _, _, d, _ in legs[3]} == {4}  # a document's own chunks only
    assert legs[4][0][2] == 3 and 5 not in legs and len({(r.query_id, r.chunk_id) for r in out}) == len(out)
    assert all(sorted(x[0] for x in v) == list(range(1, len(v) + 1)) for v in legs.values())
    answers = engine.answer(asked, 4)
    assert {r.answer_id for r in answers["signals"].collect()} == {1, 2, 3, 4, 5} and {r.query_id for r in answers["prompts"].collect()} == {1, 2, 3, 4, 5}


def test_thin_results_are_searched_again(spark):
    docs = spark.createDataFrame([(1, "torque of GX-4200", "a"), (2, "gears and torque", "b"), (3, "torque wrench", "c")], "doc_id bigint, text string, source string")
    engine = Engine(spark, docs)
    asked = spark.createDataFrame([(1, "what is GX-4200 wrench")], "query_id bigint, text string")
    out = engine.retrieve(asked, 4, thin=3).orderBy("rank").collect()
    assert [r.leg for r in out][: 1] == ["local"] and len({r.chunk_id for r in out}) == len(out)
    assert engine.retrieve(asked, 4, thin=0).collect() == [r for r in out if r.leg == "local"]


def test_rewrites_and_diversity(spark, library):
    engine = Engine.open(spark, library)
    asked = spark.createDataFrame([(1, "???"), (2, "the pump of hall 7")], "query_id bigint, text string")
    other = spark.createDataFrame([(1, "cork seal"), (1, "gasket")], "query_id bigint, text string")
    assert {r.query_id for r in engine.search(asked, 4).collect()} == {2}
    hits = engine.search(asked, 4, rewrites=other).collect()
    assert {r.doc_id for r in hits if r.query_id == 1} >= {3, 4}
    spread, close = ([r.chunk_id for r in engine.search(asked, 3, diverse=w).filter("query_id = 2").orderBy("rank").collect()] for w in (0.3, 1.0))
    assert len(spread) == len(close) == 3 and spread[0] == close[0] == engine.search(asked, 3).filter("query_id = 2 AND rank = 1").first().chunk_id


def test_copied_sentences_against_plain_loops(spark):
    rng = random.Random(4)
    sources = [(a, r, " ".join(rng.choices(["x", "y", "z"], k=rng.choice([4, 30, 80])))) for a in range(30) for r in (1, 2)]

    def said(a):
        out = []
        for _ in range(5):
            words = rng.choice(sources)[2].split() if rng.random() < 0.5 else sources[2 * a][2].split()
            at, n = rng.randrange(len(words)), rng.choice([4, 6, 7, 10, 15, 25])
            part = words[at : at + n]
            for _ in range(rng.choice([0, 0, 1, 2])):
                part.insert(rng.randrange(len(part) + 1), rng.choice(["x", "q"]))
            out.append(" ".join(part) + ".")
        return " ".join(out)

    answers = [(a, said(a)) for a in range(30)] + [(50, None), (51, "")]

    def flagged(sentence, texts):
        w, best = sentence, 0
        for t in texts:
            for i in range(len(w)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(w) and j + k < len(t) and w[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
        return best / len(w) > 0.8

    want = {}
    for a, text in answers:
        parts = [re.findall(r"\w+", s) for s in re.split(r"(?<=[.!?])\s+", text or "")]
        parts = [p for p in parts if len(p) >= 6]
        want[a] = (len(parts), sum(flagged(p, [t.split() for b, _, t in sources if b == a]) for p in parts))
    out = verify.verbatim(spark.createDataFrame(answers, "answer_id int, answer string"), spark.createDataFrame(sources, "answer_id int, rank int, text string"))
    assert {r.answer_id: (r.total, r.flagged) for r in out.collect()} == want and 5 < sum(v[1] for v in want.values()) < sum(v[0] for v in want.values())


def nearest(x, q, n):
    import numpy as np

    score = np.floor((q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)) * 1e9 + 0.5) / 1e9
    return [[(float(s), i) for s, i in sorted(((-score[k, i], str(i)) for i in range(len(x))))[:n]] for k in range(len(q))]


@pytest.mark.parametrize(("rows", "dims"), [(2_000, 16), (12_000, 48)])
def test_dense_index_recall_and_exact_search(spark, rows, dims):
    import numpy as np

    rng = np.random.default_rng(rows)
    x = (rng.normal(size=(40, dims))[rng.integers(0, 40, rows)] + 0.7 * rng.normal(size=(rows, dims))).astype(np.float32)
    x[5] = x[6]  # a tie
    q = x[::97][:60] + 0.3 * rng.normal(size=(len(x[::97][:60]), dims)).astype(np.float32)
    frame = lambda v, name: spark.createDataFrame([(str(i) if name == "chunk_id" else i, r.tolist()) for i, r in enumerate(v)], f"{name} {'string' if name == 'chunk_id' else 'int'}, vector array<float>")
    odd = spark.createDataFrame([("z1", None), ("z2", [0.0] * dims), ("z3", [float("nan")] * dims), (None, [1.0] * dims)], "chunk_id string, vector array<float>")
    index = dense_index.build(frame(x, "chunk_id").unionByName(odd))
    want = nearest(x.astype(float), q.astype(float), 10)
    got = {}
    for exact in (False, True):
        for r in index.search(frame(q, "query_id"), 10, probes=10, exact=exact, above=None).collect():
            got.setdefault((exact, r.query_id), []).append((r.dense_rank, -r.score, r.chunk_id))
    assert all([(s, i) for _, s, i in sorted(got[True, k])] == want[k] for k in range(len(q)))
    plain = dense_index.exact_top(frame(q, "query_id"), frame(x, "chunk_id").unionByName(odd), 10, above=None).collect()
    assert sorted((r.query_id, r.dense_rank, -r.score, r.chunk_id) for r in plain) == sorted((k, *x_) for (e, k), rows_ in got.items() if e for x_ in rows_)
    recall = np.mean([len({i for _, _, i in got[False, k]} & {i for _, i in want[k]}) / 10 for k in range(len(q))])
    assert recall >= 0.9
    assert dense_index.build(odd).search(frame(q, "query_id"), 3).count() == 0 and index.search(odd.withColumnRenamed("chunk_id", "query_id"), 3).count() == 0


def test_tables_between_steps_are_cleared(spark):
    from quillstone.functions import workspace

    kept = workspace.written(spark.range(3), "three")
    assert kept.count() == 3 and f"/{spark.sparkContext.applicationId}/three-" in kept.inputFiles()[0]
    workspace.clear(spark)
    assert Log(spark, workspace.shared_root(spark)).names(f"{workspace.shared_root(spark)}/quillstone/{spark.sparkContext.applicationId}") == []
