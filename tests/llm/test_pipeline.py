"""The pipeline's stages against brute force on the smallest documents."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm.common import Scratch

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def components(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "minhash_near_dedup" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(90_001, "... 123 !!!", "en", "src1", 11), (90_002, None, "en", "src1", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    work, columns = Scratch(spark, "test"), docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.table(stage(spark, docs, str(SF)), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    every = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert kept["language_id"] == every
    first: dict[str, int] = {}
    for i in sorted(every):
        first.setdefault(every[i], i)
    assert set(kept["exact_dedup"]) == set(first.values())
    near = components(kept["exact_dedup"], 5, 80)
    assert set(kept["minhash_near_dedup"]) == {i for i, c in near.items() if i == c}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in taken) <= 3
    total = sum(map(words, kept["minhash_near_dedup"].values()))
    mixed = sum(r.n * words(kept["mix_sources"][r.doc_id]) for r in taken)
    assert abs(mixed - total) < 0.15 * total
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).toPandas()
    assert set(packed.doc_id) == set(kept["mix_sources"]) and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= 1.05 * packed.length.sum() / 2048 + 1
