"""Every operator on nulls, empty and very long texts, ties and repeated rows, an empty table, and extra columns with clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, language_id, license_scan, lm_score, mixing, near_dedup, nn_descent, packing, token_codec, url_filter
from quillstone.llm.common import Scratch
from quillstone.llm.tokenizing import default_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, row string, content string, size int, key string, class string, n int, a int, b int, rank int"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", ""),
    (None, "a text without an id", "de", "s2"),
    (None, None, "de", None),
    (5, "   \n\t ", None, "s2"),
    (6, LONG, "en", "s3"),
    (7, "one two three", "de", "s3"),
    (8, "ünïcödé 数据 ", "de", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "r", "c", 2, "k", "x", 3, 4, 5, 6) for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_content_sort(docs, empty):
    rows = exact_dedup.content_sort(docs, keep="largest").select("row.doc_id", "row.text", "keep_id", "group_size", "kept").collect()
    assert len(rows) == len(ROWS)
    fox = [r for r in rows if (r.text or "").startswith("the quick")]
    assert {r.keep_id for r in fox} == {2} and {r.group_size for r in fox} == {3} and sum(r.kept for r in fox) == 1
    none = [r for r in rows if not r.text]
    assert {r.keep_id for r in none} == {4} and {r.group_size for r in none} == {3}
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert sum(r.text is not None and r.text.startswith("the quick") for r in exact_dedup.exact_dedup(docs).collect()) == 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_content_sort_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    found = exact_dedup.content_sort(rows, keep="smallest", ranges=16).select("row.*", "keep_id", "group_size", "kept").toPandas()
    want = found.assign(t=found.text).groupby("t").doc_id.agg(["min", "count"])
    assert (found.keep_id.values == want.loc[found.text, "min"].values).all() and (found.group_size.values == want.loc[found.text, "count"].values).all()
    assert found[found.kept].shape[0] == found.text.nunique()


def test_mixing(docs, empty):
    rows = mixing.mix_counts(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_counts(docs).collect()), key=repr)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_near(docs, empty):
    rows = near_dedup.near_duplicates(docs, width=4).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[2] == {(9, 1, False)} and by[1] == {(9, 1, True)} and by[3] == {(0, 3, True)} and by[7] == {(1, 7, True)}
    assert all(c is None and k for _, c, k in by[None])
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_rows_of_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (5, a + " end"), (7, b)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert found == [(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (3, 26, 1, False), (5, 27, 1, False), (7, 26, 1, False)]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, default_path("word_bpe_49k.json"), 2048).toPandas()
    assert (rows.length <= 2048).all() and rows[rows.doc_id == 3].length.tolist() == [1]
    at = rows.sort_values(["sequence_id", "offset"])
    assert ((at.groupby("sequence_id").length.cumsum() - at.length) == at.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048 and len(rows[rows.doc_id == 6]) > 50
    made = packing.sequences(docs, default_path("word_bpe_49k.json"), 2048)
    assert made.select(F.max(F.size("ids"))).first()[0] <= 2048 and made.select(F.sum(F.size("ids"))).first()[0] == rows.length.sum()
    assert packing.pack_documents(empty, default_path("word_bpe_49k.json")).count() == 0


def test_codec(spark, docs, empty):
    path, tokenizer = f"{Scratch(spark, 'test').base}/files", default_path("byte_bpe_50k.json")
    token_codec.write_ids(docs, path, tokenizer)
    rows = token_codec.read_ids(spark, path).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r.doc_id for r in rows if r.doc_id is not None] == [1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert all(r.ids_crc32 == r.crc_written == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.ids[-1] == 0 for r in rows)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    token_codec.write_ids(empty, path + "-none", tokenizer)
    assert token_codec.read_ids(spark, path + "-none").count() == 0


def test_language(docs, empty):
    vocabulary = default_path("piece_bpe_32k.model")
    model = language_id.fit(docs, vocabulary)
    rows = language_id.predict(docs, model).select("row.*", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS)
    odd = docs.limit(1).select(F.lit(0).cast("long").alias("doc_id"), F.explode(F.array(F.lit("²½"), F.lit("Ⅳ ①"), F.lit("5 ³"))).alias("text"))
    assert {r.lang_pred for r in language_id.predict(odd, model).collect()} == {"und"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in rows)
    none = language_id.fit(empty, vocabulary)
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"} and language_id.predict(empty, model).count() == 0


def test_lm_score(docs, empty):
    model = lm_score.fit(docs, F.col("lang") == "en").cache()
    rows = lm_score.score(docs, model).select("row.doc_id", "row.text", "n_tokens", "score").collect()
    assert len(rows) == len(ROWS) and all((r.score is None) == (not r.text) and r.n_tokens == len((r.text or "").encode()) for r in rows)
    small = lm_score.score(docs, model, block_bytes=20).select("row.doc_id", "row.text", "score").collect()
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert [r.score for r in sorted(rows, key=key)] == [r.score for r in sorted(small, key=key)]
    assert lm_score.score(empty, lm_score.fit(empty, F.lit(True))).count() == 0
    with pytest.raises(ValueError):
        lm_score.fit(docs, F.lit(True), order=8)


def test_lm_score_equals_brute_force(spark):
    order, mu = 4, 3.0
    rows = [(1, "abab abc", True), (2, "abba cab", False), (3, "ünï abab", True), (4, "zz abc zz", False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, good boolean")
    other = spark.createDataFrame([(9, "abx abab ü"), (10, "")], "doc_id bigint, text string")
    model = lm_score.fit(docs, F.col("good"), order=order, mu=mu)
    grams = lambda t: [tuple(([0] * (order - 1) + [*t.encode()])[i : i + order]) for i in range(len(t.encode()))]
    target = [g for _, t, good in rows if good for g in grams(t)]
    every = [g for _, t, _ in rows for g in grams(t)]

    def p(gram, corpus, scale):
        if len(gram) == 1:
            return (sum(g[-1] == gram[0] for g in corpus) * scale + 1) / (len(corpus) * scale + 256)
        n = len(gram)
        both = sum(g[-n:] == gram for g in corpus) * scale
        context = sum(g[-n:-1] == gram[:-1] for g in corpus) * scale
        return (both + mu * p(gram[1:], corpus, scale)) / (context + mu)

    for table in (docs.select("doc_id", "text"), other):
        for r in lm_score.score(table, model, block_bytes=9).select("row.text", "target_loss", "background_loss", "score").collect():
            if r.text:
                want = [-np.mean([np.log(p(g, c, s)) for g in grams(r.text)]) for c, s in ((target, 1.0), (every, len(target) / len(every)))]
                assert np.allclose([r.target_loss, r.background_loss, r.score], [*want, want[0] - want[1]], atol=1e-5)


def test_labelled_target_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 1, 1, 1, 1), (2, "b", 1, 1, 1, 1), (2, "b", 1, 1, 1, 1), (None, "c", 1, 1, 1, 1)], "doc_id bigint, text string, toxic int, good int, label_id int, is_target int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, 0), (2, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = lm_score.labelled_target(docs, labels)
    assert found.columns == docs.columns and sorted((r.doc_id or 0, r.is_target) for r in found.collect()) == [(0, False), (1, True), (2, False), (2, False)]


def test_licenses(spark, empty):
    texts = [(1, "x " * 30 + "Released under the MIT License. " + "y " * 9), (2, None), (3, ""), (4, "Released under the MIT"), (5, license_scan.TEMPLATES["MIT"].replace("free of charge", "at no cost")), (6, LONG)]
    rows = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.template) for r in rows} == {(1, "MIT-line"), (5, "MIT")}
    hit = next(r for r in rows if r.doc_id == 1)
    assert texts[0][1][hit.start_char : hit.end_char] == "Released under the MIT License"
    assert license_scan.scan_licenses(empty).count() == 0


def test_licenses_equal_exhaustive_containment(spark):
    rnd = random.Random(4)
    filler = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    texts = []
    for _ in range(120):
        words = rnd.choice(list(license_scan.TEMPLATES.values())).split()
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randrange(2)] = [f"x{rnd.randrange(99)}" for _ in range(rnd.choice([0, 1, 1, 2, 12]))]
        texts.append(f"{filler(rnd.randrange(40))} {' '.join(words)} {filler(rnd.randrange(40))}")
    shingled = lambda t: (w := re.findall("[a-z0-9]+", t.lower())) and {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = {name: shingled(t) for name, t in license_scan.TEMPLATES.items()}
    want = {(i, name) for i, t in enumerate(texts) for name, s in sets.items() if len(s & shingled(t)) >= 0.8 * len(s)}
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.template) for r in rows} == want and len(want) > 40


def test_urls(spark):
    urls = [
        (1, "https://a.NET/x", "a.net", "/x", "net/", "block"),
        (2, "http://www.Example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "http://example.net/enx", "example.net", "/enx", "net/", "block"),
        (4, "http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        (5, "http://x.example.com/de/2#f", "x.example.com", "/de/2", "example.com/de/", "block"),
        (6, "https://foo.org/fr/", "foo.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "http://a.net", "a.net", "", None, "allow"),
        (10, "http://cheappillscasino.example.com/en/1", "cheappillscasino.example.com", "/en/1", None, "block"),
        (11, "http://xn--" + "z" * 5000 + ".com/", "xn--" + "z" * 5000 + ".com", "/", None, "allow"),
    ]
    rows = url_filter.judge_urls(spark.createDataFrame([(u[0], u[1], 0, "x") for u in urls], "page_id bigint, url string, host int, verdict string"), default_path("byte_bpe_50k.json"))
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows.orderBy("page_id").collect()] == [(u[0], *u[2:]) for u in urls]
    assert url_filter.judge_urls(rows.limit(0).withColumn("url", F.lit("")), default_path("byte_bpe_50k.json")).count() == 0


def test_segmentation():
    words = url_filter.lexicon(default_path("byte_bpe_50k.json"))
    assert url_filter.segment("cheapflights", words) == ["cheap", "flights"] and "".join(url_filter.segment("qzxqzxhouse", words)) == "qzxqzxhouse"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[100:160] = x[7]  # one vector, many rows
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1050, [0.0] * 8, 1), (1100, [float("nan")] + [1.0] * 7, 1), (1150, [None] + [1.0] * 7, 1), (1200, [1.0] * 5, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    found = nn_descent.search(nn_descent.build(table), table.filter("vec_id % 50 = 0"), 5).toPandas()
    exact = nn_descent.brute_force(x.astype(np.float64), np.arange(300), np.arange(0, 300, 50))
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in found.groupby("query_id")}
    assert got.keys() == exact.keys() and np.mean([len(set(got[q]) & set(exact[q])) / 5 for q in exact]) >= 0.9
    assert got[100] == [7, 101, 102, 103, 104] and got[150] == [7, 100, 101, 102, 103]
    twenty = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(20)] + [(20, [4.0, -3.0])], "vec_id bigint, embedding array<double>")
    assert nn_descent.search(nn_descent.build(twenty), twenty.filter("vec_id = 5"), 10).orderBy("rank").toPandas().vec_id.tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    few = table.filter("vec_id < 3")
    assert nn_descent.search(nn_descent.build(few), few.filter("vec_id = 0"), 5).count() == 2
    assert nn_descent.search(nn_descent.build(table.limit(0)), table, 5).count() == 0


def test_vectors_near_copies(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(64) + 0.005 * rng.standard_normal((200, 64)), rng.standard_normal((200, 64))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = nn_descent.search(nn_descent.build(table), table.filter("vec_id % 5 = 0 and vec_id < 200"), 5).toPandas()
    exact = nn_descent.brute_force(x.astype(np.float64), np.arange(400), np.arange(0, 200, 5))
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in found.groupby("query_id")}
    assert np.mean([len(set(got[q]) & set(exact[q])) / 5 for q in exact]) >= 0.95


def test_vectors_in_clusters_without_starting_points(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "ENTRIES", 4)  # as with many more clusters than starting points
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.standard_normal((30, 64)), 40, 0) + 0.2 * rng.standard_normal((1200, 64))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    index = nn_descent.build(table)
    moved = spark.createDataFrame([(i, (x[i] + 0.01 * rng.standard_normal(64)).tolist()) for i in range(1, 1200, 40)], "vec_id bigint, embedding array<float>")
    exact = nn_descent.brute_force(x.astype(np.float64), np.arange(1200), np.arange(1, 1200, 20))
    for queries, asked in ((table.filter("vec_id % 20 = 1"), 60), (moved, 30)):
        found = nn_descent.search(index, queries, 5).toPandas()
        got = {q: set(g.vec_id) for q, g in found.groupby("query_id")}
        assert len(got) == asked and np.mean([len(got[q] & set(exact[q])) / 5 for q in got]) >= 0.85


def test_long_name_is_segmented():
    judge = url_filter.Judge(url_filter.lexicon(default_path("byte_bpe_50k.json")))
    assert judge.tokens(f"{'cheapflights' * 20}.example", "") == ["cheap", "flights"] * 20
