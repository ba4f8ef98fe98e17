"""Cleaning, chunking, chunk analytics."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boundaries, chunking, embedding, stats
from . import base
from .base import query, read

DIRTY = [
    (1, "abc\x07def \x01ghi"),
    (2, "first line\n  12  \nsecond   line\t\tend"),
    (3, "header Page 3 of 45 tail\npAGE 4 OF 45"),
    (4, "one\n - 7 - \ntwo"),
    (5, "compre-\nhension of a-\nb-\nc"),
    (6, "trailing   \nblanks\t\n\n\n\n\nend  "),
    (7, "   \n \n"),
    (8, "plain text stays as it is."),
]
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '(?i)Page\s+\d+\s+of\s+\d+', '', 'g'), '(?m)^\s*-\s*\d+\s*-\s*$', '', 'g'),
  '([\w])-\n([\w])', '\1\2', 'g'), '([\w])-\n([\w])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '(?m)[ \t\r\f]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


DIRTY_ROWS = base.Mixed("dirty", "id int, text string", DIRTY, "SELECT CAST(1000 + doc_id AS INT) AS id, text FROM {documents}")


@query("c01_clean_fixture", f"WITH {DIRTY_ROWS.cte}, c AS (SELECT id, length(text) AS original, regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g') AS cleaned FROM dirty) SELECT id, original AS original_chars, length(cleaned) AS cleaned_chars, cleaned FROM c WHERE cleaned <> ''")
def clean_fixture(spark, d):
    rows = DIRTY_ROWS.frame(spark, d).withColumn("cleaned", T.clean(F.col("text")))
    return rows.filter("cleaned <> ''").select("id", F.length("text").alias("original_chars"), F.length("cleaned").alias("cleaned_chars"), "cleaned")


@query("c08_clean_pages", f"WITH c AS (SELECT doc_id, length(text) AS original, regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents) SELECT doc_id, original AS original_char_count, length(cleaned) AS cleaned_char_count, md5(cleaned) AS digest FROM c WHERE cleaned <> ''")
def clean_pages(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", T.clean(F.col("text")).alias("cleaned")).filter("cleaned <> ''")
    return rows.select("doc_id", F.length("text").alias("original_char_count"), F.length("cleaned").alias("cleaned_char_count"), F.md5("cleaned").alias("digest"))


@query("c02_nfkc")
def nfkc(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(T.clean(F.col("text"), normalise=True)).alias("cleaned_char_count"))


@query("c09_one_space", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def one_space(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.one_space(F.col("text"))).alias("digest"))


@query("k01_join_pages", f"WITH {base.PAGES},{base.SPANS} SELECT s.doc_id, s.page_number, s.span_start, CAST(s.span_start + length(s.text) AS INTEGER) AS span_end, length(j.text) AS doc_chars FROM spans s JOIN joined j USING (doc_id)")
def join_pages(spark, d):
    docs = chunking.join_pages(base.pages(spark, d))
    return docs.select("doc_id", F.explode("spans").alias("s"), F.length("text").alias("doc_chars")).select("doc_id", "s.page_number", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "doc_chars")


@query("k02_fixed_windows", f"WITH {base.CHUNKS} SELECT doc_id, chunk_index, char_start, char_end, md5(text) AS digest FROM chunks")
def fixed_windows(spark, d):
    return base.chunks(spark, d).select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("digest"))


@query("k03_sentences", f"SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM (SELECT doc_id, unnest({base.sentences_sql('text')}) AS s FROM documents) WHERE regexp_matches(s, '\\S') GROUP BY doc_id")
def sentences(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).filter(F.col("s").rlike(r"\S"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("k03_learned_sentences")
def learned_sentences(spark, d):
    """Sentences of all documents by boundaries learned from them."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = boundaries.sentences(docs, boundaries.learn(docs))
    return found.select("doc_id", "sentence_no", "char_start", "char_end", F.md5("text").alias("digest"))


_PACK = r"""WITH RECURSIVE cut AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS parts FROM documents),
 pieces AS (SELECT doc_id, i, CASE WHEN i = 1 THEN p ELSE split_part(p, chr(2), 2) END AS s, CASE WHEN i = 1 THEN 0 ELSE length(split_part(p, chr(2), 1)) END AS gap
            FROM (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut)),
 placed AS (SELECT doc_id, i, s, sum(gap + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces),
 sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, CAST(e - length(s) AS BIGINT) AS a, CAST(e AS BIGINT) AS b FROM placed WHERE regexp_matches(s, '\S')),
 reach AS (SELECT x.doc_id, x.i, x.a, coalesce(max(y.i), x.i) AS j FROM sent x LEFT JOIN sent y ON y.doc_id = x.doc_id AND y.i > x.i AND y.i <= x.i + 800 AND y.b - x.a <= 800 GROUP BY x.doc_id, x.i, x.a),
 step AS (SELECT r.doc_id, r.i, r.a, s.b, greatest(r.i + 1, r.j + 1 - 2) AS nxt FROM reach r JOIN sent s ON s.doc_id = r.doc_id AND s.i = r.j),
 walk AS (SELECT * FROM step WHERE i = 1 UNION ALL SELECT t.* FROM walk w JOIN step t ON t.doc_id = w.doc_id AND t.i = w.nxt)
 SELECT doc_id, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end FROM walk"""


@query("k04_sentence_packing", _PACK)
def sentence_packing(spark, d):
    return chunking.sentence_spans(read(spark, d, "documents")).select("doc_id", "char_start", "char_end")


@query("k06_paragraph_packing")
def paragraph_packing(spark, d):
    docs = chunking.join_pages(base.pages(spark, d))
    return chunking.paragraph_spans(docs).select("doc_id", "char_start", "char_end", F.md5("text").alias("digest"))


@query("k07_token_count", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + 2 END AS INTEGER) AS tokens FROM documents")
def token_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("k08_token_guard", "SELECT doc_id, CAST(s AS INTEGER) AS char_start, CAST(s + length(substring(text, s + 1, w)) AS INTEGER) AS char_end FROM (SELECT doc_id, text, CASE WHEN length(text) // 4 + 2 > 256 THEN 1016 ELSE length(text) END AS w, unnest(CASE WHEN length(text) // 4 + 2 > 256 THEN range(0, greatest(length(text) - 128, 1), 888) ELSE [0] END) AS s FROM documents WHERE length(text) > 0)")
def token_guard(spark, d):
    docs = read(spark, d, "documents").filter("length(text) > 0").select("doc_id", F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return chunking.guard(docs).select("doc_id", "char_start", "char_end")


_PAGED = f"""WITH {base.PAGES},{base.SPANS},
 paged AS (SELECT doc_id, CAST(s AS INTEGER) AS char_start, CAST(s + length(t) AS INTEGER) AS char_end FROM (SELECT doc_id, s, substring(text, CAST(s + 1 AS BIGINT), 500) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) AS s FROM joined WHERE length(text) > 0)) WHERE regexp_matches(t, '\\S'))
 SELECT p.doc_id, p.char_start, p.char_end, CAST(coalesce(min(s.page_number), 1) AS INTEGER) AS page_number, count(s.page_number) AS n_pages
 FROM paged p LEFT JOIN spans s ON s.doc_id = p.doc_id AND p.char_start < s.span_start + length(s.text) AND p.char_end > s.span_start GROUP BY ALL"""


@query("k09_page_mapping", _PAGED)
def page_mapping(spark, d):
    docs = chunking.join_pages(base.pages(spark, d))
    rows = chunking.assemble(chunking.fixed_spans(docs), "fixed", docs)
    return rows.select("doc_id", "char_start", "char_end", "page_number", F.coalesce(F.size("spans_pages"), F.lit(1)).cast("long").alias("n_pages"))


@query("k10_chunk_ids", f"WITH {base.CHUNKS} SELECT doc_id, chunk_index, chunk_id, content_hash, token_count FROM chunks")
def chunk_ids(spark, d):
    return base.chunks(spark, d).select("doc_id", "chunk_index", "chunk_id", "content_hash", "token_count")


@query("k12_entities", r"""SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(plain, '\b[A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)*(?:[ ](?:Inc|Corp|Ltd|LLC|Co|Group|Holdings|Technologies|Solutions))\.?\b'), regexp_extract_all(substring(plain, 1, 600), '\b[A-Z]{2,5}\b')))) AS entities FROM (SELECT doc_id, regexp_replace(text, '[\x{80}-\x{10FFFF}]', '_', 'g') AS plain FROM documents)""")
def entities(spark, d):
    return read(spark, d, "documents").select("doc_id", chunking.entities(F.col("text")).alias("entities"))


_SIZES = "count(*) AS total_chunks, round(avg(length(text)), 2) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, sum(token_count) AS total_tokens"


@query("a01_size_stats", f"WITH {base.CHUNKS} SELECT doc_id, {_SIZES} FROM chunks GROUP BY doc_id")
def size_stats(spark, d):
    return stats.sizes(base.chunks(spark, d), "doc_id")


@query("a02_size_histogram", f"WITH {base.CHUNKS}, b AS (SELECT doc_id, CASE WHEN length(text) < 200 THEN '0-200' WHEN length(text) < 400 THEN '200-400' WHEN length(text) < 600 THEN '400-600' WHEN length(text) < 800 THEN '600-800' ELSE '800+' END AS bucket FROM chunks) SELECT k.doc_id, l.bucket, count(b.bucket) AS n FROM (SELECT DISTINCT doc_id FROM chunks) k CROSS JOIN (VALUES ('0-200'), ('200-400'), ('400-600'), ('600-800'), ('800+')) l(bucket) LEFT JOIN b ON b.doc_id = k.doc_id AND b.bucket = l.bucket GROUP BY ALL")
def size_histogram(spark, d):
    return stats.histogram(base.chunks(spark, d), "doc_id")


@query("a03_overlap_coverage", f"WITH {base.CHUNKS}, o AS (SELECT doc_id, char_end, greatest(0, least(char_end, lead(char_end) OVER w) - greatest(char_start, lead(char_start) OVER w)) * (CASE WHEN lead(char_start) OVER w IS NULL THEN 0 ELSE 1 END) AS s FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, round(sum(s) / max(char_end) * 100, 6) AS overlap_coverage_pct FROM o GROUP BY doc_id")
def overlap_coverage(spark, d):
    return stats.overlap_coverage(base.chunks(spark, d))


_PER_PAGE = _PAGED.replace(" SELECT p.doc_id,", ", c AS (SELECT p.doc_id,", 1) + ") SELECT doc_id, page_number, count(*) AS n_chunks FROM c GROUP BY ALL"


@query("a04_chunks_per_page", _PER_PAGE)
def chunks_per_page(spark, d):
    docs = chunking.join_pages(base.pages(spark, d))
    return stats.per_page(chunking.assemble(chunking.fixed_spans(docs), "fixed", docs))


ODD = [(1, 0, 1, 0, 20, "x" * 20), (1, 1, 1, 10, 1200, "y" * 1190), (1, 2, 2, 1200, 1700, "z" * 500), (2, 0, 1, 0, 49, "w" * 49)]
ODD_PAGES = [(1, 1, 900), (1, 2, 700), (1, 3, 80), (1, 4, 0), (2, 1, 49), (2, 2, 10)]
_ODD = base.CHUNKS + ", " + base.values("odd_rows", "doc_id bigint, chunk_index int, page_number int, char_start int, char_end int, text string", ODD) + ", odd AS (SELECT * FROM odd_rows UNION ALL SELECT doc_id + 1000, chunk_index, 1, char_start, char_end, text FROM chunks), " + (PAGE_ROWS := base.Mixed("odd_pages", "doc_id bigint, page_number int, cleaned_char_count int", ODD_PAGES, "SELECT doc_id + 1000 AS doc_id, CAST(1 + doc_id % 2 AS INT), CAST(length(text) AS INT) FROM {documents}")).cte


@query("a05_warnings", f"WITH {_ODD} SELECT doc_id, 'tiny' AS kind, list(chunk_index ORDER BY chunk_index) AS places FROM odd WHERE length(text) < 50 GROUP BY doc_id UNION ALL SELECT doc_id, 'oversized', list(chunk_index ORDER BY chunk_index) FROM odd WHERE length(text) > 1000 GROUP BY doc_id UNION ALL SELECT doc_id, 'page_without_chunks', list(page_number ORDER BY page_number) FROM odd_pages p WHERE cleaned_char_count > 0 AND NOT EXISTS (SELECT 1 FROM odd o WHERE o.doc_id = p.doc_id AND o.page_number = p.page_number) GROUP BY doc_id")
def warnings(spark, d):
    rows = base.fixture(spark, "doc_id bigint, chunk_index int, page_number int, char_start int, char_end int, text string", ODD)
    own = base.chunks(spark, d).select((F.col("doc_id") + 1000).alias("doc_id"), "chunk_index", "page_number", "char_start", "char_end", "text")
    return stats.warnings(rows.unionByName(own), PAGE_ROWS.frame(spark, d))


@query("a06_compare_strategies")
def compare_strategies(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    rows = chunking.chunks(docs, "fixed").unionByName(chunking.chunks(docs, "sentence")).unionByName(chunking.chunks(docs, "paragraph"))
    return stats.sizes(rows, "doc_id", "strategy")


@query("a07_listing", f"WITH {base.CHUNKS} SELECT doc_id, chunk_index, chunk_id, page_number, char_start, char_end, token_count, length(text) AS chars, substring(text, 1, 240) AS excerpt FROM chunks")
def listing(spark, d):
    return stats.listing(base.chunks(spark, d))


@query("a08_embedding_stats", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS l2_norm, embedding[1:8] AS preview FROM embeddings")
def embedding_stats(spark, d):
    return stats.embedding_stats(read(spark, d, "embeddings"), "vec_id")


_UNIT = "(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))))"


@query("a09_neighbours", f"WITH v AS (SELECT vec_id, vec_id // 25 AS doc_id, embedding FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, round({_UNIT}, 6) AS similarity FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.vec_id <> b.vec_id) SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM p QUALIFY rank <= 3")
def neighbours(spark, d):
    rows = read(spark, d, "embeddings").withColumn("doc_id", F.expr("vec_id div 25"))
    return stats.neighbours(rows, "doc_id", "vec_id", 3)


@query("a10_projection")
def projection(spark, d):
    rows = read(spark, d, "embeddings").withColumn("doc_id", F.expr("vec_id div 25"))
    return stats.project_2d(rows, "doc_id", "vec_id").select("doc_id", "vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("e01_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(CAST(x * 3 AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y * 3 AS DOUBLE) * CAST(y * 3 AS DOUBLE)))) AS FLOAT) AS DOUBLE))), 3) + 0.0 AS unit_sum, 1.0 AS unit_norm FROM embeddings")
def l2_normalise(spark, d):
    rows = read(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float")))
    unit = rows.select("vec_id", embedding.l2_normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", (F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double")), 3) + F.lit(0.0)).alias("unit_sum"), F.round(embedding.norm(F.col("u")), 4).alias("unit_norm"))


@query("e04_hashed_vectors", f"WITH {base.CHUNKS},{base.vectors_sql('cvec', 'chunks', 'chunk_id')} SELECT chunk_id, bucket, tf, norm2 FROM cvec")
def hashed_vectors(spark, d):
    return embedding.sparse_vectors(base.chunks(spark, d), "chunk_id")


@query("e05_query_vectors", f"WITH {base.QUESTIONS},{base.vectors_sql('qvec', 'questions', 'query_id')} SELECT query_id, bucket, tf, norm2 FROM qvec")
def query_vectors(spark, d):
    return embedding.sparse_vectors(base.questions(spark, d), "query_id")


@query("e02_model_embedding", "SELECT item_id AS query_id, [CAST(length(text) AS FLOAT), CAST(1 AS FLOAT)] AS embedding FROM benchmark")
def model_embedding(spark, d):
    rows = base.questions(spark, d)
    return embedding.embed_with(rows, "query_id", lambda texts: [[float(len(t)), 1.0] for t in texts])


@query("e06_tiers", f"WITH {base.CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) SELECT doc_id, n, CASE WHEN n <= 100 THEN 'small' WHEN n >= 1000 THEN 'large' ELSE 'medium' END AS tier, CAST(ceil(n / 32.0) AS BIGINT) AS batches FROM n")
def tiers(spark, d):
    n = base.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.withColumn("tier", embedding.tier(F.col("n"))).withColumn("batches", F.ceil(F.col("n") / 32))


_JOBS = f"WITH {base.CHUNKS}, j AS (SELECT doc_id, count(*) AS total, count(*) FILTER (doc_id % 7 <> 0 AND substring(chunk_id, 1, 1) <> '0') AS done, count(*) FILTER (doc_id % 7 = 0 OR substring(chunk_id, 1, 1) = '0') AS failed FROM chunks GROUP BY 1)"


def _jobs(spark, d):
    bad = (F.col("doc_id") % 7 == 0) | (F.substring("chunk_id", 1, 1) == "0")
    return base.chunks(spark, d).withColumn("bad", bad)


@query("e07_job_status", _JOBS + " SELECT doc_id, total, done, failed, CASE WHEN done = 0 AND total > 0 THEN 'failed' WHEN failed > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM j")
def job_status(spark, d):
    j = _jobs(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(~F.col("bad")).alias("done"), F.count_if("bad").alias("failed"))
    return j.withColumn("status", embedding.job_status(F.col("total"), F.col("done"), F.col("failed")))


@query("e08_retry_failed", f"WITH {base.CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE doc_id % 7 = 0 OR substring(chunk_id, 1, 1) = '0'")
def retry_failed(spark, d):
    rows = _jobs(spark, d)
    return base.chunks(spark, d).join(rows.filter("bad").select("chunk_id"), "chunk_id", "left_semi").select("doc_id", "chunk_id")


# the model fails on texts whose hash begins with 0, and on whole batches that hold one which begins with 00
_RESUMED = f"""WITH {base.CHUNKS}, t AS (SELECT doc_id, chunk_index, substring(content_hash, 1, 1) = '0' AS bad, max(CASE WHEN substring(content_hash, 1, 2) = '00' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chunk_index // 32) = 1 AS broken FROM chunks),
 j AS (SELECT doc_id, count(*) AS total, count(*) FILTER (bad OR broken) AS failed, max(chunk_index) // 32 AS checkpoint FROM t GROUP BY 1)
 SELECT doc_id, total, total - {{failed}} AS completed, {{failed}} AS failed, CAST(checkpoint AS INTEGER) AS checkpoint, CASE WHEN total <= 100 THEN 'small' WHEN total >= 1000 THEN 'large' ELSE 'medium' END AS tier,
        CASE WHEN total = {{failed}} THEN 'failed' WHEN {{failed}} > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM j"""


def _resumed(spark, d):
    """A job over all chunks that is left after three parts and run again."""
    from ..functions.workspace import new_folder
    from ..streaming.embed_job import EmbeddingJob

    def model(texts):
        marks = [hashlib.sha256(t.encode()).hexdigest()[:2] for t in texts]
        if "00" in marks:
            raise RuntimeError("the model failed on this batch")
        return [None if m[0] == "0" else [float(len(t))] for m, t in zip(marks, texts, strict=True)]

    rows = base.stored_chunks(spark, d)
    job = EmbeddingJob(spark, new_folder(spark, "job"))
    job.run(rows, model, most_parts=3)
    job.run(rows, model)
    return job, rows


@query("e08_resumed_job", _RESUMED.format(failed="failed"))
def resumed_job(spark, d):
    job, rows = _resumed(spark, d)
    return job.progress(rows)


@query("e08_retried_job", _RESUMED.format(failed="0"))
def retried_job(spark, d):
    job, rows = _resumed(spark, d)
    job.retry(rows, lambda texts: [[1.0]] * len(texts))
    return job.progress(rows)
