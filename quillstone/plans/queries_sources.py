"""Sources and sinks, vector collections, library operations, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.workspace import new_folder
from ..operators import dense_index, index, library
from ..sources import backends, store, uploads
from . import base
from .base import CHUNKS, PAGES, query, read

FILES = [("/u/a.pdf", 10), ("/u/b.DOCX", 20971520), ("/u/c.docx", 20971521), ("/u/d.txt", 5), ("/u/e.pdf", 0), ("/u/noext", 7), ("/u/x.tar.pdf", 3)]


# pages stand for files that someone uploads under their url
FILE_ROWS = base.Mixed("f", "path string, length bigint", FILES, "SELECT url, CAST(length(html) AS BIGINT) FROM {pages} UNION ALL SELECT '/u/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DocX' ELSE '.md' END, CAST(length(text) * 7000 AS BIGINT) FROM {documents}")


@query("s05_upload_validation", f"WITH {FILE_ROWS.cte}, s AS (SELECT *, CASE WHEN NOT list_contains(['pdf', 'docx'], lower(regexp_extract(path, '\\.([^./]+)$', 1))) THEN 415 WHEN length > 20971520 THEN 413 WHEN length = 0 THEN 422 ELSE 200 END AS status FROM f) SELECT *, status = 200 AS accepted FROM s")
def upload_validation(spark, d):
    return uploads.validate(FILE_ROWS.frame(spark, d))


@query("s04_docx_paging", f"WITH {PAGES} SELECT doc_id, page_number, md5(text) AS digest FROM pages")
def docx_paging(spark, d):
    return base.pages(spark, d).select("doc_id", "page_number", F.md5("text").alias("digest"))


@query("s01_parse_files")
def parse_files(spark, d):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>Paragraph {i}</w:t></w:r></w:p>" for i in range(45)) + "<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    files = spark.createDataFrame([("/u/a.docx", bytearray(out.getvalue())), ("/u/b.docx", bytearray(b"broken")), ("/u/c.xyz", bytearray(b""))], "path string, content binary")
    texts = read(spark, d, "documents").select(F.concat(F.lit("/d/"), "doc_id", F.when(F.col("doc_id") % 7 == 0, ".xyz").otherwise(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    forty = lambda data: ["\n".join(lines[i : i + 40]) for lines in [data.decode().split("\n")] for i in range(0, len(lines), 40)]
    return uploads.parse(files.unionByName(texts), parsers={"txt": forty}).select("doc_id", "page_number", F.length("text").alias("chars"), F.col("error").isNotNull().alias("failed"))


@query("s06_relational_scan", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def relational_scan(spark, d):
    return read(spark, d, "documents").filter("lang = 'en' AND n_chars > 1000").select("doc_id", "source", "n_chars")


@query("s07_vector_get", "SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id IN (SELECT unnest(range(0, 400, 3))) ORDER BY vec_id LIMIT 7")
def vector_get(spark, d):
    return index.get(read(spark, d, "embeddings"), list(range(0, 400, 3)), {"label": 3}, 7, ["label"], "vec_id")


@query("s08_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 7 FROM embeddings WHERE vec_id < 5")
def vector_upsert(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "label")
    changed = rows.filter("vec_id % 10 = 0").withColumn("label", (F.col("label") + 100).cast("int"))
    new = rows.filter("vec_id < 5").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(7).alias("label"))
    return index.upsert(rows, changed.unionByName(new), ["vec_id"])


@query("s09_vector_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 1 AND label <> 2")
def vector_delete(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "label")
    return index.delete(rows, rows.filter("vec_id % 4 = 1"), {"label": 2}, "vec_id")


@query("s09_count", "SELECT count(*) AS n FROM embeddings WHERE label = 1")
def count(spark, d):
    return index.where_equal(read(spark, d, "embeddings"), {"label": 1}).agg(F.count("*").alias("n"))


_COS = "round(1 - list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) + 0.0"


@query("s11_fan_out", f"WITH b AS (SELECT vec_id, embedding, ['chroma', 'pgvector', 'pinecone'][vec_id % 3 + 1] AS backend FROM embeddings), p AS (SELECT q.vec_id AS query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id, e.backend, {_COS} AS distance FROM b q JOIN b e ON q.vec_id % 50 = 0 AND e.backend <> 'pinecone'), l AS (SELECT *, row_number() OVER (PARTITION BY query_id, backend ORDER BY distance, chunk_id) AS n FROM p QUALIFY n <= 10) SELECT query_id, chunk_id, backend, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id, backend) AS place FROM l QUALIFY place <= 10")
def fan_out(spark, d):
    """Each backend searches its own rows; the third one can't be reached."""
    rows = read(spark, d, "embeddings").withColumn("backend", F.get(F.array(*map(F.lit, store.BACKENDS)), (F.col("vec_id") % 3).cast("int")))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def search(name):
        own = rows.filter(F.col("backend") == name).select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
        found = dense_index.exact_top(asked, own, 10, above=None)
        return found.select("query_id", "chunk_id", (F.round(store.distance(F.col("score")), 6) + F.lit(0.0)).alias("distance"))

    def unreachable(queries):
        raise ConnectionError("no such host")

    own = {name: lambda queries, name=name: search(name) for name in store.BACKENDS[:2]}
    return backends.fan_out(asked, own | {store.BACKENDS[2]: unreachable}, 10)[0]


DOCS = [("u1", "PGVECTOR ", "ready"), ("u1", None, "ready"), ("u1", "weird", "ready"), ("u2", "pinecone", "failed"), ("u2", "pinecone", "ready"), ("u3", "chroma", "parsing")]


DOC_ROWS = base.Mixed("x", "user_id string, vector_backend string, status string", DOCS, "SELECT 'd' || coalesce(source, ''), CASE doc_id % 4 WHEN 0 THEN 'pinecone' WHEN 1 THEN ' PgVector' WHEN 2 THEN 'other' END, CASE WHEN doc_id % 3 = 0 THEN 'parsing' ELSE 'ready' END FROM {documents}")


@query("s12_backend_routing", f"WITH {DOC_ROWS.cte} SELECT DISTINCT user_id, CASE WHEN lower(trim(vector_backend)) IN ('chroma', 'pgvector', 'pinecone') THEN lower(trim(vector_backend)) ELSE 'chroma' END AS backend FROM x WHERE status = 'ready'")
def backend_routing(spark, d):
    return store.backends_of(DOC_ROWS.frame(spark, d))


@query("s13_distance", "SELECT event_id, 1 - value AS distance FROM events")
def distance(spark, d):
    return read(spark, d, "events").select("event_id", store.distance(F.col("value")).alias("distance"))


@query("s14_metadata", f"WITH {CHUNKS} SELECT c.chunk_id, 8 + CASE WHEN d.source <> 'src3' THEN 1 ELSE 0 END AS n_keys, CAST(c.doc_id AS VARCHAR) AS doc, CASE WHEN d.source <> 'src3' THEN d.source END AS source FROM chunks c JOIN documents d USING (doc_id)")
def metadata(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    flat = store.flat_metadata(base.chunks(spark, d).join(docs, "doc_id"))
    return flat.select("chunk_id", F.size("metadata").alias("n_keys"), F.col("metadata")["doc_id"].alias("doc"), F.try_element_at("metadata", F.lit("source")).alias("source"))


@query("s16_evaluation_export", "SELECT item_id AS query_id, text AS question, text AS answer, [substring(text, 1, 40)] AS contexts, CASE WHEN item_id % 2 = 0 THEN text END AS reference FROM benchmark")
def evaluation_export(spark, d):
    return base.questions(spark, d).select("query_id", F.col("text").alias("question"), F.col("text").alias("answer"), F.array(F.substring("text", 1, 40)).alias("contexts"), F.when(F.col("query_id") % 2 == 0, F.col("text")).alias("reference"))


@query("s17_run_artifacts", "SELECT user_id AS run_id, CAST(round(sum(CAST(value AS DECIMAL(20, 6))), 1) AS DOUBLE) AS total_ms, count(*) AS step_count, list(event_type ORDER BY event_id) AS stages FROM events GROUP BY 1")
def run_artifacts(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return library.run_artifacts(rows).select("run_id", "total_ms", "step_count", F.col("steps.stage").alias("stages"))


def _versions(spark, d):
    rows = base.chunks(spark, d).select("doc_id", "chunk_id", "content_hash", "chunk_index")
    old = rows.filter("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("chunk_index") % 4 == 0, "old").otherwise(F.col("content_hash")))
    return old, rows.filter("doc_id % 7 <> 0")


@query("i01_reconcile", f"WITH {CHUNKS}, o AS (SELECT chunk_id, CASE WHEN chunk_index % 4 = 0 THEN 'old' ELSE content_hash END AS h FROM chunks WHERE doc_id % 5 <> 0), n AS (SELECT chunk_id, content_hash AS h FROM chunks WHERE doc_id % 7 <> 0) SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NULL THEN 'delete' WHEN o.chunk_id IS NULL OR o.h <> n.h THEN 'upsert' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.chunk_id = n.chunk_id")
def reconcile(spark, d):
    return index.reconcile(*_versions(spark, d))


@query("i02_replace_document", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE source END AS source FROM documents")
def replace_document(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source")
    return library.replace_document(rows, rows.filter("doc_id % 9 = 0").withColumn("source", F.lit("new")))


@query("i03_cascade_delete", f"WITH {CHUNKS} SELECT (SELECT count(*) FROM documents WHERE doc_id <> 3) AS documents, (SELECT count(*) FROM chunks WHERE doc_id <> 3) AS chunks, (SELECT count(*) FROM labels WHERE doc_id <> 3) AS labels")
def cascade_delete(spark, d):
    left = library.delete_document(3, read(spark, d, "documents"), base.chunks(spark, d), read(spark, d, "labels"))
    counts = [t.agg(F.count("*").alias(n)) for t, n in zip(left, ("documents", "chunks", "labels"), strict=True)]
    return counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True))  # one row each


@query("b01_document_page", "SELECT doc_id, n_chars, t.total, CAST(greatest(1, ceil(t.total / 20.0)) AS BIGINT) AS total_pages FROM documents, (SELECT count(*) AS total FROM documents) t ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def document_page(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars")
    return library.page(rows, [F.col("n_chars").desc(), F.col("doc_id")], 2, 20)


@query("b02_newest_runs", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25")
def newest_runs(spark, d):
    return library.newest(read(spark, d, "events").select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 25)


@query("b03_sessions", "SELECT conv_id, count(*) AS n_messages, substring(arg_min(text, turn) FILTER (role = 'user'), 1, 120) AS preview, max(turn) AS last_turn FROM conversations GROUP BY 1")
def sessions(spark, d):
    return library.session_summaries(read(spark, d, "conversations"))


@query("b04_blank_sessions", "SELECT * FROM (SELECT unnest(range(0, (SELECT max(conv_id) + 1 FROM conversations))) AS conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM conversations)")
def blank_sessions(spark, d):
    """Sessions are the ids from 0 to the largest that has messages."""
    rows = read(spark, d, "conversations")
    last = rows.agg(F.max("conv_id")).first()[0]
    return library.blank_sessions(spark.range(0 if last is None else last + 1).select(F.col("id").alias("conv_id")), rows)


@query("b05_audit", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_at FROM events GROUP BY 1")
def audit(spark, d):
    return library.audit_counts(read(spark, d, "events"))


@query("b06_resume_action", f"WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'skip' WHEN coalesce(n.n, 0) > 0 THEN 'embed' ELSE 'parse' END AS next_step FROM documents d LEFT JOIN n USING (doc_id)")
def resume_action(spark, d):
    n = base.chunks(spark, d).filter("doc_id % 3 <> 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ready").otherwise("chunking").alias("status"))
    return docs.join(n, "doc_id", "left").select("doc_id", library.next_action(F.col("status"), F.coalesce("n", F.lit(0))).alias("next_step"))


@query("b07_token_validity", "SELECT event_id, event_type <> 'click' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 00:00:00' AS valid, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS issued FROM events")
def token_validity(spark, d):
    used = F.when(F.col("event_type") == "click", F.col("ts"))
    return read(spark, d, "events").select("event_id", library.token_valid(used, F.expr("ts + interval 1 hour"), F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("valid"), library.iso_utc(F.col("ts")).alias("issued"))


@query("s10_ingest_stream", f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(token_count) AS tokens FROM chunks")
def ingest_stream(spark, d):
    """Streams documents' files into collections twice: the second run finds nothing to do."""
    from ..streaming import ingest

    path = new_folder(spark, "ingest")
    read(spark, d, "documents").repartition(3, "doc_id").write.parquet(f"{path}/in")
    sink = ingest.Ingest(spark, f"{path}/index")
    for _ in range(2):
        sink.stream(ingest.read_documents(spark, f"{path}/in", 1), f"{path}/checkpoint").awaitTermination()
    return sink.chunks.table().agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("token_count").alias("tokens"))
