"""Shared inputs of the registered queries, as DataFrames and as DuckDB SQL for their oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shipping import ship
from ..functions.workspace import written
from ..operators import chunking

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """The same rows as a common table expression; columns as in Spark's schema strings."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    fields = [c.split(" ") for c in columns.split(", ")]
    select = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
    return f"{name} AS (SELECT {select} FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({', '.join(n for n, _ in fields)}))"


class Mixed:
    """Odd rows and rows of the given tables as one input: a DataFrame, and a common table expression for the oracle.

    select gives the table rows; tables are named in braces, and its words mean the same to Spark and to DuckDB.
    """

    def __init__(self, name: str, columns: str, odd: list[tuple], select: str):
        self.columns, self.odd, self.select = columns, odd, select
        self.cte = f"{values(f'{name}_odd', columns, odd)}, {name} AS (SELECT * FROM {name}_odd UNION ALL {select.replace('{', '').replace('}', '')})"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: read(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", self.select))}
        return fixture(spark, self.columns, self.odd).union(spark.sql(self.select, **tables))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return chunking.chunks(docs.select("doc_id", "text"), "fixed")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks, written once for queries that read them several times."""
    return written(chunks(spark, sf_dir), "chunks")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-pages of documents: forty lines each."""
    from ..sources import uploads

    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
    return uploads.group_paragraphs(lines)


def words_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def content_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9\\-]*'), lambda w: NOT list_contains({literal(T.CONTENT_STOPWORDS)}, w))"


def sentences_sql(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


CHUNKS = r"""
 chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS char_start, CAST(s + length(text) AS INTEGER) AS char_end, text,
         substring(sha256(doc_id || ':' || s || ':' || (s + length(text))), 1, 32) AS chunk_id, substring(sha256(text), 1, 32) AS content_hash,
         CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + 2 END AS INTEGER) AS token_count, 1 AS page_number
  FROM (SELECT doc_id, s, substring(text, CAST(s + 1 AS BIGINT), 500) AS text
        FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) AS s FROM documents WHERE length(text) > 0))
  WHERE regexp_matches(text, '\S'))"""

PAGES = r"""
 lines AS (SELECT doc_id, i AS position, regexp_replace(l, '^\s+|\s+$', '', 'g') AS text
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
 numbered AS (SELECT doc_id, text, position, (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1) // 40 + 1 AS page_number FROM lines WHERE text <> ''),
 pages AS (SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM numbered GROUP BY 1, 2)"""

SPANS = r"""
 spans AS (SELECT doc_id, page_number, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS span_start FROM pages),
 joined AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM spans GROUP BY 1)"""

BM25 = rf"""
 words AS (SELECT chunk_id, {words_sql('text')} AS w FROM chunks),
 posted AS (SELECT chunk_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM words) GROUP BY ALL),
 totals AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM words),
 raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posted, totals GROUP BY term, n),
 idfs AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT sum(idf) / count(*) * 0.25 FROM raw) ELSE idf END AS idf FROM raw),
 asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words_sql('text')}) AS term FROM questions) GROUP BY ALL),
 bm25_all AS (SELECT query_id, chunk_id, round(CAST(sum(CAST(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS DECIMAL(24, 10))) AS DOUBLE), 6) AS score
              FROM posted JOIN asked USING (term) JOIN idfs USING (term), totals GROUP BY ALL),
 bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS bm25_rank FROM bm25_all QUALIFY bm25_rank <= 50)"""

_BUCKET = "((" + " + ".join(["CAST('0x' || substring(md5(token), 1, 2) AS INTEGER)"] + [f"256 * CAST('0x' || substring(md5(token), {i}, 2) AS INTEGER)" for i in range(3, 17, 2)]) + ") % 384)"


def vectors_sql(name: str, source: str, key: str) -> str:
    return f"""
 {name}_tokens AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({words_sql('text')}) AS token FROM {source}) GROUP BY ALL),
 {name}_tf AS (SELECT {key}, {_BUCKET} AS bucket, CAST(sum(n) AS BIGINT) AS tf FROM {name}_tokens GROUP BY ALL),
 {name} AS (SELECT {key}, bucket, tf, CAST(sum(tf * tf) OVER (PARTITION BY {key}) AS BIGINT) AS norm2 FROM {name}_tf)"""


DENSE = f"""{vectors_sql('cvec', 'chunks', 'chunk_id')},{vectors_sql('qvec', 'questions', 'query_id')},
 dense_all AS (SELECT q.query_id, c.chunk_id, round(sum(c.tf * q.tf) / sqrt(CAST(any_value(c.norm2) AS DOUBLE) * any_value(q.norm2)), 9) AS score
               FROM cvec c JOIN qvec q USING (bucket) GROUP BY ALL),
 dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dense_rank FROM dense_all QUALIFY dense_rank <= 50)"""

QUESTIONS = " questions AS (SELECT item_id AS query_id, text FROM benchmark)"

FUSED = """
 fused AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, dense_rank, bm25_rank,
                  coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS fused_score
           FROM dense d FULL JOIN bm25 b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
 hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS place FROM fused QUALIFY place <= 50)"""

SEARCH = f"WITH {QUESTIONS},{CHUNKS},{BM25},{DENSE},{FUSED}"
RERANKED = f""",
 shared AS (SELECT h.query_id, h.chunk_id, h.place, h.fused_score, CAST(len(list_intersect(list_distinct({content_sql('q.text')}), list_distinct({content_sql('c.text')}))) AS DOUBLE) AS reranker_score
            FROM hybrid h JOIN chunks c USING (chunk_id) JOIN questions q ON q.query_id = h.query_id),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, place) AS INTEGER) AS rank FROM shared QUALIFY rank <= 8)"""
