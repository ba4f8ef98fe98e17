"""The registered queries opN_<name>: thin digests of the operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, language_id, license_scan, lm_score, mixing, near_dedup, nn_descent, packing, secret_scan, spelling, token_codec, url_filter
from .common import Scratch
from .tokenizing import default_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_score.fit(lm_score.labelled_target(docs, read(spark, sf_dir, "labels")), F.col("is_target"))
    return lm_score.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "target_loss", "background_loss", "score")


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.content_sort(read(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'ids').base}/files"
    token_codec.write_ids(read(spark, sf_dir, "documents"), path, default_path("byte_bpe_50k.json"))
    return token_codec.read_ids(spark, path, with_ids=False).drop("crc_written")


def op4_segment_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~F.coalesce(language_id.held_out_fold(F.col("doc_id")), F.lit(False))), default_path("piece_bpe_32k.model"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    fold = F.coalesce(language_id.held_out_fold(F.col("row.doc_id")), F.lit(False))
    return found.select(F.col("row.doc_id").alias("doc_id"), fold.alias("held_out"), "lang_pred", "score")


def op5_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), default_path("byte_bpe_50k.json"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


def op7_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nn_descent.search(nn_descent.build(rows), rows.filter("vec_id % 50 = 0"), 5)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), 2048)


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    examples = F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_examples")
    return found.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in ("assign", "access", "hex")], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), examples)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_cross_entropy, op2_content_sort, op3_huffman_ids, op4_segment_unigrams, op5_host_words, op6_mix_sources, op7_license_windows, op8_nn_descent, op9_best_fit, op10_setsketch, op11_filter_audit, op12_secret_owners, op13_spelling_variants)}

ORACLE_SQL = {
    "op2_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_mix_sources": r"""
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
          FROM documents),
        by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighted AS (
          SELECT *, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
                 CAST(source_size * 3 AS DOUBLE) AS cap
          FROM by_source),
        levels AS (
          SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                 sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
                 CAST(sum(source_size) OVER () AS DOUBLE) AS total
          FROM weighted),
        goals AS (
          SELECT source, source_size, least(weight * max((total - caps) / left_weight) OVER (), cap) AS target FROM levels),
        placed AS (
          SELECT s.doc_id, s.size, g.source_size, g.target,
                 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                 CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS epochs
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
        FROM placed""",
    "op11_filter_audit": r"""
        WITH RECURSIVE texts AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        failed AS (
          SELECT doc_id, part,
                 CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
          FROM texts),
        said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
        classes AS (
          SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
          FROM failed LEFT JOIN said USING (doc_id) GROUP BY 1, 2),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
          SELECT l AS filter_order FROM letters
          UNION ALL
          SELECT filter_order || l FROM orders, letters WHERE NOT contains(filter_order, l)),
        steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders WHERE length(filter_order) = 5),
        met AS (
          SELECT part, filter_order, step, substring(filter_order, step, 1) AS f, n, good, toxic, fails,
                 contains(fails, substring(filter_order, step, 1)) AS hit,
                 list_has_any(string_split(substring(filter_order, 1, step - 1), ''), string_split(fails, '')) AND fails <> '' AND step > 1 AS gone
          FROM classes, steps),
        counted AS (
          SELECT part, filter_order, step, f,
                 CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
                 CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = f), 0) AS BIGINT) AS unique_fails,
                 CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
          FROM met GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted""",
    "op12_secret_owners": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce('=' || doc_id, '') AS repo, coalesce(text, '') AS text FROM documents),
        cut AS (
          SELECT r, repo, owner, text, 0 AS kind, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+' AS p FROM docs
          UNION ALL SELECT r, repo, owner, text, 1, 'AKIA[A-Z0-9]+' FROM docs
          UNION ALL SELECT r, repo, owner, text, 2, '[0-9a-f]{24,}' FROM docs
          UNION ALL SELECT r, repo, owner, text, 3, '[A-Za-z0-9+/_=-]{20,}' FROM docs),
        split AS (SELECT r, repo, owner, kind, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS s FROM cut WHERE regexp_matches(text, p)),
        matches AS (
          SELECT r, repo, owner, kind, m[i] AS m, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM split)),
        spans AS (
          SELECT r, repo, owner, kind, a, a + length(m) AS b, sha256(v) AS v, kind = 3 AND len(list_distinct(string_split(v, ''))) >= 10 AS random
          FROM (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE m END AS v FROM matches)
          WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN true ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
        candidates AS (SELECT * FROM spans x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM spans y WHERE y.r = x.r AND y.kind < 3 AND y.a < x.b AND x.a < y.b)),
        owned AS (SELECT v, count(DISTINCT owner) > 2 OR count(DISTINCT repo) > 100 AS example, bool_or(kind < 2) AS known FROM candidates GROUP BY 1),
        kept AS (SELECT c.*, example, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS span FROM candidates c JOIN owned USING (v) WHERE kind < 3 OR (NOT example AND (known OR random))),
        listed AS (
          SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE example) AS n_examples,
                 string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans FROM kept GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_examples, 0) AS n_examples
        FROM docs LEFT JOIN listed USING (r)""",
    "op13_spelling_variants": r"""
        WITH RECURSIVE crc_table AS (
          SELECT list(c ORDER BY i) AS tab
          FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
        runs AS (
          SELECT doc_id, run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
          WHERE length(run) >= 5 GROUP BY 1, 2),
        bytes AS (
          SELECT run, n, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) AS b
          FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs)),
        hashed AS (
          SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
        words AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
        cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
          SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
        formed AS (
          SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
        chain AS (
          SELECT word, word AS root, form AS ahead FROM formed
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.ahead)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.ahead IS NULL""",
}
