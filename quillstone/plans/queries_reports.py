"""Evaluation, regression gates, latency and cost reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.workspace import written
from ..operators import agent, evaluate, retrieval, verify
from ..operators import telemetry as M
from . import base
from .base import CHUNKS, RERANKED, SEARCH, content_sql, literal, query, values
from .queries_answer import _EXTRACT, _MULTI, _multi, ranked


def _snippets(spark, d):
    """Each benchmark text in as many snippets of nearly the same length, 120 characters at most, as hold all of it."""
    rows = base.read(spark, d, "benchmark").filter("length(text) > 0").withColumn("n", F.ceil(F.length("text") / 120).cast("int"))
    rows = rows.withColumn("width", F.ceil(F.length("text") / F.col("n")).cast("int")).withColumn("snippet_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(F.col("item_id").alias("query_id"), "snippet_id", F.substring("text", F.col("snippet_id") * F.col("width") + 1, F.col("width")).alias("text")).filter("trim(text) <> ''")


def _truth(spark, d, rows=None):
    """rows: stored chunks; they are read twice."""
    return evaluate.ground_truth(_snippets(spark, d), base.stored_chunks(spark, d) if rows is None else rows)


_BODY = "trim(regexp_replace(c.text, '\\s+', ' ', 'g'))"
_TRUTH = f""" snips AS (SELECT query_id, snippet_id, trim(regexp_replace(substring(text, snippet_id * width + 1, width), '\\s+', ' ', 'g')) AS snippet FROM (
   SELECT query_id, text, width, unnest(range(0, n)) AS snippet_id FROM (SELECT item_id AS query_id, text, CAST(ceil(length(text) / 120) AS BIGINT) AS n, CAST(ceil(length(text) / ceil(length(text) / 120)) AS BIGINT) AS width FROM benchmark WHERE length(text) > 0))),
 held AS (SELECT DISTINCT s.query_id, s.snippet_id, c.chunk_id FROM snips s JOIN chunks c ON contains({_BODY}, s.snippet) WHERE s.snippet <> ''),
 truth AS (SELECT DISTINCT query_id, chunk_id FROM held)"""


@query("v01_ground_truth", f"WITH {CHUNKS},{_TRUTH} SELECT query_id, CAST(snippet_id AS INTEGER) AS snippet_id, chunk_id FROM held")
def ground_truth(spark, d):
    return _truth(spark, d)


@query("v01_unmatched", f"WITH {CHUNKS},{_TRUTH} SELECT query_id, CAST(snippet_id AS INTEGER) AS snippet_id FROM snips WHERE snippet <> '' AND (query_id, snippet_id) NOT IN (SELECT (query_id, snippet_id) FROM held)")
def unmatched(spark, d):
    return evaluate.unmatched(_snippets(spark, d), _truth(spark, d))


_PER = f""",{_TRUTH},
 firsts AS (SELECT query_id, min(rank) AS first, count(*) AS n FROM ranked JOIN truth USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1),
 per AS (SELECT q.query_id, CASE WHEN q.query_id % 3 = 0 THEN 'identifier' WHEN q.query_id % 3 = 1 THEN 'general' ELSE 'multi_hop' END AS category, f.first AS first_rank, CASE WHEN f.first <= 5 THEN 1.0 ELSE 0.0 END AS recall_at_k,
   CASE WHEN f.first <= 1 THEN 1.0 ELSE 0.0 END AS recall_at_1, round(coalesce(1 / f.first, 0), 4) AS reciprocal_rank, round(coalesce(f.n, 0) / 5, 4) AS precision_at_k FROM questions q LEFT JOIN firsts f USING (query_id))"""


def _categories(spark, d):
    kind = F.when(F.col("query_id") % 3 == 0, "identifier").when(F.col("query_id") % 3 == 1, "general").otherwise("multi_hop")
    return base.questions(spark, d).withColumn("category", kind)


def _per(spark, d):
    rows = base.stored_chunks(spark, d)
    return evaluate.retrieval_metrics(_categories(spark, d), ranked(spark, d, rows=rows), _truth(spark, d, rows), 5)


@query("v02_retrieval_metrics", SEARCH + RERANKED + _PER + " SELECT * FROM per")
def retrieval_metrics(spark, d):
    return _per(spark, d)


@query("v03_summary", SEARCH + RERANKED + _PER + " SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(recall_at_k), 4) AS recall_at_k, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(precision_at_k), 4) AS precision_at_k FROM per GROUP BY GROUPING SETS ((), (category))")
def summary(spark, d):
    return evaluate.summarise(_per(spark, d), ["recall_at_k", "reciprocal_rank", "precision_at_k"])


_MODES = f""",{_TRUTH}, modes AS (SELECT query_id, chunk_id, dense_rank AS rank, 'dense' AS mode FROM dense UNION ALL SELECT query_id, chunk_id, place, 'hybrid' FROM hybrid UNION ALL SELECT query_id, chunk_id, rank, 'rerank' FROM ranked),
 rr AS (SELECT q.query_id, m.mode, round(coalesce(1 / min(x.rank), 0), 4) AS rr FROM questions q CROSS JOIN (VALUES ('dense'), ('hybrid'), ('rerank')) m(mode) LEFT JOIN (SELECT * FROM modes JOIN truth USING (query_id, chunk_id) WHERE rank <= 5) x ON x.query_id = q.query_id AND x.mode = m.mode GROUP BY ALL),
 wide AS (SELECT query_id, max(rr) FILTER (mode = 'dense') AS dense, max(rr) FILTER (mode = 'hybrid') AS hybrid, max(rr) FILTER (mode = 'rerank') AS rerank FROM rr GROUP BY 1) SELECT *, round(rerank - dense, 4) AS movement, rerank < hybrid AS regressed FROM wide"""


@query("v04_compare_modes", SEARCH + RERANKED + _MODES)
def compare_modes(spark, d):
    q, c = base.questions(spark, d), base.stored_chunks(spark, d)
    truth = _truth(spark, d, c)
    dense = written(retrieval.dense_top(q, c, 50), "dense")
    fused = written(retrieval.rrf_fuse(dense, retrieval.bm25_top(q, c, 50), 50), "fused")
    hybrid = written(retrieval.hydrate(fused, c, "text"), "hybrid")
    modes = [("dense", dense.withColumn("rank", F.col("dense_rank"))), ("hybrid", hybrid.withColumn("rank", F.col("place"))), ("rerank", retrieval.lexical_rerank(hybrid, q, 8))]
    per = None
    for name, hits in modes:
        one = evaluate.retrieval_metrics(q, hits.select("query_id", "chunk_id", "rank"), truth, 5).select("query_id", F.lit(name).alias("mode"), "reciprocal_rank")
        per = one if per is None else per.unionByName(one)
    return evaluate.compare_modes(per)


_CONTEXT = f""",{_TRUTH}, marked AS (SELECT r.query_id, r.rank, CASE WHEN t.chunk_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN truth t USING (query_id, chunk_id)),
 run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM marked),
 cp AS (SELECT query_id, round(avg(p) FILTER (hit = 1), 4) AS p, sum(hit) AS met FROM run GROUP BY 1),
 ex AS (SELECT query_id, count(*) AS expected FROM truth GROUP BY 1),
 ctx AS (SELECT q.query_id, coalesce(cp.p, 0) AS context_precision, round(coalesce(cp.met / ex.expected, 0), 4) AS context_recall FROM questions q LEFT JOIN cp USING (query_id) LEFT JOIN ex USING (query_id))"""


@query("v05_context_metrics", SEARCH + RERANKED + _CONTEXT + " SELECT * FROM ctx")
def context_metrics(spark, d):
    rows = base.stored_chunks(spark, d)
    return evaluate.context_metrics(base.questions(spark, d), ranked(spark, d, rows=rows), _truth(spark, d, rows))


def _answers(spark, d):
    """(query_id, answer, faithfulness, answer_relevancy, answer_correctness, context_precision, context_recall, failure_class)"""
    q, rows = base.questions(spark, d), base.stored_chunks(spark, d)
    sources, truth = ranked(spark, d, rows=rows), _truth(spark, d, rows)
    words = sources.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(T.content_words(F.col("text"))))).alias("words"))
    reference = F.when(F.col("query_id") % 2 == 0, F.col("text"))
    rows = evaluate.extractive_answers(q, sources).join(q, "query_id").join(words, "query_id", "left").join(evaluate.context_metrics(q, sources, truth), "query_id")
    rows = rows.withColumns({"faithfulness": evaluate.faithfulness(F.col("answer"), F.coalesce("words", F.array().cast("array<string>"))), "answer_relevancy": evaluate.relevancy(F.col("text"), F.col("answer")), "answer_correctness": evaluate.correctness(F.col("answer"), reference)})
    return rows.withColumn("failure_class", evaluate.failure_class(F.col("context_recall"), verify.abstains(F.col("answer")), F.col("faithfulness"), F.col("answer_relevancy")))


_ANSWERS = _CONTEXT + "," + _EXTRACT + f""", cw AS (SELECT r.query_id, list_distinct(flatten(list({content_sql('c.text')}))) AS words FROM ranked r JOIN chunks c USING (chunk_id) GROUP BY 1),
 aw AS (SELECT e.query_id, {content_sql('e.answer')} AS a, list_distinct({content_sql('q.text')}) AS q, coalesce(w.words, []) AS words, CASE WHEN e.query_id % 2 = 0 THEN list_distinct({content_sql('q.text')}) END AS ref FROM extracted e JOIN questions q USING (query_id) LEFT JOIN cw w USING (query_id)),
 judged AS (SELECT query_id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_filter(a, lambda w: list_contains(words, w))) / len(a), 4) END AS faithfulness, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, a)) / len(q), 4) END AS answer_relevancy,
   CASE WHEN ref IS NULL THEN NULL WHEN len(list_intersect(list_distinct(a), ref)) = 0 THEN 0 ELSE round(2.0 * (len(list_intersect(list_distinct(a), ref)) / len(list_distinct(a))) * (len(list_intersect(list_distinct(a), ref)) / len(ref)) / (len(list_intersect(list_distinct(a), ref)) / len(list_distinct(a)) + len(list_intersect(list_distinct(a), ref)) / len(ref)), 4) END AS answer_correctness FROM aw),
 final AS (SELECT j.*, c.context_precision, c.context_recall, CASE WHEN c.context_recall = 0 THEN 'retrieval_miss' WHEN j.faithfulness < 0.55 THEN 'hallucination' WHEN j.answer_relevancy < 0.3 THEN 'off_topic' WHEN j.answer_relevancy < 0.5 THEN 'partial_answer' ELSE 'ok' END AS failure_class FROM judged j JOIN ctx c USING (query_id))"""


@query("v06_answer_metrics", SEARCH + RERANKED + _ANSWERS + " SELECT query_id, faithfulness, answer_relevancy, answer_correctness FROM final")
def answer_metrics(spark, d):
    return _answers(spark, d).select("query_id", "faithfulness", "answer_relevancy", "answer_correctness")


OUTCOMES = [(1, 0.0, True, 0.0, 0.0), (2, 1.0, True, 0.9, 0.9), (3, 1.0, False, 0.5, 0.9), (4, 0.5, False, 0.55, 0.29), (5, 1.0, False, 0.9, 0.49), (6, 1.0, False, 0.55, 0.5), (7, 0.2, False, 0.1, 0.1)]
_OUT = "id int, recall double, abstained boolean, faithful double, relevant double"


ENDED = base.Mixed("o", _OUT, OUTCOMES, "SELECT CAST(1000 + doc_id AS INT) AS id, CAST(doc_id % 3 AS DOUBLE) / 2, doc_id % 5 = 0, CAST(doc_id % 21 AS DOUBLE) / 20, CAST(doc_id % 11 AS DOUBLE) / 10 FROM {documents}")


@query("v07_failure_class", f"WITH {ENDED.cte} SELECT id, CASE WHEN recall = 0 THEN 'retrieval_miss' WHEN abstained THEN 'over_refusal' WHEN faithful < 0.55 THEN 'hallucination' WHEN relevant < 0.3 THEN 'off_topic' WHEN relevant < 0.5 THEN 'partial_answer' ELSE 'ok' END AS failure_class, CASE WHEN recall = 0 THEN 'retrieval_miss' WHEN abstained THEN 'over_refusal' WHEN faithful < 0.85 THEN 'hallucination' WHEN relevant < 0.4 THEN 'off_topic' WHEN relevant < 0.7 THEN 'partial_answer' ELSE 'ok' END AS neural FROM o")
def failure_class(spark, d):
    c = [F.col(x) for x in ("recall", "abstained", "faithful", "relevant")]
    return ENDED.frame(spark, d).select("id", evaluate.failure_class(*c).alias("failure_class"), evaluate.failure_class(*c, evaluate.FLOORS_NEURAL).alias("neural"))


@query("v08_failure_breakdown", SEARCH + RERANKED + _ANSWERS + f" SELECT k.c AS failure_class, count(f.query_id) AS n, round(count(f.query_id) / (SELECT greatest(count(*), 1) FROM final), 4) AS rate FROM (SELECT unnest({literal(evaluate.FAILURES)}) AS c) k LEFT JOIN final f ON f.failure_class = k.c GROUP BY 1")
def failure_breakdown(spark, d):
    return evaluate.failure_breakdown(_answers(spark, d))


_BOUNDS = [(k, v, "floor") for k, v in evaluate.GATE_FLOORS.items()] + [(k, v, "ceiling") for k, v in evaluate.GATE_CEILINGS.items()]
_GATE = f""", vals AS (SELECT 'faithfulness' AS name, round(avg(faithfulness), 4) AS value FROM final UNION ALL SELECT 'answer_relevancy', round(avg(answer_relevancy), 4) FROM final UNION ALL SELECT 'context_precision', round(avg(context_precision), 4) FROM final
   UNION ALL SELECT failure_class, round(count(*) / (SELECT count(*) FROM final), 4) FROM final GROUP BY 1), {values('bounds', 'check_name string, bound double, kind string', _BOUNDS)}
 SELECT b.check_name AS "check", v.value, b.bound, b.kind, CASE WHEN b.kind = 'floor' THEN coalesce(v.value >= b.bound, false) ELSE coalesce(v.value, 0) <= b.bound END AS passed FROM bounds b LEFT JOIN vals v ON v.name = b.check_name"""


@query("v09_gate", SEARCH + RERANKED + _ANSWERS + _GATE)
def gate(spark, d):
    rows = _answers(spark, d).persist()
    means = rows.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("faithfulness", "answer_relevancy", "context_precision")])
    named = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in means.columns])).alias("r")).select("r.*")
    rates = evaluate.failure_breakdown(rows).filter("n > 0").select(F.col("failure_class").alias("name"), F.col("rate").alias("value"))
    return evaluate.gate(named.unionByName(rates))


_SWEEP = _MULTI.replace("WHERE bm25_rank <= 5", "WHERE bm25_rank <= 5") + f""",{_TRUTH}, ks AS (SELECT unnest([1, 2, 3, 5]) AS k),
 ag AS (SELECT k.k, f.qid, count(DISTINCT t.chunk_id) AS met FROM ks k JOIN found f ON f.rank <= k.k JOIN truth t ON t.query_id = f.qid AND t.chunk_id = f.chunk_id GROUP BY ALL),
 ex AS (SELECT query_id AS qid, count(*) AS n FROM truth GROUP BY 1)
 SELECT CAST(k.k AS INTEGER) AS k, round(avg(coalesce(a.met, 0) / e.n), 4) AS agent_recall FROM ks k CROSS JOIN ex e LEFT JOIN ag a ON a.k = k.k AND a.qid = e.qid GROUP BY k.k"""


@query("v10_budget_sweep", _SWEEP)
def budget_sweep(spark, d):
    asked, rows = base.questions(spark, d), base.stored_chunks(spark, d)
    truth = _truth(spark, d, rows).select("query_id", "chunk_id").distinct()
    steps = agent.offline_plan(asked).withColumn("step_id", F.concat_ws("#", "query_id", "step"))
    hits = retrieval.bm25_top(steps.select(F.col("step_id").alias("query_id"), "text"), rows, 5).select(F.col("query_id").alias("step_id"), "chunk_id", "bm25_rank")
    found = hits.join(steps.select("step_id", "query_id"), "step_id")
    met = found.join(truth, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.explode(F.filter(F.array(*map(F.lit, (1, 2, 3, 5))), lambda k: k >= F.col("bm25_rank"))).alias("k")).groupBy("query_id", "k").agg(F.countDistinct("chunk_id").alias("met"))
    expected = truth.groupBy("query_id").agg(F.count("*").alias("n")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("k"))
    return expected.join(met, ["query_id", "k"], "left").groupBy("k").agg(F.round(F.avg(F.coalesce("met", F.lit(0)) / F.col("n")), 4).alias("agent_recall"))


@query("v10_agent_gain", _MULTI + f",{_TRUTH}, ex AS (SELECT query_id AS qid, count(*) AS n FROM truth GROUP BY 1), m AS (SELECT k.qid, count(*) AS met FROM kept k JOIN truth t ON t.query_id = k.qid AND t.chunk_id = k.chunk_id GROUP BY 1) SELECT e.qid AS query_id, round(coalesce(m.met, 0) / e.n, 4) AS agent_recall FROM ex e LEFT JOIN m USING (qid)")
def agent_gain(spark, d):
    rows = base.stored_chunks(spark, d)
    return _gain(_multi(spark, d, rows=rows)[1], _truth(spark, d, rows))


def _gain(gathered, truth):
    truth = truth.select("query_id", "chunk_id").distinct()
    met = gathered.join(truth, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("met"))
    return truth.groupBy("query_id").agg(F.count("*").alias("n")).join(met, "query_id", "left").select("query_id", F.round(F.coalesce("met", F.lit(0)) / F.col("n"), 4).alias("agent_recall"))


OURS = [("faithfulness", 0.91), ("answer_relevancy", 0.80), ("context_recall", None), ("context_precision", 0.4321)]
THEIRS = [("faithfulness", 0.4607), ("answer_relevancy", 0.85), ("context_recall", 0.5), ("other", 1.0)]


# beside the odd ones, thousands of documents of each source, and of these in one language
OURS_ROWS = base.Mixed("o", "name string, value double", OURS, "SELECT source, CAST(count(*) AS DOUBLE) / 1000 FROM {documents} WHERE source IS NOT NULL GROUP BY source")
THEIRS_ROWS = base.Mixed("t", "name string, value double", THEIRS, "SELECT source, CAST(count(*) AS DOUBLE) / 1000 FROM {documents} WHERE source IS NOT NULL AND lang = 'en' GROUP BY source")


@query("v11_deltas", f"WITH {OURS_ROWS.cte}, {THEIRS_ROWS.cte}, b AS (SELECT o.name, o.value AS ours, t.value AS theirs, round(abs(o.value - t.value), 4) AS delta FROM o JOIN t USING (name) WHERE o.value IS NOT NULL AND t.value IS NOT NULL) SELECT *, max(delta) OVER () AS max_delta FROM b")
def deltas(spark, d):
    return evaluate.deltas(OURS_ROWS.frame(spark, d), THEIRS_ROWS.frame(spark, d))


def _steps(spark, d):
    """Events as steps of runs: the type is the stage, the value its duration."""
    return base.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"), "ts", "event_id")


_RANK = "CAST(greatest(1, least(count(*) OVER k, round_even({p} / 100.0 * count(*) OVER k + 0.5, 0))) AS BIGINT)"


def _percentiles(keys: str, percents=(50, 95), source="events", value="value") -> str:
    marks = ", ".join(f"{_RANK.replace('{p}', str(p))} AS k{p}" for p in percents)
    picks = ", ".join(f"max(v) FILTER (n = k{p}) AS p{p}" for p in percents)
    return f"SELECT {keys}, {picks} FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS n, {marks} FROM {source} WHERE {value} IS NOT NULL WINDOW k AS (PARTITION BY {keys})) GROUP BY {keys}"


@query("v12_nearest_rank", _percentiles("event_type", (1, 50, 90, 95, 99)))
def nearest_rank(spark, d):
    return M.nearest_rank(base.read(spark, d, "events"), ["event_type"], "value", [1, 50, 90, 95, 99])


SMALL = [(g, float(i)) for g in (1, 2, 4, 6, 10, 11) for i in range(1, g + 1)]


SMALL_ROWS = base.Mixed("s", "g int, v0 double", SMALL, "SELECT CAST(1000 + user_id AS INT) AS g, value FROM {events}")


@query("v12_nearest_rank_small", f"WITH {SMALL_ROWS.cte} " + _percentiles("g", (50, 95), "s", "v0"))
def nearest_rank_small(spark, d):
    return M.nearest_rank(SMALL_ROWS.frame(spark, d).withColumnRenamed("v0", "v"), ["g"], "v", [50, 95])


@query("v13_stage_latency", f"WITH r AS ({_percentiles('event_type')}), b AS (SELECT e.event_type AS stage, count(*) AS n, round(any_value(r.p50), 1) AS p50, round(any_value(r.p95), 1) AS p95, round(max(value), 1) AS max FROM events e JOIN r USING (event_type) GROUP BY 1) SELECT *, round(100 * p50 / CASE WHEN sum(p50) OVER () = 0 THEN 1 ELSE sum(p50) OVER () END, 1) AS share FROM b")
def stage_latency(spark, d):
    return M.stage_latency(_steps(spark, d))


MODELS = ["gemini-2.5-flash", "gemini-2.5-flash-lite-0925", "gpt-4o-mini", "stub-1", "unknown-model", "deepseek-chat", "gemini-2.5-flash-lite"]


def _calls(spark, d):
    names = F.array(*[F.lit(m) for m in MODELS])
    return base.read(spark, d, "events").select(F.col("event_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.get(names, (F.col("event_id") % len(MODELS)).cast("int")).alias("model"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5000).alias("input_tokens"), (F.col("event_id") % 700).alias("output_tokens"), F.col("value").alias("ms"))


_CALLS = f""" calls AS (SELECT event_id, user_id AS run_id, event_type AS stage, {literal(MODELS)}[event_id % {len(MODELS)} + 1] AS model, CASE WHEN event_id % 11 <> 0 THEN event_id % 5000 END AS input_tokens, event_id % 700 AS output_tokens, value AS ms FROM events),
 {values('prices', 'entry string, price_in double, price_out double', [(m, float(a), float(b)) for m, (a, b) in M.PRICES.items()])},
 best AS (SELECT model, arg_max(entry, length(entry)) AS entry FROM (SELECT DISTINCT model FROM calls) m JOIN prices ON starts_with(model, entry) GROUP BY 1),
 priced AS (SELECT c.*, b.entry, round(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out, 8) AS cost_usd, round(round(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out, 8) * 83, 6) AS cost_inr FROM calls c LEFT JOIN best b USING (model) LEFT JOIN prices p ON p.entry = b.entry)"""


@query("v15_pricing", f"WITH {_CALLS} SELECT event_id, model, entry, cost_usd, cost_inr FROM priced")
def pricing(spark, d):
    return M.priced(_calls(spark, d)).select("event_id", "model", "entry", "cost_usd", "cost_inr")


def _report_sql(key: str) -> str:
    return f"WITH {_CALLS} SELECT {key}, count(*) AS calls, count(cost_inr) AS priced, count(*) FILTER (cost_inr = 0) AS free, round(avg(input_tokens), 2) AS avg_input, round(avg(output_tokens), 2) AS avg_output, round(avg(cost_inr), 6) AS avg_cost_inr FROM priced GROUP BY 1"


@query("v14_cost_by_model", _report_sql("model"))
def cost_by_model(spark, d):
    return M.cost_report(M.priced(_calls(spark, d)), "model")


@query("v14_cost_by_stage", _report_sql("stage"))
def cost_by_stage(spark, d):
    return M.cost_report(M.priced(_calls(spark, d)), "stage")


@query("v16_benchmark", f"WITH r AS ({_percentiles('event_type', (95,))}) SELECT e.event_type, count(*) AS n, round(median(value), 1) AS p50, round(avg(value), 1) AS mean, round(any_value(r.p95), 1) AS p95 FROM events e JOIN r USING (event_type) GROUP BY 1")
def benchmark(spark, d):
    return M.benchmark_summary(base.read(spark, d, "events").select("event_type", F.col("value").alias("ms")), "event_type")


@query("v17_answer_shape", "SELECT role, count(*) AS n, round(avg(CAST(regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' [1]' ELSE '' END, '\\[\\d+\\]') AS INTEGER)), 4) AS citation_rate, round(avg(length(text || CASE WHEN turn % 3 = 0 THEN ' [1]' ELSE '' END)), 1) AS avg_chars FROM conversations GROUP BY 1")
def answer_shape(spark, d):
    rows = base.read(spark, d, "conversations").select("role", F.concat("text", F.when(F.col("turn") % 3 == 0, " [1]").otherwise("")).alias("answer"))
    return M.answer_shape(rows, "role")


@query("v18_run_totals", f"WITH {_CALLS} SELECT run_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, round(sum(cost_usd), 8) AS cost_usd, round(sum(cost_inr), 6) AS cost_inr FROM priced GROUP BY 1")
def run_totals(spark, d):
    return M.run_totals(M.priced(_calls(spark, d)), "run_id")


@query("v19_hashed_users", "SELECT DISTINCT user_id, substring(sha256('salt:' || user_id), 1, 16) AS hashed FROM events")
def hashed_users(spark, d):
    return base.read(spark, d, "events").select("user_id").distinct().select("user_id", M.hashed_user(F.col("user_id"), "salt").alias("hashed"))


