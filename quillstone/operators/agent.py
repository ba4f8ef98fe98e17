"""Multi-hop retrieval: a planner's sub-questions run for all queries at once, tools with their rules, trajectories and their statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.workspace import written
from . import understanding

MAX_STEPS, TOP_K_CAP = 5, 20
TOOLS = {"retrieve_docs": ["query"], "fetch_document": ["doc_id"], "finish": []}


def collect_first(found: DataFrame) -> DataFrame:
    """(query_id, chunk_id, step, rank, seen): each chunk of a query once, where it was first met."""
    kept = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("step", "rank"))).filter("n = 1").drop("n")
    return kept.withColumn("seen", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "rank", "chunk_id")))


def clamp_k(k: Column, default: int = 8) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(k, F.lit(default)), F.lit(TOP_K_CAP)))


def offline_plan(queries: DataFrame, most: int | None = 3) -> DataFrame:
    """(query_id, step, text): of the first `most` sub-questions (None: all), one retrieval step each; no loop is needed, as the plan doesn't depend on what is found."""
    return queries.select("query_id", F.posexplode(understanding.sub_questions(F.col("text"), most)).alias("p", "text")).select("query_id", (F.col("p") + 1).alias("step"), "text")


def run_offline(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], most: int | None = 3) -> DataFrame:
    """Chunks gathered for each query by its plan; retrieve maps (query_id, text) to (query_id, chunk_id, rank)."""
    steps = offline_plan(queries, most).withColumn("step_id", F.concat_ws("#", "query_id", "step"))
    hits = retrieve(steps.select(F.col("step_id").alias("query_id"), "text"))
    found = hits.join(steps.select(F.col("step_id").alias("query_id"), F.col("query_id").alias("of"), "step"), "query_id").select(F.col("of").alias("query_id"), "step", "chunk_id", "rank")
    return collect_first(found)


def fallback(queries: DataFrame, gathered: DataFrame, plain: DataFrame) -> DataFrame:
    """Plain hits (query_id, chunk_id, rank) of the queries for which nothing was gathered."""
    return plain.join(queries.select("query_id").join(gathered, "query_id", "left_anti"), "query_id", "left_semi")


def trajectory(gathered: DataFrame, plan: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, steps, tool_calls, chunks_gathered, used_fallback)."""
    s = plan.groupBy("query_id").agg(F.count("*").alias("steps"))
    c = gathered.groupBy("query_id").agg(F.count("*").alias("chunks"))
    out = queries.select("query_id").join(s, "query_id", "left").join(c, "query_id", "left")
    return out.select("query_id", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("steps", F.lit(0)).alias("tool_calls"), F.coalesce("chunks", F.lit(0)).alias("chunks_gathered"), F.col("chunks").isNull().alias("used_fallback"))


def trajectory_stats(rows: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    mean = lambda c: F.round(F.sum(c) / F.greatest(F.count("*"), F.lit(1)), 3)
    return rows.agg(mean("steps").alias("avg_steps"), mean("tool_calls").alias("avg_tool_calls"), mean("chunks_gathered").alias("avg_chunks_gathered"), F.count_if(F.col("steps") > 1).alias("multi_hop_queries"), F.count_if(F.col("used_fallback")).alias("fallback_queries"), F.count_if(F.col("steps") >= most).alias("hit_max_steps"))


def parse_action(reply: str | None) -> dict | None:
    """The first JSON object in a planner's reply as {tool, args}, or None if there is none that names a tool.

    The tool is the value of tool, action or name, the first that is there; finish is known in any case. Without args, a flat object's other keys are
    the arguments; args that aren't an object make the reply unreadable. A reply that is JSON of another kind holds no action.
    """
    text = (reply or "").strip()
    reader, found = json.JSONDecoder(), None
    for place in re.finditer(r"\{", text):
        try:
            found, end = reader.raw_decode(text, place.start())
        except ValueError:
            continue
        if place.start() and text[0] in "[\"" and _is_json(text):
            return None
        break
    names = ("tool", "action", "name")
    tool = next((found[n] for n in names if found.get(n)), None) if found else None
    if not isinstance(tool, str):
        return None
    args = found["args"] if found.get("args") is not None else {k: v for k, v in found.items() if k not in (*names, "args")}
    if not isinstance(args, dict):
        return None
    tool = tool.strip()
    return {"tool": "finish" if tool.lower() == "finish" else tool, "args": args}


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def resolve_documents(requests: DataFrame, documents: DataFrame, shown: int = 10) -> DataFrame:
    """(query_id, target, note) for requests (query_id, doc_id, scope_id) to fetch a document of documents (doc_id).

    A known id is taken; else the id of the query's scope; else the only document, if there is one only; else the id as asked for, with a note that
    names the smallest valid ids, of which `shown` are listed. Ids are compared as strings.
    """
    ids = documents.select(F.col("doc_id").cast("string").alias("known")).filter("known is not null").distinct()
    # at least two, to tell one document from several
    first = [r["known"] for r in ids.orderBy(F.length("known"), "known").limit(max(shown, 2)).collect()]
    asked = requests.select("query_id", F.nullif(F.col("doc_id").cast("string"), F.lit("")).alias("asked"), F.nullif(F.col("scope_id").cast("string"), F.lit("")).alias("scope"))
    met = asked.join(ids, F.col("asked") == F.col("known"), "left")
    note = F.when(F.col("known").isNull() & F.col("scope").isNull() & F.lit(len(first) > 1), "unknown doc_id; valid ids: " + ", ".join(first[:shown]))
    only = F.lit(first[0] if len(first) == 1 else None).cast("string")
    return met.select("query_id", F.coalesce("known", "scope", only, "asked").alias("target"), note.alias("note"))


ACTION = "query_id {kind}, step int, tool string, args string, arguments map<string,string>, status string"
HISTORY = "step int, tool string, args string, status string, new bigint"


def _planned(planner: Callable[[str, list], str], step: int, tools: set[str], allowed: set[str] | None):
    """For open queries (query_id, text, history): what the planner's reply asks for, and what becomes of it before any tool is called."""

    def action(text: str, history: list[dict]) -> tuple:
        try:
            found = parse_action(planner(text, history))
        except Exception:
            return None, None, None, "planner_failed"
        if found is None:
            # a reply that can't be read ends the query on its first or second step
            return None, None, None, "unreadable_stop" if len(history) < 2 else "unreadable"
        tool, given = found["tool"], found["args"]
        args = json.dumps(given, sort_keys=True)
        arguments = {k: v if isinstance(v, str) else json.dumps(v) for k, v in given.items() if v is not None}
        if tool == "finish":
            status = "finish"
        elif tool not in tools or (allowed is not None and tool not in allowed):
            status = "unknown_tool"
        elif any(not given.get(a) for a in TOOLS.get(tool, [])):
            status = "missing_argument"
        elif any(h["status"] == "ok" and h["tool"] == tool and h["args"] == args for h in history):
            status = "repeated"
        else:
            status = "ok"
        return tool, args, arguments, status

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, step, *action(t, [dict(h.asDict() if hasattr(h, "asDict") else h) for h in ([] if hs is None else hs)])) for q, t, hs in zip(frame["query_id"], frame["text"], frame["history"], strict=True)]
            yield pd.DataFrame(rows, columns=["query_id", "step", "tool", "args", "arguments", "status"])

    return run


def run_loop(queries: DataFrame, planner: Callable[[str, list], str], tools: dict[str, Callable[[DataFrame], DataFrame]], steps: int = MAX_STEPS, allowed: set[str] | None = None) -> dict[str, DataFrame]:
    """The general loop over queries (query_id, text), whose state is tables: one step of all open queries at a time.

    planner(text, history) -> reply runs on the executors; history is a list of dicts (step, tool, args, status, new). A tool maps calls (query_id,
    arguments) to hits (query_id, item, rank) and can be any DataFrame job. A query ends on finish, a planner's failure, a reply that can't be read
    on its first or second step, a repeated call, a call that brings nothing new when there is evidence already, or after `steps`. Unknown,
    disallowed and incomplete calls are recorded and the query goes on. Returns the tables outcome (query_id, stop, steps, chunks; stop is null after
    `steps`), history (query_id and its fields) and collected (query_id, item, step, rank): each item of a query once, where it was first met.
    """
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    ship(spark)
    open_ = written(queries.select("query_id", "text").dropDuplicates(["query_id"]), "open")
    every = open_.select("query_id")
    history = spark.createDataFrame([], f"query_id {kind}, {HISTORY}")
    collected = spark.createDataFrame([], f"query_id {kind}, item string, step int, rank int")
    stopped = spark.createDataFrame([], f"query_id {kind}, stop string")
    fields = [c.split()[0] for c in HISTORY.split(", ")]
    for step in range(1, steps + 1):
        past = history.join(open_.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("history"))
        asked = open_.join(past, "query_id", "left").select("query_id", "text", "history")
        acts = written(asked.mapInPandas(_planned(planner, step, set(tools), allowed), ACTION.format(kind=kind)), "actions")
        hits = None
        for name in sorted(tools):
            calls = acts.filter((F.col("status") == "ok") & (F.col("tool") == name)).select("query_id", "arguments")
            if not calls.isEmpty():
                one = tools[name](calls).select("query_id", F.col("item").cast("string").alias("item"), F.lit(step).alias("step"), F.col("rank").cast("int").alias("rank"))
                hits = one if hits is None else hits.unionByName(one)
        met = spark.createDataFrame([], collected.schema) if hits is None else hits
        fresh = met.join(collected.select("query_id", "item"), ["query_id", "item"], "left_anti").groupBy("query_id", "item", "step").agg(F.min("rank").alias("rank"))
        fresh = written(fresh.select(*collected.columns), "fresh")
        new = fresh.groupBy("query_id").agg(F.count("*").alias("new"))
        had = collected.select("query_id").distinct().withColumn("had", F.lit(True))
        acts = acts.join(new, "query_id", "left").join(had, "query_id", "left")
        no_progress = (F.col("status") == "ok") & F.col("new").isNull() & F.coalesce("had", F.lit(False))
        stop = F.when(F.col("status").isin("finish", "planner_failed", "repeated"), F.col("status")).when(F.col("status") == "unreadable_stop", "unreadable").when(no_progress, "no_progress")
        acts = written(acts.withColumn("stop", stop), "acted")
        kept = acts.filter(~F.col("status").isin("finish", "planner_failed", "repeated"))
        status = F.when(F.col("status") == "unreadable_stop", "unreadable").otherwise(F.col("status"))
        history = written(history.unionByName(kept.select("query_id", "step", "tool", "args", status.alias("status"), F.when(F.col("status") == "ok", F.coalesce("new", F.lit(0))).alias("new"))), "history")
        collected = written(collected.unionByName(fresh), "collected")
        stopped = written(stopped.unionByName(acts.filter("stop is not null").select("query_id", "stop")), "stopped")
        open_ = written(open_.join(stopped.select("query_id"), "query_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    n = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    outcome = every.join(stopped, "query_id", "left").join(n(history, "steps"), "query_id", "left").join(n(collected, "chunks"), "query_id", "left")
    return {"outcome": outcome.select("query_id", "stop", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("chunks", F.lit(0)).alias("chunks")), "history": history, "collected": collected}
