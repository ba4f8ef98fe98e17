"""Context, prompts, citations, verification, multi-hop retrieval."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.workspace import written
from ..operators import agent, context, evaluate, lexical_index, retrieval, verify
from ..streaming import cache
from . import base
from .base import CHUNKS, RERANKED, SEARCH, content_sql, fixture, literal, query, sentences_sql, values


def ranked(spark, d, k: int = 8, rows=None):
    """rows: stored chunks. The lists are written, as they are read several times and hold k chunks a question."""
    chunks, asked = base.stored_chunks(spark, d) if rows is None else rows, base.questions(spark, d)
    return written(retrieval.lexical_rerank(retrieval.hybrid(asked, chunks, 50), asked, k), "ranked")


_EXPAND = f"""WITH RECURSIVE {CHUNKS}, hits AS (SELECT chunk_id AS key, doc_id, chunk_index, char_start, char_end FROM chunks),
 near AS (SELECT h.key, min(c.char_start) AS a, max(c.char_end) AS b, list(c.chunk_index ORDER BY c.char_start, c.char_end) AS chunk_indices FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY 1)
 SELECT n.key, md5(substring(d.text, CAST(n.a + 1 AS BIGINT), CAST(n.b - n.a AS BIGINT))) AS digest, n.chunk_indices, n.a AS range_start, n.b AS range_end FROM near n JOIN chunks h ON h.chunk_id = n.key JOIN documents d ON d.doc_id = h.doc_id"""


def _keyed(chunks):
    return chunks.select(F.col("chunk_id").alias("key"), "doc_id", "chunk_index", "char_start", "char_end", "text")


@query("g01_expand", _EXPAND)
def expand(spark, d):
    return context.expand_all(_keyed(base.chunks(spark, d)), 1).select("key", F.md5("merged_text").alias("digest"), "chunk_indices", "range_start", "range_end")


SPAN = "doc_id bigint, chunk_id string, chunk_index int, char_start int, char_end int, text string"
SPANS = [(1, "a", 0, 0, 10, "0123456789"), (1, "b", 1, 6, 16, "6789abcdef"), (1, "c", 2, 16, 20, "ghij"), (1, "d", 3, 25, 28, "xyz"), (1, "e", 4, 25, 27, "xy"), (2, "f", 0, 0, 4, "wxyz"), (3, "g", 0, 5, 5, "none")]
_MERGED = [("a", "0123456789abcdef", [0, 1], 0, 16), ("b", "0123456789abcdefghij", [0, 1, 2], 0, 20), ("c", "6789abcdefghij … xyz", [1, 2, 3], 6, 28), ("d", "ghij … xyz", [2, 3, 4], 16, 28), ("e", "xyz", [3, 4], 25, 28), ("f", "wxyz", [0], 0, 4), ("g", "none", [0], 5, 5)]


_MERGED_SQL = "SELECT * FROM (VALUES " + ", ".join(literal(r).replace("[", "(", 1)[:-1] + ")" for r in _MERGED) + ") v(key, merged_text, chunk_indices, range_start, range_end)"


@query("g01_expand_fixture", _EXPAND.split(" SELECT n.key")[0] + f" {_MERGED_SQL} UNION ALL SELECT n.key, substring(d.text, CAST(n.a + 1 AS BIGINT), CAST(n.b - n.a AS BIGINT)), n.chunk_indices, n.a, n.b FROM near n JOIN chunks h ON h.chunk_id = n.key JOIN documents d ON d.doc_id = h.doc_id")
def expand_fixture(spark, d):
    """Odd spans, and all chunks of the documents; their numbers of documents are apart, as each is expanded by itself."""
    odd = context.expand_all(_keyed(fixture(spark, SPAN, SPANS)), 1)
    return odd.unionByName(context.expand_all(_keyed(base.chunks(spark, d)), 1))


@query("g02_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return base.read(spark, d, "documents").select("doc_id", context.estimate(F.col("text")).alias("tokens"))


# the sources' lengths, cut from the last to the second until the estimate fits: what is cut keeps its ends and gets a mark between them
_BUDGET = f""",
 lens AS (SELECT r.query_id, list(length(c.text) ORDER BY r.rank) AS l FROM ranked r JOIN chunks c USING (chunk_id) GROUP BY 1),
 walk AS (SELECT query_id, l, len(l) AS i FROM lens
  UNION ALL
  SELECT query_id, CASE WHEN over > 0 AND greatest({context.FLOOR}, l[i] - over * 4) < l[i] THEN list_concat(l[1:i - 1], [greatest({context.FLOOR}, l[i] - over * 4) + {len(context.CUT)}], l[i + 1:]) ELSE l END, i - 1
  FROM (SELECT *, list_sum(list_transform(l, lambda n: n // 4)) - 600 AS over FROM walk WHERE i > 1))
 SELECT query_id, len(l) AS n, CAST(list_sum(list_transform(l, lambda n: n // 4)) AS BIGINT) AS tokens FROM walk WHERE i = 1"""


@query("g03_token_budget", SEARCH.replace("WITH", "WITH RECURSIVE", 1) + RERANKED + _BUDGET)
def token_budget(spark, d):
    lists = ranked(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("texts"))
    return context.budgeted(lists, 600).select("query_id", F.explode("texts").alias("t")).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(context.estimate(F.col("t"))).alias("tokens"))


_BLOCK = "'[' || r.rank || '] (' || d.source || ', p.1)' || chr(10) || c.text"


@query("g04_prompts", SEARCH + RERANKED + f", b AS (SELECT r.query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY r.rank) AS blocks FROM ranked r JOIN chunks c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id WHERE r.rank <= 3 GROUP BY 1), p AS (SELECT q.query_id, {literal(context.INSTRUCTIONS)} || chr(10) || chr(10) || 'SOURCES:' || chr(10) || coalesce(b.blocks, '(no sources retrieved)') || chr(10) || chr(10) || 'QUESTION: ' || q.text || chr(10) || chr(10) || 'ANSWER:' AS prompt FROM questions q LEFT JOIN b USING (query_id)) SELECT query_id, md5(prompt) AS digest, length(prompt) // 4 AS tokens FROM p")
def prompts(spark, d):
    docs = base.read(spark, d, "documents").select("doc_id", "source")
    sources = ranked(spark, d, 3).join(docs, "doc_id").select("query_id", "rank", "source", "page_number", "text")
    asked = base.questions(spark, d).withColumns({"kind": F.lit("informational"), "task": F.lit("answer"), "thin": F.lit(False)})
    return context.prompts(sources, asked).select("query_id", F.md5("prompt").alias("digest"), "tokens")


ANSWERS = [
    (1, "The pump runs at 85 bar [1]. It is made of steel [2]. Nothing else is known."),
    (2, "The GX-4200 holds 45°C [1, 2]. The valve opens slowly [3-1]. See also [99] and [0]."),
    (3, "I don’t have enough information to answer [1]."),
    (4, "No markers at all here."),
    (5, ""),
    (6, "Steel pump housing rated at 85 bar under load [2][3]! The filter GX-4200 is new [1]."),
    (7, "the steel housing of the pump is rated at eighty five bar under load [1]. Short copy here [2]."),
    (8, "Far off [99999999999] and [1-2000000000], [0], [3-1], [99999999999999999999999] and [2-2]."),
    (9, None),
    (10, "Élan vital à la mode où naît l'été [voir 2] est cité ici [1]. Größe und Höhe über alles im schönen Süden [2]."),
]
SOURCES = [(a, r, f"c{r}", t) for a in range(1, 11) for r, t in [(1, "The pump GX-4200 runs at 85 bar and 145°C. The steel housing of the pump is rated at eighty five bar under load."), (2, "Its housing is made of steel and rated at 85 bar."), (3, "A valve opens when pressure falls; slowly at first.")]]
JUDGED = [(2, 1, "This is not supported by the source"), (2, 2, "supported"), (6, 1, "It contradicts the source"), (6, 3, "no idea")]
# every benchmark text as an answer that cites itself and the document of its number
SAID = base.Mixed("answers", "answer_id int, answer string", ANSWERS, "SELECT CAST(1000 + item_id AS INT) AS answer_id, text || ' [1]. ' || text || ' [2-3].' FROM {benchmark}")
READ = base.Mixed("sources", "answer_id int, rank int, chunk_id string, text string", SOURCES, "SELECT CAST(1000 + item_id AS INT) AS answer_id, 1, 'c1', text FROM {benchmark} UNION ALL SELECT CAST(1000 + b.item_id AS INT), 2, 'd', d.text FROM {benchmark} b JOIN {documents} d ON d.doc_id = b.item_id")
ASKED_JUDGE = base.Mixed("judged", "answer_id int, index int, reply string", JUDGED, "SELECT CAST(1000 + item_id AS INT) AS answer_id, 2, CASE item_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'It contradicts the source' ELSE 'Not mentioned there' END FROM {benchmark}")
_A, _S, _J = SAID.cte, READ.cte, ASKED_JUDGE.cte


def _answers(spark, d):
    return SAID.frame(spark, d)


def _sources(spark, d):
    return READ.frame(spark, d)


_ENDS = "list_filter(list_transform(string_split(t, '-'), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL)"
_NUMBERS = f"CASE WHEN list_max(e) - greatest(list_min(e), 1) >= {verify.WIDEST} THEN [greatest(list_min(e), 1), list_max(e)] ELSE range(greatest(list_min(e), 1), list_max(e) + 1) END"


def _cited_sql(source: str, key: str, text: str) -> str:
    """Common table expressions ending in cites (key, idx) with all distinct markers from 1."""
    return f"""groups AS (SELECT {key}, unnest(regexp_extract_all({text}, '\\[\\s*(\\d+(?:\\s*[-,]\\s*\\d+)*)\\s*\\]', 1)) AS g FROM {source}),
 tokens AS (SELECT {key}, {_ENDS} AS e FROM (SELECT {key}, unnest(string_split(g, ',')) AS t FROM groups)),
 cites AS (SELECT DISTINCT {key}, idx FROM (SELECT {key}, unnest({_NUMBERS}) AS idx FROM tokens))"""


@query("g05_citations", f"WITH {_A}, {_cited_sql('answers', 'answer_id', 'answer')} SELECT a.answer_id, coalesce((SELECT list(idx ORDER BY idx) FROM cites c WHERE c.answer_id = a.answer_id), []) AS cited, coalesce((SELECT list(DISTINCT i ORDER BY i) FROM tokens t, (VALUES (1::BIGINT), (2), (3)) v(i) WHERE t.answer_id = a.answer_id AND i BETWEEN list_min(e) AND list_max(e)), []) AS valid FROM answers a")
def citations(spark, d):
    return _answers(spark, d).select("answer_id", verify.cited(F.col("answer")).alias("cited"), verify.cited(F.col("answer"), F.lit(3)).alias("valid"))


_ABSTAINS = "(" + " OR ".join(f"contains(replace(lower(coalesce(answer, '')), '’', ''''), {literal(p)})" for p in verify.ABSTENTIONS) + ")"


@query("g06_abstention", f"WITH {_A} SELECT answer_id, {_ABSTAINS} AS abstains FROM answers")
def abstention(spark, d):
    return _answers(spark, d).select("answer_id", verify.abstains(F.col("answer")).alias("abstains"))


_CLAIMS = f"""{_cited_sql('answers', 'answer_id', 'answer')},
 sents AS (SELECT answer_id, s, i FROM (SELECT answer_id, unnest({sentences_sql('answer')}) AS s, generate_subscripts({sentences_sql('answer')}, 1) AS i FROM answers)),
 keyed AS (SELECT answer_id || '#' || i AS sk, answer_id, i, s FROM sents),
 sgroups AS (SELECT sk, unnest(regexp_extract_all(s, '\\[\\s*(\\d+(?:\\s*[-,]\\s*\\d+)*)\\s*\\]', 1)) AS g FROM keyed),
 stokens AS (SELECT sk, {_ENDS} AS e FROM (SELECT sk, unnest(string_split(g, ',')) AS t FROM sgroups)),
 scites AS (SELECT DISTINCT sk, unnest({_NUMBERS}) AS idx FROM stokens),
 claims AS (SELECT c.answer_id, c.idx, coalesce((SELECT string_agg(trim(k.s), ' ' ORDER BY k.i) FROM keyed k JOIN scites x ON x.sk = k.sk WHERE k.answer_id = c.answer_id AND x.idx = c.idx), trim(a.answer)) AS claim_text FROM cites c JOIN answers a ON a.answer_id = c.answer_id)"""


@query("g07_claims", f"WITH {_A}, {_CLAIMS} SELECT answer_id, idx AS index, claim_text FROM claims")
def claims(spark, d):
    rows = _answers(spark, d).select("answer_id", "answer", F.explode(verify.cited(F.col("answer"))).alias("index"))
    return rows.select("answer_id", "index", verify.claim(F.col("answer"), F.col("index")).alias("claim_text"))


_FACTS = "list_sort(list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({b}, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '\\d')), lambda x: lower(x)), regexp_extract_all({b}, '\\d+(?:\\.\\d+)?'))))"


def _facts_sql(c: str) -> str:
    return _FACTS.replace("{b}", f"regexp_replace({c}, '\\[[^\\]]*\\]', ' ', 'g')")


@query("g08_facts", f"WITH {_A} SELECT answer_id, {_facts_sql('answer')} AS facts FROM answers")
def facts(spark, d):
    return _answers(spark, d).select("answer_id", verify.facts(F.col("answer")).alias("facts"))


_MINE = f"list_distinct(list_filter({base.words_sql('regexp_replace(claim_text, ' + literal(chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']') + ', ' + literal(' ') + ', ' + literal('g') + ')')}, lambda w: NOT list_contains({literal(T.CITATION_STOPWORDS)}, w)))"
_JUDGE = "CASE WHEN regexp_matches(lower(reply), 'contradict') THEN 'contradicted' WHEN regexp_matches(lower(reply), 'not_mentioned|not mentioned|no mention|not support') THEN 'not_mentioned' WHEN contains(lower(reply), 'support') THEN 'supported' ELSE 'unverified' END"
_VERDICTS = f"""{_CLAIMS},
 met AS (SELECT c.answer_id, c.idx, s.chunk_id, CASE WHEN s.chunk_id IS NULL THEN '' ELSE c.claim_text END AS claim_text, lower(s.text) AS chunk FROM claims c JOIN answers a ON a.answer_id = c.answer_id AND a.answer <> '' AND NOT {_ABSTAINS} LEFT JOIN sources s ON s.answer_id = c.answer_id AND s.rank = c.idx),
 seen AS (SELECT *, {_facts_sql('claim_text')} AS facts, {_MINE} AS mine FROM met),
 tier1 AS (SELECT *, CASE WHEN chunk_id IS NULL THEN 'invalid' WHEN len(facts) > 0 THEN CASE WHEN len(list_filter(facts, lambda f: NOT contains(chunk, f))) = 0 THEN 'supported' ELSE 'unverified' END
   WHEN len(mine) = 0 OR len(list_intersect(mine, {base.words_sql('chunk')})) / len(mine) >= 0.6 THEN 'supported' ELSE 'unverified' END AS v1 FROM seen)"""


@query("g09_verdicts", f"WITH {_A}, {_S}, {_VERDICTS} SELECT answer_id, idx AS index, claim_text, chunk_id, v1 AS verdict, CASE v1 WHEN 'supported' THEN 0.9 ELSE 0.0 END AS confidence, CASE v1 WHEN 'supported' THEN 'valid' WHEN 'unverified' THEN 'unverified' ELSE 'dropped' END AS state FROM tier1")
def verdicts(spark, d):
    return verify.validate(_answers(spark, d), _sources(spark, d))


@query("g10_judged", f"WITH {_A}, {_S}, {_J}, {_VERDICTS}, t2 AS (SELECT t.*, CASE WHEN v1 = 'unverified' THEN CASE WHEN j.reply IS NULL THEN 'unverified' ELSE {_JUDGE} END ELSE v1 END AS v2 FROM tier1 t LEFT JOIN judged j ON j.answer_id = t.answer_id AND j.index = t.idx) SELECT answer_id, idx AS index, claim_text, chunk_id, v2 AS verdict, CASE WHEN v2 = 'supported' AND v1 <> 'supported' THEN 0.75 WHEN v2 = 'supported' THEN 0.9 WHEN v2 = 'contradicted' THEN 0.9 WHEN v2 = 'not_mentioned' THEN 0.75 ELSE 0.0 END AS confidence, CASE v2 WHEN 'supported' THEN 'valid' WHEN 'unverified' THEN 'unverified' ELSE 'dropped' END AS state FROM t2")
def judged(spark, d):
    return verify.validate(_answers(spark, d), _sources(spark, d), ASKED_JUDGE.frame(spark, d))


_EXTRACT = f"""
 said AS (SELECT query_id, rank, i AS pos, trim(s) AS sentence FROM (SELECT r.query_id, r.rank, unnest({sentences_sql('c.text')}) AS s, generate_subscripts({sentences_sql('c.text')}, 1) AS i FROM ranked r JOIN chunks c USING (chunk_id)) WHERE regexp_matches(s, '\\S')),
 scored AS (SELECT a.*, len(list_intersect(list_distinct({content_sql('q.text')}), list_distinct({content_sql('a.sentence')}))) AS n_shared FROM said a JOIN questions q USING (query_id)),
 chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, rank, pos) AS n FROM scored QUALIFY n <= 3 AND (n_shared > 0 OR n = 1)),
 extracted AS (SELECT q.query_id, coalesce(string_agg(regexp_replace(sentence, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY n), '') AS answer FROM questions q LEFT JOIN chosen USING (query_id) GROUP BY 1)"""


@query("g15_extractive", SEARCH + RERANKED + "," + _EXTRACT + " SELECT query_id, answer FROM extracted")
def extractive(spark, d):
    return evaluate.extractive_answers(base.questions(spark, d), ranked(spark, d))


def _runs_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


_ISLANDS = f"""
 bare AS (SELECT answer_id, regexp_replace(coalesce(answer, ''), '\\[[^\\]]*\\]', ' ', 'g') AS t FROM answers),
 spoken AS (SELECT answer_id, sn, {_runs_sql('s')} AS w FROM (SELECT answer_id, unnest({sentences_sql('trim(t)')}) AS s, generate_subscripts({sentences_sql('trim(t)')}, 1) AS sn FROM bare) WHERE len({_runs_sql('s')}) >= 6),
 aw AS (SELECT answer_id, sn, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM spoken),
 cw AS (SELECT answer_id, rank, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM (SELECT answer_id, rank, {_runs_sql('text')} AS w FROM sources)),
 met AS (SELECT answer_id, sn, n, rank, i, i - j AS d FROM aw JOIN cw USING (answer_id, word)),
 isl AS (SELECT *, i - row_number() OVER (PARTITION BY answer_id, sn, rank, d ORDER BY i) AS g FROM met),
 best AS (SELECT answer_id, sn, max(c / n) AS share FROM (SELECT answer_id, sn, n, count(*) AS c FROM isl GROUP BY answer_id, sn, n, rank, d, g) GROUP BY 1, 2),
 per AS (SELECT s.answer_id, count(*) AS total, count(*) FILTER (b.share > 0.8) AS flagged FROM spoken s LEFT JOIN best b USING (answer_id, sn) GROUP BY 1),
 rep AS (SELECT a.answer_id, coalesce(total, 0) AS total, coalesce(flagged, 0) AS flagged, CASE WHEN total > 0 THEN round(flagged / total, 3) ELSE 0.0 END AS ratio FROM answers a LEFT JOIN per USING (answer_id))
 SELECT answer_id, total, flagged, ratio, CASE WHEN ratio > 0.5 THEN 'high_verbatim' END AS warning FROM rep"""


@query("g11_verbatim_fixture", f"WITH {_A}, {_S},{_ISLANDS}")
def verbatim_fixture(spark, d):
    return verify.verbatim(_answers(spark, d), _sources(spark, d))


@query("g11_verbatim", SEARCH + RERANKED + "," + _EXTRACT + f", answers AS (SELECT query_id AS answer_id, answer FROM extracted), sources AS (SELECT r.query_id AS answer_id, r.rank, c.text FROM ranked r JOIN chunks c USING (chunk_id)),{_ISLANDS}")
def verbatim(spark, d):
    sources = ranked(spark, d)
    answers = evaluate.extractive_answers(base.questions(spark, d), sources).withColumnRenamed("query_id", "answer_id")
    return verify.verbatim(answers, sources.select(F.col("query_id").alias("answer_id"), "rank", "text"))


VERIFIER = [
    (1, "None.", "One. Two."), (2, "No unsupported claims.", "One."), (3, "", "One."), (4, "Unsupported claims:\n- The pump is made of gold.\n- Everything is supported", "One. Two. Three."),
    (5, "- The claim that it runs is supported by the source, fully\n* The colour is not supported at all", "A. B. C. D."), (6, "The following:\nshort", "One."), (7, None, "One."), (8, "1. First wrong claim here\n2. Second wrong claim here\n3. Third wrong claim", "Only one sentence"),
]


VERIFIED = base.Mixed("replies", "id int, reply string, answer string", VERIFIER, "SELECT CAST(1000 + a.conv_id * 100 + a.turn AS INT) AS id, b.text, a.text FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")


def _phrases(c: str, cues: list[str]) -> str:
    return f"regexp_matches({c}, {literal('|'.join(cues))})"


_GROUND = f"""WITH {VERIFIED.cte}, t AS (SELECT id, regexp_replace(coalesce(reply, ''), '^\\s+|\\s+$', '', 'g') AS text, answer FROM replies),
 f AS (SELECT *, regexp_replace(trim(string_split(lower(text), chr(10))[1]), '[.:]+$', '') AS first, list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(trim(s), '^[-•*0123456789.) ]+', ''))) AS lines FROM t),
 b AS (SELECT *, list_filter(lines, lambda s: length(s) > 8 AND NOT {_phrases('lower(s)', verify.NOT_CLAIMS)} AND NOT ({_phrases('lower(s)', verify.AFFIRMING)} AND NOT {_phrases('lower(s)', verify.NEGATING)})) AS bad,
   greatest(len(list_filter(string_split(answer, '.'), lambda s: trim(s) <> '')), 1) AS total, ({_phrases('first', verify.ALL_GROUNDED)} OR starts_with(first, 'none') OR list_contains({literal(verify.CLEAR)}, first)) AS clean FROM f)
 SELECT id, CASE WHEN text = '' THEN false WHEN clean THEN true ELSE len(bad) = 0 END AS grounded, CASE WHEN text = '' THEN 0.0 WHEN clean THEN 1.0 WHEN len(bad) = 0 THEN 0.85 ELSE round(greatest(0.0, 1 - len(bad) / total), 3) END AS confidence,
  CASE WHEN text = '' OR clean THEN [] ELSE bad END AS unsupported, text <> '' AS verified FROM b"""


@query("g12_groundedness", _GROUND)
def groundedness(spark, d):
    return VERIFIED.frame(spark, d).select("id", verify.groundedness(F.col("reply"), F.col("answer")).alias("g")).select("id", "g.*")


SIGNALS = [(1, 0.8, 3, 1, 0.95, True), (2, 0.9, 0, 0, 0.5, True), (3, 0.7, 2, 0, 0.7, True), (4, 0.2, 1, 1, 1.0, False), (5, 1.0, 4, 0, 1.0, True)]
_SIGNALS = "answer_id int, retrieval double, n_valid int, n_dropped int, groundedness double, verified boolean"


MEASURED = base.Mixed("s", _SIGNALS, SIGNALS, "SELECT CAST(1000 + doc_id AS INT) AS answer_id, CAST(doc_id % 11 AS DOUBLE) / 10, CAST(doc_id % 4 AS INT), CAST(doc_id % 3 AS INT), CAST(doc_id % 7 AS DOUBLE) / 6, doc_id % 2 = 0 FROM {documents}")


@query("g13_confidence", f"WITH {MEASURED.cte}, c AS (SELECT *, CASE WHEN n_valid + n_dropped > 0 THEN round(n_valid / (n_valid + n_dropped), 3) ELSE 0.0 END AS citation_coverage FROM s) SELECT *, verified AND groundedness > least(retrieval, citation_coverage) + 1e-9 AS capped FROM c")
def confidence(spark, d):
    return verify.confidence(MEASURED.frame(spark, d))


@query("g14_answers")
def answers(spark, d):
    from ..engine import Engine

    engine = Engine(spark, base.read(spark, d, "documents").select("doc_id", "text", "source"))
    out = engine.answer(base.questions(spark, d), 5)
    states = out["citations"].groupBy("answer_id").agg(F.count_if(F.col("state") == "valid").alias("n_valid"), F.count_if(F.col("state") == "dropped").alias("n_dropped"), F.count_if(F.col("state") == "unverified").alias("n_unverified"))
    return out["answers"].join(states, "answer_id", "left").join(out["copied"].select("answer_id", "ratio", "warning"), "answer_id")


@query("g17_cache_probe", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS set_at FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT r.event_id, CAST(r.user_id AS VARCHAR) AS key, e.set_at IS NOT NULL AND e.set_at + INTERVAL 3600 SECOND > n.now AS hit FROM events r CROSS JOIN n LEFT JOIN e ON e.key = CAST(r.user_id AS VARCHAR) WHERE r.event_type = 'click'")
def cache_probe(spark, d):
    events = base.read(spark, d, "events")
    stored = events.filter("event_type = 'view'").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("set_at")).withColumn("answer", F.lit("x"))
    now = events.agg(F.max("ts")).first()[0]
    asked = events.filter("event_type = 'click'").select("event_id", F.col("user_id").cast("string").alias("key"))
    return cache.probe(asked, stored, F.lit(now)).select("event_id", "key", "hit")


@query("g17_cache_lru", "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS used_at FROM events GROUP BY 1) SELECT key, used_at, row_number() OVER (ORDER BY used_at DESC, key) AS place FROM l QUALIFY place <= 50")
def cache_lru(spark, d):
    return cache.lru(base.read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts"), 50)


FOUND = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "a", 1), (1, 2, "c", 2), (2, 1, "x", 1), (1, 3, "c", 1), (1, 3, "d", 5)]
_FOUND = "query_id int, step int, chunk_id string, rank int"


MET = base.Mixed("f", _FOUND, FOUND, "SELECT CAST(1000 + user_id AS INT) AS query_id, CAST(event_id % 5 AS INT), event_type, CAST(event_id % 9 AS INT) FROM {events}")
PLAIN = base.Mixed("p", "query_id int, chunk_id string, rank int", [(1, "p", 1), (3, "q", 1), (3, "r", 2)], "SELECT CAST(1000 + doc_id AS INT) AS query_id, coalesce(source, ''), 1 FROM {documents}")


@query("l03_collect_first", f"WITH {MET.cte}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step, rank) AS n FROM f) SELECT query_id, step, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY step, rank, chunk_id) AS seen FROM k WHERE n = 1")
def collect_first(spark, d):
    return agent.collect_first(MET.frame(spark, d))


@query("l02_fallback", f"WITH {MET.cte}, {PLAIN.cte} SELECT query_id, chunk_id, rank FROM p WHERE query_id NOT IN (SELECT query_id FROM f)")
def fallback(spark, d):
    plain = PLAIN.frame(spark, d)
    return agent.fallback(plain.select("query_id").distinct(), MET.frame(spark, d), plain)


LIMITS = base.Mixed("v", "k int", [(x,) for x in (-3, 0, 1, 8, 20, 99, None)], "SELECT CAST(doc_id % 40 - 10 AS INT) AS k FROM {documents}")


@query("l04_tool_limits", f"WITH {LIMITS.cte} SELECT k, CAST(greatest(1, least(coalesce(k, 8), 20)) AS INTEGER) AS top_k FROM v")
def tool_limits(spark, d):
    return LIMITS.frame(spark, d).select("k", agent.clamp_k(F.col("k")).alias("top_k"))


REPLIES = [
    ('Thought: x {"tool": "retrieve_docs", "args": {"query": "a}b", "top_k": 3}} then', "retrieve_docs", 2), ('{"action": "fetch_document", "doc_id": "7"}', "fetch_document", 1), ("no json", None, None),
    ('{"broken": }{"tool": "finish"}', "finish", 0), (None, None, None), ('```json\n{"tool":"FINISH","args":{}}\n```', "finish", 0), ('{"name": " retrieve_docs ", "query": "y"}', "retrieve_docs", 1),
    ('{"tool": "retrieve_docs", "args": [1]}', None, None), ('{"args": {"query": "z"}}', None, None), ('[{"tool": "finish"}]', None, None), ('{"tool": 7}', None, None),
]


PARSED = base.Mixed("v", "id int, tool string, n_args int", [(i, t, n) for i, (_, t, n) in enumerate(REPLIES)], "SELECT CAST(1000 + doc_id AS INT) AS id, 'fetch_document', 1 FROM {documents} UNION ALL SELECT CAST(-1 - item_id AS INT), NULL, NULL FROM {benchmark}")
# chr(123) and chr(125) are braces
SPOKEN = base.Mixed("w", "id int, reply string", [(i, r) for i, (r, _, _) in enumerate(REPLIES)], """SELECT CAST(1000 + doc_id AS INT) AS id, coalesce(lang, '') || ': ' || chr(123) || '"tool": "fetch_document", "args": ' || chr(123) || '"doc_id": ' || doc_id || chr(125) || chr(125) || ' done' FROM {documents} UNION ALL SELECT CAST(-1 - item_id AS INT), translate(text, chr(123), ' ') FROM {benchmark}""")


@query("l05_parse_action", f"WITH {PARSED.cte} SELECT * FROM v")
def parse_actions(spark, d):
    def run(frames):
        for frame in frames:
            found = [agent.parse_action(r) for r in frame["reply"]]
            yield pd.DataFrame({"id": frame["id"], "tool": [a and a["tool"] for a in found], "n_args": pd.array([len(a["args"]) if a else None for a in found], "Int32")})

    return SPOKEN.frame(spark, d).mapInPandas(run, "id int, tool string, n_args int")


WANTED = [(1, "5", None), (2, "document_0", None), (3, "document_0", "7"), (4, None, "7"), (5, None, None), (6, "", None), (7, "7", "5")]
_WANTED = "query_id int, doc_id string, scope_id string"


@query("l04_resolve_documents", f"WITH {values('w', _WANTED, WANTED)}, ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL), f AS (SELECT string_agg(id, ', ' ORDER BY length(id), id) AS first FROM (SELECT id FROM ids ORDER BY length(id), id LIMIT 10)) SELECT query_id, coalesce(id, scope_id, nullif(w.doc_id, '')) AS target, CASE WHEN id IS NULL AND scope_id IS NULL THEN 'unknown doc_id; valid ids: ' || first END AS note FROM w CROSS JOIN f LEFT JOIN ids ON ids.id = w.doc_id")
def resolve_documents(spark, d):
    return agent.resolve_documents(fixture(spark, _WANTED, WANTED), base.read(spark, d, "documents"))


def _multi(spark, d, most=3, rows=None):
    asked, rows = base.questions(spark, d), base.stored_chunks(spark, d) if rows is None else rows
    gathered = agent.run_offline(asked, lambda q: retrieval.bm25_top(q, rows, 5).select("query_id", "chunk_id", F.col("bm25_rank").alias("rank")), most)
    return asked, gathered


_MULTI = f"""WITH asked0 AS (SELECT item_id AS qid, text FROM benchmark),
 parts AS (SELECT qid, i, regexp_replace(s, '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g') AS s FROM (SELECT qid, unnest(string_split_regex(text, '(?i)\\band\\b|\\bversus\\b|\\bvs\\b|;|\\?')) AS s, generate_subscripts(string_split_regex(text, '(?i)\\band\\b|\\bversus\\b|\\bvs\\b|;|\\?'), 1) AS i FROM asked0)),
 uniq AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(s) ORDER BY i) AS copy FROM parts WHERE length(s) > 3),
 subs AS (SELECT qid, s AS text, row_number() OVER (PARTITION BY qid ORDER BY i) AS step FROM uniq WHERE copy = 1 QUALIFY step <= 3),
 questions AS (SELECT qid || '#' || step AS query_id, text FROM subs),{CHUNKS},{base.BM25},
 found AS (SELECT qid, step, chunk_id, bm25_rank AS rank FROM bm25 b JOIN subs s ON b.query_id = s.qid || '#' || s.step WHERE bm25_rank <= 5),
 kept AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY step, rank) AS n FROM found QUALIFY n = 1)"""


@query("l06_offline_agent", _MULTI.replace(" QUALIFY step <= 3", "") + " SELECT qid AS query_id, CAST(step AS INTEGER) AS step, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY step, rank, chunk_id) AS seen FROM kept")
def offline_agent(spark, d):
    """Every sub-question of a text is searched."""
    return _multi(spark, d, None)[1]


@query("l07_trajectory", _MULTI + ", s AS (SELECT qid, count(*) AS steps FROM subs GROUP BY 1), c AS (SELECT qid, count(*) AS chunks FROM kept GROUP BY 1), t AS (SELECT qid, coalesce(steps, 0) AS steps, coalesce(chunks, 0) AS chunks, chunks IS NULL AS fb FROM asked0 LEFT JOIN s USING (qid) LEFT JOIN c USING (qid)) SELECT round(sum(steps) / count(*), 3) AS avg_steps, round(sum(steps) / count(*), 3) AS avg_tool_calls, round(sum(chunks) / count(*), 3) AS avg_chunks_gathered, count(*) FILTER (steps > 1) AS multi_hop_queries, count(*) FILTER (fb) AS fallback_queries, count(*) FILTER (steps >= 5) AS hit_max_steps FROM t")
def trajectory(spark, d):
    asked, gathered = _multi(spark, d)
    return agent.trajectory_stats(agent.trajectory(gathered, agent.offline_plan(asked), asked))


_LOOP = f"""WITH w AS (SELECT item_id AS qid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
 acts AS (SELECT qid, array_to_string(w[1:8], ' ') AS a1, array_to_string(w[5:12], ' ') AS a2 FROM w),
 questions AS (SELECT qid || '#1' AS query_id, a1 AS text FROM acts UNION ALL SELECT qid || '#2', a2 FROM acts WHERE a2 <> a1),{CHUNKS},{base.BM25},
 found AS (SELECT split_part(query_id, '#', 1) AS qid, split_part(query_id, '#', 2) AS step, chunk_id FROM bm25 WHERE bm25_rank <= 5),
 n1 AS (SELECT qid, count(*) AS n FROM found WHERE step = '1' GROUP BY 1),
 n2 AS (SELECT qid, count(*) AS n FROM found f WHERE step = '2' AND NOT EXISTS (SELECT 1 FROM found g WHERE g.qid = f.qid AND g.step = '1' AND g.chunk_id = f.chunk_id) GROUP BY 1),
 s AS (SELECT CAST(a.qid AS VARCHAR) AS query_id, a1, a2, coalesce(n1.n, 0) AS x, coalesce(n2.n, 0) AS y FROM acts a LEFT JOIN n1 ON n1.qid = CAST(a.qid AS VARCHAR) LEFT JOIN n2 ON n2.qid = CAST(a.qid AS VARCHAR))
 SELECT query_id, CASE WHEN a1 = a2 AND a1 <> '' THEN 'repeated' WHEN a2 <> '' AND x > 0 AND y = 0 THEN 'no_progress' ELSE 'finish' END AS stop,
        CASE WHEN a1 = a2 AND a1 <> '' THEN 1 ELSE 2 END AS steps, x + CASE WHEN a1 = a2 THEN 0 ELSE y END AS chunks FROM s"""


@query("l01_agent_loop", _LOOP)
def agent_loop(spark, d):
    """A planner that asks for eight words of the question, then for eight that begin with its fifth, then finishes."""
    stored = lexical_index.build(base.chunks(spark, d))
    asked = base.questions(spark, d).select(F.col("query_id").cast("string").alias("query_id"), "text")

    def planner(text, history):
        words = text.split()[len(history) * 4 : len(history) * 4 + 8]
        return '{"tool": "finish"}' if len(history) > 1 else json.dumps({"tool": "retrieve_docs", "args": {"query": " ".join(words)}})

    def retrieve(calls):
        found = retrieval.bm25_top(calls.select("query_id", F.col("arguments")["query"].alias("text")), stored, 5)
        return found.select("query_id", F.col("chunk_id").alias("item"), F.col("bm25_rank").alias("rank"))

    return agent.run_loop(asked, planner, {"retrieve_docs": retrieve})["outcome"]
