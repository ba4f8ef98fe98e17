"""Checking answers: citation markers, claims, facts, verdicts, copied sentences, groundedness replies, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: the pattern of a citation marker.
MARKER = r"\[\s*(\d+(?:\s*[-,]\s*\d+)*)\s*\]"
#: A range of more numbers than this, where the number of sources isn't given, counts as its two ends.
WIDEST = 1_000
# Phrases by which an answer declines.
ABSTENTIONS = ["don't have enough information", "do not have enough information", "not contained in the provided", "not contained in the sources"]
OVERLAP, COPIED, MANY_COPIED, SHORTEST = 0.6, 0.8, 0.5, 6
#: Words of a seed: at most what a copied run of the shortest sentence has.
SEED = 5
CONFIDENCE = {"supported": 0.9, "supported_by_judge": 0.75, "contradicted": 0.9, "not_mentioned": 0.75, "unverified": 0.0, "invalid": 0.0}


def cited(answer: Column, n_chunks: Column | None = None) -> Column:
    """Sorted distinct numbers of [n], [n,m] and [n-m] markers, from 1 (to n_chunks), as bigints. Numbers beyond a bigint are none; a null answer has none."""
    tokens = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARKER), F.lit(1)), lambda g: F.split(g, ",")))

    def expand(t):
        ends = F.filter(F.transform(F.split(t, "-"), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())
        low, high = F.greatest(F.array_min(ends), F.lit(1).cast("bigint")), F.array_max(ends)
        if n_chunks is not None:
            high = F.least(high, n_chunks.cast("bigint"))
        wide = (high - low >= WIDEST) if n_chunks is None else F.lit(False)
        none = F.array().cast("array<bigint>")
        return F.when((F.size(ends) == 0) | (high < low), none).when(wide, F.array(low, high)).otherwise(F.sequence(low, F.when(wide, low).otherwise(high)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, expand))))


def abstains(answer: Column) -> Column:
    plain = F.replace(F.lower(F.coalesce(answer, F.lit(""))), F.lit("’"), F.lit("'"))
    found = F.lit(False)
    for phrase in ABSTENTIONS:
        found = found | F.contains(plain, F.lit(phrase))
    return found


def claim(answer: Column, number: Column) -> Column:
    """The sentences that carry the marker, or the whole answer."""
    own = F.filter(T.sentences(answer), lambda s: F.array_contains(cited(s), number))
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, T.strip), " ")).otherwise(T.strip(answer))


def facts(text: Column) -> Column:
    """Lower-case codes (letters and digits in one token) and numbers, without markers. The patterns are fixed values."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", " ")
    codes = F.regexp_extract_all(bare, F.lit(r"\b(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.transform(codes, F.lower), F.regexp_extract_all(bare, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))))


def overlap(claim_text: Column, chunk: Column) -> Column:
    """Share of a claim's words, without stopwords and markers, that the chunk has; 1 if it has none."""
    mine = F.array_distinct(T.without(T.words(F.regexp_replace(claim_text, r"\[[^\]]*\]", " ")), T.CITATION_STOPWORDS))
    return F.when(F.size(mine) == 0, 1.0).otherwise(F.size(F.array_intersect(mine, T.words(chunk))) / F.size(mine))


def verdict(claim_text: Column, chunk: Column, judged: Column | None = None) -> Column:
    """supported if all facts are in the chunk as substrings, or without facts if enough words are; else the judge's verdict, or unverified."""
    found, low = facts(claim_text), F.lower(chunk)
    clear = F.when(F.size(found) > 0, F.forall(found, lambda f: F.contains(low, f))).otherwise(overlap(claim_text, chunk) >= OVERLAP)
    return F.when(clear, "supported").otherwise(F.lit("unverified") if judged is None else F.coalesce(judged, F.lit("unverified")))


def parse_judge(reply: Column) -> Column:
    t = F.lower(T.strip(reply))
    has = lambda *cues: F.coalesce(t.rlike("|".join(cues)), F.lit(False))
    return F.when(has("contradict"), "contradicted").when(has("not_mentioned", "not mentioned", "no mention", "not support"), "not_mentioned").when(has("support"), "supported").otherwise("unverified")


def validate(answers: DataFrame, sources: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """One row a citation: answer_id, index, claim_text, chunk_id, verdict, confidence, state (valid, dropped, unverified).

    answers (answer_id, answer), sources (answer_id, rank, chunk_id, text), judge (answer_id, index, reply) if one was asked. An abstaining answer has none.
    """
    asked = answers.filter((F.coalesce("answer", F.lit("")) != "") & ~abstains(F.col("answer"))).select("answer_id", "answer", F.explode(cited(F.col("answer"))).alias("index"))
    met = asked.join(sources.select("answer_id", F.col("rank").alias("index"), "chunk_id", F.col("text").alias("chunk")), ["answer_id", "index"], "left")
    judged = F.lit(None).cast("string")
    if judge is not None:
        met, judged = met.join(judge, ["answer_id", "index"], "left"), F.when(F.col("reply").isNotNull(), parse_judge(F.col("reply")))
    there = F.col("chunk_id").isNotNull()
    out = met.withColumn("claim_text", F.when(there, claim(F.col("answer"), F.col("index"))).otherwise(""))
    out = out.withColumn("by_text", F.when(there, verdict(F.col("claim_text"), F.col("chunk"))).otherwise("invalid"))
    out = out.withColumn("verdict", F.when(F.col("by_text") == "unverified", F.coalesce(judged, F.lit("unverified"))).otherwise(F.col("by_text")))
    sure = F.when((F.col("verdict") == "supported") & (F.col("by_text") != "supported"), CONFIDENCE["supported_by_judge"])
    for name, value in CONFIDENCE.items():
        sure = sure.when(F.col("verdict") == name, value)
    state = F.when(F.col("verdict") == "supported", "valid").when(F.col("verdict") == "unverified", "unverified").otherwise("dropped")
    return out.select("answer_id", "index", "claim_text", "chunk_id", "verdict", sure.alias("confidence"), state.alias("state"))


def answer_sentences(answers: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, sentence): sentences without bracketed parts, blank ones left out."""
    bare = T.strip(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[[^\]]*\]", " "))
    return answers.select("answer_id", F.posexplode(T.sentences(bare)).alias("sentence_no", "s")).select("answer_id", "sentence_no", T.strip(F.col("s")).alias("sentence")).filter("sentence <> ''")


def verbatim(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, total, flagged, ratio, warning): sentences of six words or more of which over 0.8 is one run of a source's words.

    A word is a run of letters and digits of any script and underscores. A run that counts for a sentence of n words has L = floor(0.8 n) + 1 of them or
    more, so it covers L - SEED + 1 places where SEED words begin, one of which is a multiple of that number: seeds are the runs of SEED words at
    those places only, and every such run of a source. Equal seeds give the sentence's place in the source, where all words are compared.
    """
    least = (F.floor(F.size("w") * COPIED + 1e-9) + 1).cast("int")
    numbered = answer_sentences(answers).withColumn("w", T.word_runs(F.col("sentence"))).filter(F.size("w") >= SHORTEST).withColumn("least", least)
    spoken = numbered.select("answer_id", "sentence_no", "w", "least")
    read = sources.select("answer_id", "rank", T.word_runs(F.col("text")).alias("words")).filter(F.size("words") >= SEED)
    seed = lambda words, i: F.array_join(F.slice(words, i + 1, SEED), " ")
    starts = F.sequence(F.lit(0), F.size("w") - SEED, F.col("least") - SEED + 1)
    said = spoken.select("answer_id", "sentence_no", F.explode(starts).alias("i"), "w").select("answer_id", "sentence_no", "i", seed(F.col("w"), F.col("i")).alias("seed"))
    heard = read.select("answer_id", "rank", F.explode(F.sequence(F.lit(0), F.size("words") - SEED)).alias("j"), "words").select("answer_id", "rank", "j", seed(F.col("words"), F.col("j")).alias("seed"))
    places = said.join(heard, ["answer_id", "seed"]).select("answer_id", "sentence_no", "rank", (F.col("j") - F.col("i")).alias("shift")).distinct()
    both = places.join(spoken, ["answer_id", "sentence_no"]).join(read, ["answer_id", "rank"])
    equal = F.transform("w", lambda x, k: F.when(x == F.get("words", k + F.col("shift")), "1").otherwise("0"))
    copied = F.contains(F.array_join(equal, ""), F.repeat(F.lit("1"), F.col("least")))
    best = both.filter(copied).select("answer_id", "sentence_no").distinct().withColumn("copied", F.lit(1))
    per = spoken.select("answer_id", "sentence_no").join(best, ["answer_id", "sentence_no"], "left").groupBy("answer_id").agg(F.count("*").alias("total"), F.count("copied").alias("flagged"))
    out = answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    ratio = F.when(F.col("total") > 0, F.round(F.col("flagged") / F.col("total"), 3)).otherwise(0.0)
    return out.withColumn("ratio", ratio).withColumn("warning", F.when(F.col("ratio") > MANY_COPIED, "high_verbatim"))


# Phrases of a verifier's reply.
CLEAR = ["none", "all supported", "all_supported", "no unsupported claims", "fully supported", "no", "n/a", "na"]
ALL_GROUNDED = ["no unsupported", "all claims are supported", "all of the claims are supported", "everything is supported", "all supported", "fully supported", "none are unsupported"]
NOT_CLAIMS = ["no unsupported", "all supported", "fully supported", "all claims are supported", "everything is supported", "unsupported claims", "here are", "the following", "no claims"]
AFFIRMING = ["is supported", "are supported", "is directly supported", "is fully supported", "supported by the source"]
NEGATING = ["not supported", "not directly supported", "isn't supported", "is not", "no support", "unsupported"]


def groundedness(reply: Column, answer: Column) -> Column:
    """Struct (grounded, confidence, unsupported, verified) of a verifier's reply; an empty reply counts as not verified."""
    has = lambda c, cues: c.rlike("|".join(cues))
    text = T.strip(F.coalesce(reply, F.lit("")))
    first = F.regexp_replace(T.strip(F.get(F.split(F.lower(text), "\n"), F.lit(0))), "[.:]+$", "")
    clean = has(first, ALL_GROUNDED) | first.startswith("none") | first.isin(CLEAR)
    lines = F.transform(F.split(text, "\n"), lambda s: T.strip(F.regexp_replace(T.strip(s), r"^[-•*0123456789.) ]+", "")))

    def counts(s):
        low = F.lower(s)
        return (F.length(s) > 8) & ~has(low, NOT_CLAIMS) & ~(has(low, AFFIRMING) & ~has(low, NEGATING))

    bad = F.filter(lines, counts)
    total = F.greatest(F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), r"\."), lambda s: T.strip(s) != "")), F.lit(1))
    none = F.array().cast("array<string>")
    made = lambda g, c, u, v: F.struct(F.lit(g).alias("grounded"), c.alias("confidence"), u.alias("unsupported"), F.lit(v).alias("verified"))
    return F.when(text == "", made(False, F.lit(0.0), none, False)).when(clean, made(True, F.lit(1.0), none, True)).when(F.size(bad) == 0, made(True, F.lit(0.85), none, True)).otherwise(made(False, F.round(F.greatest(F.lit(0.0), 1 - F.size(bad) / total), 3), bad, True))


def confidence(signals: DataFrame) -> DataFrame:
    """signals (answer_id, retrieval, n_valid, n_dropped in range, groundedness, verified) with citation_coverage and capped."""
    cited_ = F.col("n_valid") + F.col("n_dropped")
    out = signals.withColumn("citation_coverage", F.when(cited_ > 0, F.round(F.col("n_valid") / cited_, 3)).otherwise(0.0))
    return out.withColumn("capped", F.col("verified") & (F.col("groundedness") > F.least("retrieval", "citation_coverage") + 1e-9))
