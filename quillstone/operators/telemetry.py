"""Latency, cost and usage reports over recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars for a million tokens in and out; rupees for a dollar.
PRICES = {
    "gemini-1.5-pro": (1.25, 5.00),
    "gemini-flash-lite-latest": (0.10, 0.40),
    "gemini-flash-latest": (0.30, 2.50),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "deepseek-chat": (0.27, 1.10),
    "gpt-4o-mini": (0.15, 0.60),
    "stub-1": (0.0, 0.0),
    "stub-verify": (0.0, 0.0),
}
RUPEES = 83.0


def rounded(c: Column, digits: int) -> Column:
    """Half up on the scaled binary value, as other engines round doubles; Spark's own round looks at the decimal digits."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int], buckets: int = 64) -> DataFrame:
    """One column p<percent> for each: the k-th smallest value, k = percent / 100 * n + 0.5 rounded half to even, from 1 to n.

    Values are counted first, so one that repeats is one row. Approximate quantiles, which tasks merge, cut a group's values into `buckets` ranges;
    the ranges' counts say in which of them each rank lies, and only those ranges are sorted, each in a task of its own. So no task sees a whole
    group, and the result is exact however good the quantiles are.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    counted = known.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    cuts = known.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets)).alias("cuts"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    dealt = counted.alias("a").join(cuts.alias("b"), same("a", "b")).select("a.*", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("range"))
    sums = dealt.groupBy(*keys, "range").agg(F.sum("c").alias("here"))
    own = Window.partitionBy(*keys)  # one row a range
    sums = sums.withColumn("before", F.sum("here").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")).withColumn("n", F.sum("here").over(own))
    k = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(p / 100) * F.col("n") + 0.5, 0).cast("long")))
    ranks = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), k(p).alias("k")) for p in percents]), lambda r: (r["k"] > F.col("before")) & (r["k"] <= F.col("before") + F.col("here")))
    wanted = sums.withColumn("ranks", ranks).filter(F.size("ranks") > 0).select(*keys, "range", "before", "ranks")
    met = dealt.alias("a").join(wanted.alias("b"), [*same("a", "b"), F.col("a.range") == F.col("b.range")]).select("a.*", "before", "ranks")
    upto = F.sum("c").over(Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    placed = met.withColumn("upto", upto).select(*keys, "v", "upto", F.explode("ranks").alias("r")).filter(F.col("upto") >= F.col("r.k"))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("r.p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def stage_latency(steps: DataFrame) -> DataFrame:
    """(stage, n, p50, p95, max, share) from steps (stage, ms): shares are of the sum of rounded medians."""
    base = steps.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.max("ms"), 1).alias("max"))
    ranks = nearest_rank(steps, ["stage"], "ms", [50, 95]).select("stage", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"))
    out = base.join(ranks, "stage")
    total = F.sum("p50").over(Window.partitionBy())
    return out.withColumn("share", F.round(100 * F.col("p50") / F.when(total == 0, 1.0).otherwise(total), 1))


def price_table(spark, prices: dict = PRICES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("entry"), F.lit(float(a)).alias("price_in"), F.lit(float(b)).alias("price_out")) for m, (a, b) in prices.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def priced(calls: DataFrame, prices: dict = PRICES, rate: float = RUPEES) -> DataFrame:
    """calls (model, input_tokens, output_tokens, ...) with entry, cost_usd, cost_inr: the exact entry, else the longest that the model's name begins with.

    No entry, or no token counts, is an unknown cost (null), which is not the same as a cost of 0. Names are few, so they are matched once each.
    """
    names = calls.select("model").distinct()
    met = names.join(price_table(calls.sparkSession, prices), F.startswith("model", F.col("entry")))
    best = met.groupBy("model").agg(F.max_by(F.struct("entry", "price_in", "price_out"), F.length("entry")).alias("p")).select("model", "p.*")
    out = calls.join(best, "model", "left")
    usd = rounded(F.col("input_tokens") / 1e6 * F.col("price_in") + F.col("output_tokens") / 1e6 * F.col("price_out"), 8)
    return out.withColumn("cost_usd", usd).withColumn("cost_inr", rounded(usd * rate, 6)).drop("price_in", "price_out")


def cost_report(calls: DataFrame, key: str) -> DataFrame:
    """(key, calls, priced, free, avg_input, avg_output, avg_cost_inr): averages over known values; unknown and free are counted apart."""
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.count("cost_inr").alias("priced"),
        F.count_if(F.col("cost_inr") == 0).alias("free"),
        F.round(F.avg("input_tokens"), 2).alias("avg_input"),
        F.round(F.avg("output_tokens"), 2).alias("avg_output"),
        F.round(F.avg("cost_inr"), 6).alias("avg_cost_inr"),
    )


def run_totals(calls: DataFrame, key: str) -> DataFrame:
    """Sums a run; its cost is null if no call is priced."""
    return calls.groupBy(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), rounded(F.sum("cost_usd"), 8).alias("cost_usd"), rounded(F.sum("cost_inr"), 6).alias("cost_inr"))


def benchmark_summary(calls: DataFrame, key: str) -> DataFrame:
    """(key, n, p50, p95, mean): the median interpolates, the 95th percentile is a nearest rank."""
    base = calls.groupBy(key).agg(F.count("*").alias("n"), F.round(F.median("ms"), 1).alias("p50"), F.round(F.avg("ms"), 1).alias("mean"))
    return base.join(nearest_rank(calls, [key], "ms", [95]).select(key, F.round("p95", 1).alias("p95")), key)


def answer_shape(answers: DataFrame, key: str) -> DataFrame:
    """(key, n, citation_rate, avg_chars): the share of answers with a [n] marker."""
    return answers.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(F.col("answer").rlike(r"\[\d+\]").cast("int")), 4).alias("citation_rate"), F.round(F.avg(F.length("answer")), 1).alias("avg_chars"))


def hashed_user(user: Column, salt: str = "") -> Column:
    """Sixteen hex digits of a salted SHA-256; empty for no user."""
    return F.when(F.coalesce(user.cast("string"), F.lit("")) == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), user.cast("string")), 256), 1, 16))
