"""Cost and quality of logged model calls; run and verdict reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.versions import Versions

MEASURES = (("n_calls", F.count, "call_id"), ("cost", F.sum, "cost_microusd"), ("tokens_in", F.sum, "tokens_in"), ("tokens_out", F.sum, "tokens_out"))


def measures() -> list[Column]:
    return [F.coalesce(f(c), F.lit(0)).cast("long").alias(n) for n, f, c in MEASURES]


def named(c: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "unknown").otherwise(F.col(c))


def since(text: str) -> Column:
    """Instant of an ISO-8601 text with T or a space."""
    return F.to_timestamp(F.lit(text.replace("T", " ")))


def cost_report(calls: DataFrame, run_id: str | None = None, after: str | None = None) -> DataFrame:
    """(level, name, measures): totals, by stage and by model, in one pass over the log."""
    if run_id:
        calls = calls.filter(F.col("run_id") == run_id)
    if after:
        calls = calls.filter(F.col("ts") > since(after))
    calls = calls.withColumns({"s": named("stage"), "m": named("model")})
    out = calls.groupingSets([[], ["s"], ["m"]], "s", "m").agg(*measures(), F.grouping("s").alias("gs"), F.grouping("m").alias("gm"))
    level = F.when(F.col("gs") == 0, "stage").when(F.col("gm") == 0, "model").otherwise("total")
    return out.select(level.alias("level"), F.coalesce("s", "m", F.lit("")).alias("name"), *[m[0] for m in MEASURES])


def allocate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per-call cost, tokens and latency split evenly over the call's rows: adds *_share columns."""
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumns({"cost_share": F.col("cost") / n, "tokens_share": F.floor(F.col("tokens") / n), "latency_share": F.floor(F.col("latency") / n)})


def undo_repeated_cost(rows: DataFrame, call: list[str], by: list[str]) -> DataFrame:
    """Cost that every row of a call repeats: greatest per call, then summed."""
    return rows.groupBy(*call, *by).agg(F.max("cost").alias("cost")).groupBy(*by).agg(F.sum("cost").alias("cost"))


def call_quality(calls: DataFrame) -> DataFrame:
    """Per stage: calls, error rate, share of input tokens read from a cache, cost with unbilled calls imputed
    from tokens (micro-dollars)."""
    imputed = F.when(F.col("cost_microusd") > 0, F.col("cost_microusd")).otherwise(F.col("tokens_in") + 5 * F.col("tokens_out"))
    cached = F.try_divide(F.sum(F.coalesce("tokens_cached", F.lit(0))), F.sum("tokens_in"))
    return calls.groupBy(named("stage").alias("stage")).agg(F.count("*").alias("n_calls"), F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"), cached.alias("cache_share"), F.sum(imputed).alias("cost"))


VERDICTS = ("ok", "partial", "reject")


def run_manifest(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals of a run, in one row: cohorts, rows, rows of each verdict and without one, calls, cost, latency."""
    verdict = F.lower(F.trim(F.coalesce("verifier_verdict", F.lit(""))))
    counts = [F.count_if(verdict == v).alias(f"n_{v}") for v in VERDICTS]
    told = rows.agg(F.countDistinct("cohort_id").alias("n_cohorts"), F.count("*").alias("n_rows"), *counts, F.count_if(~verdict.isin(*VERDICTS)).alias("n_other"))
    zero = F.lit(0)
    spent = calls.agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("cost_microusd"), zero).alias("cost"), F.coalesce(F.sum("latency_ms"), zero).alias("latency_ms"))
    return told.join(F.broadcast(spent), F.lit(True))  # one row each


def reverify_report(results: DataFrame) -> DataFrame:
    """(old, new, n, flipped, cost, cache_hits, errors) of re-verified rows
    (old, new, cost_microusd, cache_hit, error); a failed call keeps the old verdict."""
    old = F.coalesce("old", F.lit("none"))
    new = F.when(F.col("error").isNotNull(), old).otherwise(F.coalesce("new", F.lit("none")))
    rows = results.select(old.alias("old"), new.alias("new"), "cost_microusd", "cache_hit", "error")
    paid = F.sum(F.when(F.coalesce("cache_hit", F.lit(False)), 0).otherwise(F.coalesce("cost_microusd", F.lit(0))))
    out = rows.groupBy("old", "new").agg(F.count("*").alias("n"), paid.alias("cost"), F.count_if("cache_hit").alias("cache_hits"), F.count("error").alias("errors"))
    return out.withColumn("flipped", F.col("old") != F.col("new"))


def write_back(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the updates' non-NULL values. Rows are hashed to the updates, which are fewer: neither side is sorted."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new.hint("shuffle_hash"), key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def publish_verdicts(table: Versions, updates: DataFrame, key: str, columns: list[str], dry_run: bool = False) -> DataFrame:
    """Write updates back as the next version of the table, which is returned; a dry run changes nothing and returns
    what the same version would change."""
    if dry_run:
        return write_back_counts(table.read(), updates, key, columns)
    return table.read(table.change(lambda rows: write_back(rows, updates, key, columns)))


def write_back_counts(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What write_back would do, in one row: updates, updates of unknown keys, and changed values of each column."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__u"))
    both = new.hint("shuffle_hash").join(rows.select(key, *columns, F.lit(True).alias("__r")), key, "left")
    changed = [F.count_if(F.col("__r") & F.col(f"__{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"changed_{c}") for c in columns]
    return both.agg(F.count("__u").alias("n_updates"), F.count_if(F.col("__r").isNull()).alias("n_unknown"), *changed)
