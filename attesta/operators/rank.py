"""Relevance, display order and the ranking of predictors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import relevance, text_of
from attesta.sources.staging import stage

PRIORITY = ("AUC", "c_index", "OR", "HR", "RR")
RELEVANT = ("paper_ref", "cohort_label", "predictors", "outcome", "model_specification", "effect_size_str", "population_description")


def score_rows(rows: DataFrame, question: str) -> DataFrame:
    """Adds score; rejected rows sink by 10."""
    text = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in RELEVANT])
    sunk = F.when(F.lower(text_of(F.col("verifier_verdict"))) == "reject", 10.0).otherwise(0.0)
    return rows.withColumn("score", relevance(F.lit(question), text) - sunk)


def top_rows(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first rows in an order, numbered from 1: a top-k, then a window over its few rows."""
    return rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def medians(values: DataFrame, keys: list[str], value: str, few: int = 10_000, buckets: int = 1024) -> DataFrame:
    """(keys, median, k) of each group's values, exact.

    Groups of up to ``few`` values are aggregated as they are. In larger ones the ranks in the middle are found by
    counting: values are counted in equal ranges, the range that holds a rank is cut anew between its least and its
    greatest value, until these are one. No task or group ever holds a group's values, only its counts.
    """
    rows = values.select(*keys, F.col(value).alias("v")).filter("v is not null")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    small = whole.filter(F.col("k") <= few)
    exact = rows.join(small.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.median("v").alias("median"), F.count("*").alias("k"))
    large = stage(whole.filter(F.col("k") > few).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor((F.col("k") - 1) / 2), F.floor(F.col("k") / 2))))).withColumn("want", F.col("rank")), "ranks")
    found = []
    while not large.isEmpty():
        done = large.filter("lo = hi").select(*keys, "k", "rank", F.col("lo").alias("v"))
        found.append(done)
        left = large.filter("lo < hi")
        if left.isEmpty():
            break
        inside = rows.join(left, keys).filter("v between lo and hi")
        # halves first: the width of the widest range of doubles is not a double
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))
        counts = inside.withColumn("b", at).groupBy(*keys, "k", "rank", "want", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counts.withColumn("before", before).filter("want >= before and want < before + n")
        large = stage(chosen.select(*keys, "k", "lo", "hi", "rank", (F.col("want") - F.col("before")).alias("want")), "ranks")
    if not found:
        return exact
    return exact.unionByName(reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.avg("v").alias("median"), F.first("k").alias("k")))


def metric_value(metric: str) -> Column:
    if metric in ("AUC", "c_index"):
        return F.col(metric.lower()).cast("double")
    return F.when(F.upper("effect_type") == metric, F.col("effect_value").cast("double"))


def rankable(rows: DataFrame) -> DataFrame:
    return rows.filter("coalesce(auc, c_index, effect_value) is not null and coalesce(predictor_canonical, '') <> ''")


def rank_predictors(rows: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """One row per predictor: its first metric that has values, the best value and where it stands.

    Aggregations with partial combine; the median of the values is counted (``medians``). ``ord`` is the order of the rows.
    """
    rows = rankable(rows)
    studies = rows.groupBy("predictor_canonical").agg(F.countDistinct(F.when(F.col("cohort_id") != "", F.col("cohort_id"))).alias("d"), F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    studies = studies.select("predictor_canonical", "first_ord", F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("n")).alias("n_studies"))
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("metric"), metric_value(m).alias("value")) for i, m in enumerate(priority)])
    values = rows.select("predictor_canonical", "ord", "ci_lo", "ci_hi", "paper_ref", "cohort_id", F.explode(each).alias("m")).filter("m.value is not null")
    good = F.when(F.col("m.rank") < 2, F.col("m.value")).otherwise(F.abs(F.col("m.value") - 1))
    best = F.struct("m.value", "ci_lo", "ci_hi", "paper_ref", "cohort_id", "ord")
    per = values.groupBy("predictor_canonical", F.col("m.rank").alias("rank"), F.col("m.metric").alias("metric")).agg(
        F.min_by(best, F.struct(-good, F.col("ord"))).alias("best")
    )
    chosen = per.groupBy("predictor_canonical").agg(F.min(F.struct("rank", "metric", "best")).alias("c"))
    asked = values.select("predictor_canonical", F.col("m.rank").alias("rank"), F.col("m.value").alias("value"))
    asked = asked.join(chosen.select("predictor_canonical", F.col("c.rank").alias("rank")), ["predictor_canonical", "rank"], "left_semi")
    middle = medians(asked, ["predictor_canonical"], "value")
    ratio = F.col("c.rank") >= 2
    return chosen.join(studies, "predictor_canonical").join(middle, "predictor_canonical").select(
        "predictor_canonical", "n_studies", F.col("c.metric").alias("best_metric"), F.col("c.best.value").alias("best_value"),
        F.when(ratio, F.col("c.best.ci_lo")).alias("best_ci_lo"), F.when(ratio, F.col("c.best.ci_hi")).alias("best_ci_hi"),
        F.col("c.best.paper_ref").alias("best_paper_ref"), F.col("c.best.cohort_id").alias("best_cohort_id"),
        F.when(F.col("k") >= 2, F.col("median")).alias("median_value"), F.col("c.rank").alias("metric_rank"), F.col("c.best.ord").alias("best_ord"), "first_ord",
    )


def ranking_order() -> list[Column]:
    strength = F.when(F.col("metric_rank") < 2, F.col("best_value")).otherwise(F.abs(F.col("best_value") - 1))
    return [F.col("metric_rank"), strength.desc(), F.col("n_studies").desc(), F.col("first_ord")]


def supporting_rows(rows: DataFrame, ranked: DataFrame, most: int = 20) -> DataFrame:
    """(predictor, position, row): the best row, then up to ``most`` - 1 others in order."""
    rows = rankable(rows).join(ranked.select("predictor_canonical", "best_ord"), "predictor_canonical")
    order = Window.partitionBy("predictor_canonical").orderBy((F.col("ord") != F.col("best_ord")).cast("int"), "ord")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).drop("best_ord")


def coverage(ranked: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """(best_metric, n_predictors) for every metric of the priority, 0 included."""
    metrics = ranked.sparkSession.createDataFrame([(m,) for m in priority], "best_metric string")
    counts = ranked.groupBy("best_metric").agg(F.count("*").alias("n"))
    return metrics.join(counts, "best_metric", "left").select("best_metric", F.coalesce("n", F.lit(0)).alias("n_predictors"))


def top_overlap(ranked: DataFrame, targets: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """One row: how many of the first k predictors are among the targets (predictor_canonical), which, and whether
    they are at least ``least``."""
    top = ranked.orderBy(*ranking_order()).limit(k).select("predictor_canonical")
    seen = top.join(targets.select("predictor_canonical").distinct().withColumn("hit", F.lit(True)), "predictor_canonical", "left")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("predictor_canonical")))), ",")
    return seen.agg(F.count("*").alias("n_top"), F.count("hit").alias("n_overlap"), names.alias("overlap")).withColumn("passed", F.col("n_overlap") >= least)
