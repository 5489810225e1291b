"""Meta-analytic pooling of ratio effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import nonblank, text_of

Z = 1.959964


def harmonize(rows: DataFrame) -> DataFrame:
    """Adds ratio_type, log_effect, log_se, poolable and a note."""
    kind = F.upper(F.trim(text_of(F.col("effect_type"))))
    ratio = kind.isin("OR", "HR", "RR")
    there = F.col("effect_value").isNotNull() & F.col("ci_lo").isNotNull() & F.col("ci_hi").isNotNull()
    positive = F.least("effect_value", "ci_lo", "ci_hi") > 0
    poolable = F.coalesce(ratio & there & positive, F.lit(False))
    note = F.when(~ratio, F.concat(F.lit("effect_type '"), kind, F.lit("' not on log-ratio scale"))).when(~there, "missing point or CI bounds").when(~positive, "log-transform failed").otherwise("")
    return rows.withColumns({
        "ratio_type": F.coalesce(nonblank(kind), F.lit("UNKNOWN")),
        "poolable": poolable,
        "log_effect": F.when(poolable, F.ln("effect_value")),
        "log_se": F.when(poolable, (F.ln("ci_hi") - F.ln("ci_lo")) / (2 * Z)),
        "note": note,
    })


def pool(harmonized: DataFrame, by: list[str], random: bool = True) -> DataFrame:
    """Per group: pooled effect with interval, tau2, I2 and number of studies.

    Sums of weights first, squared deviations from the mean in a second pass;
    DerSimonian-Laird tau2, or 0 for fixed effects. Fewer than two studies give
    NULL results with an error text.
    """
    rows = harmonized.filter("poolable and log_se > 0").withColumn("w", 1 / F.pow("log_se", F.lit(2)))
    sums = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.expr("w * log_effect")).alias("swy"), F.sum(F.expr("w * w")).alias("sww"))
    mean = sums.select(*by, "k", "sw", "sww", (F.col("swy") / F.col("sw")).alias("mean"))
    q = rows.join(mean, by).groupBy(*by, "k", "sw", "sww").agg(F.sum(F.expr("w * pow(log_effect - mean, 2)")).alias("q"))
    df = F.col("k") - 1
    tau2 = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - df, F.col("sw") - F.col("sww") / F.col("sw"))) if random else F.lit(0.0)
    q = q.withColumns({"tau2": F.when(F.col("k") > 1, tau2), "i2": F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - df, F.col("q")), F.lit(0.0))) * 100)})
    final = rows.join(q.select(*by, "k", "tau2", "i2"), by).withColumn("v", 1 / (F.pow("log_se", F.lit(2)) + F.coalesce("tau2", F.lit(0.0))))
    out = final.groupBy(*by, "k", "tau2", "i2").agg(F.sum("v").alias("sv"), F.sum(F.expr("v * log_effect")).alias("svy"))
    enough = F.col("k") > 1
    log, se = F.when(enough, F.col("svy") / F.col("sv")), F.when(enough, F.sqrt(1 / F.col("sv")))
    out = out.withColumns({"pooled_log": log, "se": se})
    out = out.withColumns({"pooled": F.exp("pooled_log"), "pooled_lo": F.exp(F.expr(f"pooled_log - {Z} * se")), "pooled_hi": F.exp(F.expr(f"pooled_log + {Z} * se"))})
    return out.select(*by, F.col("k").alias("n"), "pooled_log", "se", "pooled", "pooled_lo", "pooled_hi", "tau2", "i2", F.when(~enough, "fewer than two poolable studies").alias("error"))


def weights(harmonized: DataFrame, pooled: DataFrame, by: list[str]) -> DataFrame:
    """Poolable rows with their share of the group's total weight."""
    rows = harmonized.filter("poolable and log_se > 0").join(pooled.select(*by, "tau2"), by)
    rows = rows.withColumn("v", 1 / (F.pow("log_se", F.lit(2)) + F.coalesce("tau2", F.lit(0.0))))
    sums = rows.groupBy(*by).agg(F.sum("v").alias("sv"))
    return rows.join(sums, by).withColumn("weight", F.col("v") / F.col("sv")).drop("v", "sv", "tau2")


def study_label() -> F.Column:
    name = F.coalesce(nonblank(F.col("cohort_id")), nonblank(F.col("paper_ref")), F.lit("?"))
    predictor = F.coalesce(nonblank(F.col("predictor_canonical")), F.col("predictors"), F.lit(""))
    short = F.when(F.length(predictor) > 32, F.concat(F.substring(predictor, 1, 30), F.lit("…"))).otherwise(predictor)
    return F.when(short != "", F.concat(name, F.lit(" | "), short)).otherwise(name)


def forest(harmonized: DataFrame, by: list[str]) -> DataFrame:
    """Study rows and one pooled row per group: label, point, interval, weight."""
    pooled = pool(harmonized, by)
    studies = weights(harmonized, pooled, by).select(*by, F.lit("study").alias("kind"), study_label().alias("label"), F.col("effect_value").alias("point"), F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"), "weight")
    total = pooled.filter("n > 1").select(*by, F.lit("pooled").alias("kind"), F.lit("Pooled (random effects)").alias("label"), F.col("pooled").alias("point"), F.col("pooled_lo").alias("lo"), F.col("pooled_hi").alias("hi"), F.lit(1.0).alias("weight"))
    return studies.unionByName(total)


def stable_ordinal(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Position of a row within its key."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
