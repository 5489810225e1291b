"""Numeric checks of claims against their spans, and what goes to a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.effects import parsed, without_helpers
from attesta.functions.text import cohort_size, text_of

FIELDS = ("effect_value", "ci_lo", "ci_hi", "p_value", "auc", "auc_ci_lo", "auc_ci_hi", "sens", "spec", "ppv", "npv", "c_index")
PERCENT = ("sens", "spec", "ppv", "npv", "auc")


def span_numbers(c: Column) -> Column:
    plain = F.regexp_replace(text_of(c), r",(?=\d{3})(?<=\d,)", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def atoms(rows: DataFrame, span: str = "span") -> DataFrame:
    """Adds atoms: array of (field, state) for every field that the claim has; fields without a value cost no search."""
    rows, said = parsed(rows.withColumn("__n", span_numbers(F.col(span))), span, "__p")
    none = F.lit(None).cast("double")

    def given(f: str, v: Column, told: Column = none) -> Column:
        return F.struct(F.lit(f).alias("field"), v.alias("v"), told.alias("told"), F.lit(f in PERCENT).alias("percent"))

    def own(c: str) -> Column:
        return F.col(c).cast("double") if c in rows.columns else none

    def near(v: Column) -> Column:
        return F.exists("__n", lambda x: F.abs(x - v) < 1e-3)

    def judged(g: Column) -> Column:
        v, told = g["v"], g["told"]
        hit = near(v) | (g["percent"] & (near(v * 100) | near(v / 100)))
        state = F.when(hit, "matched").when((told != 0) & (F.abs(told - v) > 1e-3), "contradicted").otherwise("absent")
        return F.struct(g["field"].alias("field"), state.alias("state"))

    size = cohort_size(F.col("cohort_size_n")).cast("double")
    rows = rows.withColumn("__size", size)
    values = [given(f, own(f), said[f]) for f in FIELDS]
    values += [given("cohort_size", F.when(F.col("__size") > 100, F.col("__size"))), given("mortality", own("mortality_rate_pct"))]
    told = F.filter(F.array(*values), lambda g: g["v"].isNotNull())
    return without_helpers(rows.withColumn("atoms", F.transform(told, judged)), "__p").drop("__n", "__size")


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds verdict, score and rationale from atoms."""

    def count(state: str) -> Column:
        return F.size(F.filter("atoms", lambda a: a["state"] == state)).cast("double")

    rows = rows.withColumns({"__s": count("matched"), "__c": count("contradicted"), "__a": count("absent")})
    s, c, a = F.col("__s"), F.col("__c"), F.col("__a")
    support = F.try_divide(s + 0.5 * a, s + a)
    verdict = F.when(c > 0, "reject").when(s + a == 0, "partial").when(support >= 0.7, "ok").otherwise("partial")
    score = F.when(c > 0, F.greatest(F.lit(0.0), s / (s + c) - 0.2)).when(s + a == 0, 0.5).otherwise(support)
    told = F.concat_ws("; ", F.transform("atoms", lambda x: F.concat_ws("=", x["field"], x["state"])))
    return rows.withColumns({"verdict": verdict, "score": score, "rationale": F.substring(told, 1, 400)}).drop("__s", "__c", "__a")


def needs_judge(rows: DataFrame, cross_check: str = "cross_check") -> DataFrame:
    """Adds needs_judge: neither contradicted, nor all matched without a cohort to compare; unresolved anchors bypass."""
    bad = F.exists("atoms", lambda x: x["state"] == "contradicted")
    full = (F.size("atoms") > 0) & F.forall("atoms", lambda x: x["state"] == "matched")
    return rows.withColumn("needs_judge", ~F.coalesce(F.col("anchor_unresolved"), F.lit(False)) & ~bad & ~(full & ~F.col(cross_check)))


def hypotheses(rows: DataFrame) -> DataFrame:
    """Adds hypotheses: sentences that restate the claim in its cohort."""
    days = F.col("outcome_window_days")
    window = F.when(days.isNull(), "").when(days <= 2, "in-hospital ").otherwise(F.concat(days.cast("string"), F.lit("-day ")))
    claim = F.concat(F.col("predictors"), F.lit(" predicts "), window, F.col("outcome_type"), F.lit("."))
    people, place = text_of(F.col("population_description")), text_of(F.col("population_location"))
    who = F.when(people != "", F.concat(F.lit("The study population is "), people, F.lit(".")))
    where = F.when((place != "") & ~F.lower(people).contains(F.lower(place)), F.concat(F.lit("The study was done in "), place, F.lit(".")))
    size = F.when(text_of(F.col("cohort_size_n")) != "", F.concat(F.lit("The cohort has "), F.col("cohort_size_n"), F.lit(" patients.")))
    return rows.withColumn("hypotheses", F.array_compact(F.array(claim, who, where, size)))


def cohort_context(claims: DataFrame, cohorts: DataFrame, columns: list[str]) -> DataFrame:
    """Claims with their cohort's columns where the claim has none of its own."""
    known = cohorts.select("cohort_id", *[F.col(c).alias(f"__{c}") for c in columns])
    out = claims.join(known, "cohort_id", "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") if c in claims.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def reverify_selection(rows: DataFrame, paper: str | None = None, only_missing: bool = False, run_id: str | None = None) -> DataFrame:
    if paper:
        rows = rows.filter(F.lower("paper_ref").like(f"%{paper.lower()}%"))
    if only_missing:
        rows = rows.filter("verifier_verdict is null")
    if run_id:
        rows = rows.filter(F.col("run_id").isNull() | (F.col("run_id") != run_id))
    return rows
