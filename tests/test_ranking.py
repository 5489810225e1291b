"""The seven-row ranking fixture and its expected order."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from attesta.operators import dedupe, filters, rank

ROWS = [
    ("r1", "A1", "SOFA", "AUC", 0.85, 0.80, 0.90),
    ("r2", "B1", "SOFA", "AUC", 0.80, None, None),
    ("r3", "A2", "lactate", "AUC", 0.78, None, None),
    ("r4", "A1", "qSOFA", "OR", 3.5, 2.1, 5.8),
    ("r5", "B1", "qSOFA", "OR", 1.8, None, None),
    ("r6", "B1", "APACHE_II", "HR", 2.0, None, None),
    ("r7", "A1", None, "OR", 4.2, None, None),
]
SCHEMA = "row_id string, cohort_id string, predictor_canonical string, effect_type string, v double, ci_lo double, ci_hi double"


@pytest.fixture
def evidence(spark):
    auc = F.when(F.col("effect_type") == "AUC", F.col("v"))
    blank = F.lit(None).cast("string")
    return (
        spark.createDataFrame(ROWS, SCHEMA)
        .withColumns({"auc": auc, "effect_value": F.when(auc.isNull(), F.col("v")), "c_index": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double"), "verifier_score": F.lit(None).cast("double")})
        .withColumns({c: blank for c in ("predictors", "effect_size_str", "verifier_verdict", "cohort_label", "cohort_size_n", "population_description", "population_location")})
        .withColumns({"outcome": F.lit("28-day mortality"), "outcome_type": F.lit("mortality"), "outcome_window_days": F.lit(28), "anchor_page": F.lit(1)})
        .withColumn("paper_ref", F.when(F.col("cohort_id").startswith("A"), "Alpha 2024").otherwise("Beta 2025"))
    )


def ranked(rows, window=28, paper=None):
    rows = filters.rank_filter(rows, "mortality", paper_ref=paper)
    clean = lambda df: filters.drop_rejected(dedupe.cross_cohort(dedupe.exact_evidence(df)))
    return filters.relax_window(rows, window, ranking=True, clean=clean)


def order(rows):
    return [r.predictor_canonical for r in rank.top_rows(rank.rank_predictors(rows), *rank.ranking_order(), limit=50).orderBy("position").collect()]


def test_order_and_studies(evidence):
    rows = ranked(evidence)
    assert order(rows) == ["SOFA", "lactate", "qSOFA", "APACHE_II"]
    sofa = rank.rank_predictors(rows).filter("predictor_canonical = 'SOFA'").first()
    assert (sofa.n_studies, sofa.best_value, sofa.best_metric) == (2, 0.85, "AUC") and sofa.median_value == pytest.approx(0.825)
    qsofa = rank.rank_predictors(rows).filter("predictor_canonical = 'qSOFA'").first()
    assert (qsofa.best_value, qsofa.best_ci_lo, qsofa.best_ci_hi) == (3.5, 2.1, 5.8)
    support = rank.supporting_rows(rows, rank.rank_predictors(rows)).filter("predictor_canonical = 'SOFA'").orderBy("position").collect()
    assert [r.row_id for r in support] == ["r1", "r2"]


def test_snap_and_filter(evidence):
    rows = ranked(evidence, window=27)
    assert {r.note for r in rows.collect()} == {"No studies report 27-day; snapped to 28-day."}
    assert order(ranked(evidence, paper="Alpha 2024")) == ["SOFA", "lactate", "qSOFA"]
    assert {r.note for r in ranked(evidence, window=90).collect()} == {"No exact match for 90-day; showing all windows for this outcome."}
    assert ranked(evidence.filter(F.lit(False))).count() == 0


def test_window_ties_take_the_smaller(spark):
    tiers = spark.createDataFrame([(28,), (30,), (29,), (60,), (None,)], "w int").select("w", filters.window_tier(F.col("w"), 29).alias("t")).collect()
    assert {r.w: r.t for r in tiers} == {28: 1, 30: 2, 29: 0, 60: 3, None: 3}


def test_dedupe_is_idempotent(evidence):
    once = dedupe.cross_cohort(dedupe.exact_evidence(evidence))
    again = dedupe.cross_cohort(dedupe.exact_evidence(once.drop("ord")))
    assert sorted(r.row_id for r in once.collect()) == sorted(r.row_id for r in again.collect())


def test_rejected_first_copy_hides_the_accepted_second(evidence):
    one = evidence.filter("row_id = 'r1'").withColumn("verifier_verdict", F.lit("reject"))
    two = evidence.filter("row_id = 'r1'").withColumns({"row_id": F.lit("r9"), "verifier_verdict": F.lit("ok")})
    assert ranked(one.unionByName(two)).filter("outcome_window_days = 28").count() == 0


def test_medians_by_counting(spark):
    rng = random.Random(51)
    values = {"even": [rng.gauss(0, 1) for _ in range(200)], "odd": [float(rng.randint(-5, 5)) for _ in range(151)], "same": [2.5] * 90, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(120)], "ends": [-1.7e308] * 30 + [1.7e308] * 31, "few": [3.0, 1.0], None: [1.0] * 40}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own] + [("few", None)], "g string, v double").repartition(3)
    got = {r.g: (r.median, r.k) for r in rank.medians(rows.filter("g is not null"), ["g"], "v", few=20, buckets=8).collect()}
    assert got == {k: (statistics.median(own), len(own)) for k, own in values.items() if k}
    assert rank.medians(rows.limit(0), ["g"], "v").count() == 0


def test_distinct_facts_are_both_passes_in_one_reading(evidence):
    for scored in (True, False):
        want = dedupe.cross_cohort(dedupe.exact_evidence(evidence), scored).select("row_id", "auc", "ord")
        got = dedupe.distinct_facts(evidence, ["auc"], scored)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 2


def test_first_of_a_key_is_found_without_a_join(evidence):
    plan = dedupe.exact_evidence(evidence)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
