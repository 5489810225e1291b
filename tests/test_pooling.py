import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators import pooling

STUDIES = [("A", 0.10, 0.10), ("B", 0.80, 0.15), ("C", 0.30, 0.12), ("D", 1.20, 0.20), ("E", 0.45, 0.08)]
SCHEMA = "cohort_id string, predictor_canonical string, predictors string, effect_type string, effect_value double, ci_lo double, ci_hi double, paper_ref string"


def frame(spark, studies, kind="OR"):
    rows = [(c, "x", None, kind, math.exp(y), math.exp(y - pooling.Z * s), math.exp(y + pooling.Z * s), None) for c, y, s in studies]
    return pooling.harmonize(spark.createDataFrame(rows, SCHEMA))


def test_five_studies(spark):
    h = frame(spark, STUDIES)
    out = pooling.pool(h, ["predictor_canonical"]).first()
    assert out.n == 5 and out.pooled_log == pytest.approx(0.5376, abs=1e-4) and out.tau2 == pytest.approx(0.10029, abs=1e-4)
    assert out.se == pytest.approx(0.1535, abs=1e-4) and out.i2 == pytest.approx(87.88, abs=0.01)
    weights = [r.weight for r in pooling.weights(h, pooling.pool(h, ["predictor_canonical"]), ["predictor_canonical"]).collect()]
    assert sum(weights) == pytest.approx(1)
    forest = pooling.forest(h, ["predictor_canonical"]).collect()
    assert len(forest) == 6 and [r.label for r in forest if r.kind == "study"][0].endswith("| x")


def test_one_study_and_unpoolable_rows(spark):
    out = pooling.pool(frame(spark, STUDIES[:1]), ["predictor_canonical"]).first()
    assert (out.n, out.pooled, out.error) == (1, None, "fewer than two poolable studies")
    rows = pooling.harmonize(spark.createDataFrame([("c", "x", None, "AUC", 0.8, 0.7, 0.9, None), ("c", "x", None, "OR", 2.0, None, None, None), ("c", "x", None, " or ", -1.0, 0.5, 3.0, None)], SCHEMA))
    assert [r.note for r in rows.collect()] == ["effect_type 'AUC' not on log-ratio scale", "missing point or CI bounds", "log-transform failed"]
    assert rows.filter("poolable").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(0.05, 0.5)), min_size=2, max_size=8))
def test_pooled_value_lies_between_the_studies(spark, studies):
    out = pooling.pool(frame(spark, [(str(i), y, s) for i, (y, s) in enumerate(studies)]), ["predictor_canonical"]).agg(F.first("pooled_log")).first()[0]
    assert min(y for y, _ in studies) - 1e-9 <= out <= max(y for y, _ in studies) + 1e-9
