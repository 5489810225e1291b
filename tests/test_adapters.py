from pyspark.sql import functions as F

from attesta.plans.evidence import evidence
from attesta.sources.adapters import EVIDENCE, view

SF = "/root/testdata/sf0.001"


def test_narrow_evidence_has_the_rows_of_the_view(spark):
    plain, narrow = view(spark, SF, EVIDENCE), evidence(spark, SF)
    assert narrow.schema.names == plain.schema.names
    assert narrow.count() == plain.count()
    assert narrow.exceptAll(plain).isEmpty() and plain.exceptAll(narrow).isEmpty()
    assert not narrow.filter(F.col("paper_ref").isNull()).isEmpty()  # orphans are there


def test_no_text_of_evidence_is_made_below_a_join(spark):
    plan = evidence(spark, SF).select("row_id", "anchor_text", "paper_ref")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" in plan and "concat(" not in plan[plan.index("Join") :]
