"""Forms of large jobs: what is shuffled, sorted, written and compiled."""

from pyspark.sql import functions as F

from attesta.operators import ingest, telemetry
from attesta.plans.evidence import evidence
from attesta.sources import adapters
from attesta.sources.adapters import EVIDENCE, MODELS, plain, view

SF = "/root/testdata/sf0.001"


def _plan(rows) -> str:
    return rows._jdf.queryExecution().sparkPlan().toString()


def test_lines_are_not_sorted_for_their_orders_and_parts(spark):
    plan = _plan(evidence(spark, SF))
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 3
    assert "SortMergeJoin" not in _plan(view(spark, SF, MODELS))


def test_spark_forms_equal_the_sql(spark):
    for text, rows in ((EVIDENCE, evidence(spark, SF)), (MODELS, view(spark, SF, MODELS))):
        for t in ("lineitem", "part", "orders", "customer", "nation"):
            spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
        told = spark.sql(plain(text)).select(rows.columns)
        assert rows.count() == told.count() and rows.exceptAll(told).isEmpty()
    assert adapters.MODELS_NARROW != MODELS


def test_export_casts_only_what_has_another_type(spark):
    rows = spark.createDataFrame([("a", "7", "", 0.5), ("b", "x", "t", None)], "row_id string, cohort_size_n string, title string, auc double")
    out = ingest.export_rows(rows.withColumn("anchor_page", F.lit(3)).withColumn("anchor_text", F.col("title")).withColumn("ci_lo", F.col("title")))
    assert out.dtypes == list(ingest.EXPORT)
    assert [tuple(r) for r in out.select("row_id", "cohort_size_n", "auc", "anchor_page", "anchor_text", "ci_lo").collect()] == [("a", 7, 0.5, 3, None, None), ("b", None, None, 3, "t", None)]
    assert _plan(out).lower().count("cast(") <= 6  # the two texts that become numbers, not 29 columns


def test_a_write_back_sorts_neither_side(spark):
    rows = spark.range(50).selectExpr("cast(id as string) AS id", "'ok' AS v")
    new = spark.range(40, 60).selectExpr("cast(id as string) AS id", "if(id % 2 = 0, 'reject', null) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written, counts = telemetry.write_back(rows, new, "id", ["v"]), telemetry.write_back_counts(rows, new, "id", ["v"])
        for out in (written, counts):
            plan = _plan(out)
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(int(r.id) for r in written.filter("v = 'reject'").collect()) == [40, 42, 44, 46, 48] and written.count() == 50
        assert tuple(counts.first()) == (20, 10, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
