from pyspark.sql import functions as F

from attesta.operators import catalog, ingest, questions, rank, telemetry


def test_reverification_keeps_the_old_verdict_of_failed_calls(spark):
    rows = spark.createDataFrame([("ok", "reject", 10, False, None), ("ok", "reject", 10, True, None), (None, "ok", 5, None, "timeout")], "old string, new string, cost_microusd long, cache_hit boolean, error string")
    got = {(r.old, r.new): (r.n, r.cost, r.cache_hits, r.errors, r.flipped) for r in telemetry.reverify_report(rows).collect()}
    assert got == {("ok", "reject"): (2, 10, 1, 0, True), ("none", "none"): (1, 5, 0, 1, False)}


def test_dry_run_counts_what_a_write_back_changes(spark):
    rows = spark.createDataFrame([(1, "ok", None), (2, None, 0.5), (3, "ok", 0.1)], "id int, v string, s double")
    new = spark.createDataFrame([(1, "ok", 0.2), (2, "reject", None), (9, "ok", 1.0)], "id int, v string, s double")
    assert tuple(telemetry.write_back_counts(rows, new, "id", ["v", "s"]).first()) == (3, 1, 1, 1)
    assert {tuple(r) for r in telemetry.write_back(rows, new, "id", ["v", "s"]).collect()} == {(1, "ok", 0.2), (2, "reject", 0.5), (3, "ok", 0.1)}


def test_phenotypes(spark):
    given = spark.createDataFrame([("a", True, [(1, 5)]), ("b", False, [(1, 6)]), ("c", None, None)], "study string, positive boolean, clusters array<struct<label:int,size:int>>")
    summaries, clusters, done = ingest.ingest_phenotypes(given)
    assert [r.study for r in summaries.collect()] == ["a"] and clusters.count() == 1 and {r.study for r in done.collect()} == {"a", "b", "c"}
    facts = spark.createDataFrame([("a", 1, "ok"), ("b", None, None)], "study string, anchor_page int, verifier_verdict string")
    got = {(r.study, r.overall): (r.n, r.n_anchored, r.n_ok) for r in catalog.phenotype_diagnostics(facts, facts.limit(0)).collect()}
    assert got == {("a", False): (1, 1, 1), ("b", False): (1, 0, 0), (None, True): (2, 1, 1)}


def test_quality_and_manifest(spark):
    kind = "row_id string, paper_ref string, anchor_page int, anchor_bbox string, found_bbox string, verifier_verdict string"
    rows = spark.createDataFrame([("1", "p", 1, "1,2,3,4", "1,2,3,4.005", "ok"), ("2", "p", None, "1,2,3,4", "1,2,3,5", "Reject"), ("3", "p", 1, None, "1,2,3,4", None), ("4", "p", 1, "1,2", "1,2", "ok")], kind)
    r = catalog.quality_rates(rows, ["paper_ref"]).first()
    assert (r.bound_rate, r.bbox_rate, r.reject_rate) == (0.75, 1 / 3, 0.25)
    one = catalog.export_manifest(rows, ["row_id", "anchor_bbox"], "now").first()
    other = catalog.export_manifest(rows.orderBy(F.desc("row_id")), ["row_id", "anchor_bbox"], "now").first()
    assert one == other and one.n_rows == 4 and one != catalog.export_manifest(rows.filter("row_id < '4'"), ["row_id", "anchor_bbox"], "now").first()


def test_overlap_and_coverage(spark):
    ranked = spark.createDataFrame([("a", "AUC", 0, 0.9, 3, "1"), ("b", "AUC", 0, 0.8, 2, "2"), ("c", "OR", 2, 3.0, 1, "3")], "predictor_canonical string, best_metric string, metric_rank int, best_value double, n_studies int, first_ord string")
    assert {tuple(r) for r in rank.coverage(ranked).collect()} == {("AUC", 2), ("c_index", 0), ("OR", 1), ("HR", 0), ("RR", 0)}
    assert tuple(rank.top_overlap(ranked, spark.createDataFrame([("b",), ("c",)], "predictor_canonical string"), k=2, least=1).first()) == (2, 1, "b", True)


def test_question_log(spark, tmp_path):
    asked = spark.createDataFrame([(1, "sepsis"), (2, "AUC of lactate"), (3, None)], "id int, question string")
    questions.append_log(questions.logged(asked, F.lit(7), F.lit(12)), str(tmp_path / "log"))
    got = {r.id: (r.intent_json, r.answered, r.n_rows, r.latency_ms) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {1: ('{"condition":"sepsis","intent":"lookup"}', False, 0, 12), 2: ('{"predictor":"lactate","intent":"lookup"}', True, 7, 12), 3: ('{"intent":"lookup"}', False, 0, 12)}
