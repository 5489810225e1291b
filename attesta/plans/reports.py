"""Catalog, telemetry and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import catalog, rank, telemetry
from attesta.plans.evidence import EV, RANK_ORDER, RANKED, cleaned, evidence
from attesta.plans.registry import query
from attesta.sources.adapters import CALLS, COHORTS, MODELS, PAPERS, view
from attesta.sources.staging import shared_folder
from attesta.sources.versions import Versions

_STEM = "regexp_replace(file_name, '(?i)\\.pdf$', '')"
_BUCKET = "CASE lower(trim(coalesce(verifier_verdict, ''))) WHEN 'ok' THEN 'ok' WHEN 'pass' THEN 'ok' WHEN 'weak' THEN 'weak' WHEN 'warn' THEN 'weak' WHEN 'partial' THEN 'weak' WHEN 'fail' THEN 'fail' WHEN 'reject' THEN 'fail' ELSE 'unverified' END"
LISTING = "SELECT concat(replace(n_name, ' ', '_'), '_', CAST(1990 + n_nationkey AS VARCHAR(8))) AS stem FROM {nation} WHERE n_nationkey % 3 = 0"
_CATALOG = f"""(WITH k AS (SELECT {_STEM} AS stem, count(DISTINCT c.cohort_id) AS n_cohorts, count(row_id) AS n_rows, {', '.join(f"count(*) FILTER (row_id IS NOT NULL AND {_BUCKET} = '{b}') AS n_{b}" for b in catalog.BUCKETS)} FROM ({COHORTS}) c LEFT JOIN ({MODELS}) m ON m.cohort_id = c.cohort_id GROUP BY 1),
p AS (SELECT {_STEM} AS stem, title, year FROM ({PAPERS}))
SELECT coalesce(p.stem, k.stem) AS stem, title, coalesce(year, TRY_CAST(regexp_extract(coalesce(p.stem, k.stem), '_(\\d{{4}})(_|$)', 1) AS INT)) AS year, coalesce(n_cohorts, 0) AS n_cohorts, coalesce(n_rows, 0) AS n_rows, {', '.join(f'coalesce(n_{b}, 0) AS n_{b}' for b in catalog.BUCKETS)}, coalesce(p.stem, k.stem) IN (SELECT stem FROM ({LISTING})) AS parsed FROM p FULL JOIN k ON p.stem = k.stem)"""


def _catalog(spark, d):
    return catalog.catalog(view(spark, d, PAPERS), view(spark, d, COHORTS), view(spark, d, MODELS), view(spark, d, LISTING))


@query("a01_catalog", f"SELECT * FROM {_CATALOG}")
def _(spark, d):
    return _catalog(spark, d)


@query("j03_cohorts_with_counts", f"SELECT cohort_id, count(row_id) AS n_rows FROM (SELECT c.cohort_id, row_id FROM ({COHORTS}) c LEFT JOIN ({MODELS}) m ON m.cohort_id = c.cohort_id) GROUP BY 1")
def _(spark, d):
    counts = view(spark, d, MODELS).groupBy("cohort_id").agg(F.count("*").alias("n_rows"))
    return view(spark, d, COHORTS).select("cohort_id").join(counts, "cohort_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query("j04_catalog_keys", f"SELECT stem FROM {_CATALOG}")
def _(spark, d):
    return _catalog(spark, d).select("stem")


@query("j12_known_keys", f"SELECT DISTINCT {_STEM} AS stem FROM ({COHORTS}) WHERE file_name LIKE '%1_%'")
def _(spark, d):
    keys = view(spark, d, COHORTS).filter("file_name like '%1_%'").select(F.regexp_replace("file_name", r"\.pdf$", "").alias("stem")).distinct()
    unknown = keys.select(F.concat(F.lit("no_"), "stem").alias("stem"))
    return catalog.known_keys(keys.unionByName(unknown), view(spark, d, PAPERS), view(spark, d, COHORTS))


@query("j13_document_states", f"SELECT stem, stem IN (SELECT stem FROM ({LISTING})) AS parsed, contains(stem, 'A') AS translated FROM (SELECT DISTINCT {_STEM} AS stem FROM ({COHORTS}))")
def _(spark, d):
    docs = view(spark, d, COHORTS).select(F.regexp_replace("file_name", r"\.pdf$", "").alias("stem")).distinct()
    names = view(spark, d, LISTING).select(F.concat("stem", F.lit(".json")).alias("name"))
    names = names.unionByName(docs.filter(F.col("stem").contains("A")).select(F.concat("stem", F.lit(".pre-translate.json")).alias("name")))
    return catalog.document_states(docs, names)


_SUMMARY = "SELECT o_orderkey AS summary_id, o_orderstatus AS method FROM {orders}"
_CLUSTER = "SELECT l_orderkey AS summary_id, CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS cluster_label, CAST(CAST(l_quantity AS INT) AS VARCHAR(8)) AS cluster_size FROM {lineitem}"


@query("j06_nested_clusters", f"SELECT summary_id, method, string_agg(concat(label, ':', size), ',' ORDER BY label, size) FILTER (size IS NOT NULL) AS clusters FROM (SELECT s.summary_id, s.method, coalesce(cluster_label, '') AS label, cluster_size AS size FROM ({_SUMMARY}) s LEFT JOIN ({_CLUSTER}) c ON c.summary_id = s.summary_id) GROUP BY ALL")
def _(spark, d):
    out = catalog.nest_clusters(view(spark, d, _SUMMARY), view(spark, d, _CLUSTER))
    return out.withColumn("clusters", F.array_join(F.transform("clusters", lambda c: F.concat_ws(":", c["label"], c["size"])), ","))


@query("p19_verdict_buckets", f"SELECT row_id, {_BUCKET} AS bucket FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", catalog.bucket(F.col("verifier_verdict")).alias("bucket"))


@query("l06_catalog_sort", f"SELECT stem, n_rows, row_number() OVER (ORDER BY n_rows DESC, stem) AS position FROM {_CATALOG} ORDER BY position LIMIT 10")
def _(spark, d):
    return rank.top_rows(_catalog(spark, d), *catalog.catalog_order("n_rows"), limit=10).select("stem", "n_rows", "position")


@query("l07_evidence_sort", f"SELECT row_id, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(coalesce(effect_size_str, ''), '-?\\d+(?:\\.\\d+)?') AS DOUBLE), 'infinity'::DOUBLE), row_id) AS position FROM {EV} ORDER BY position LIMIT 100")
def _(spark, d):
    return rank.top_rows(evidence(spark, d), *catalog.evidence_order("effect"), limit=100).select("row_id", "position")


_M = "count(*) AS n_calls, CAST(coalesce(sum(cost_microusd), 0) AS BIGINT) AS cost, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out"
_C = f"(SELECT * FROM ({CALLS}) WHERE run_id = 'run_1' AND ts > TIMESTAMP '2024-01-02 00:00:00')"


@query("a02_cost_report", f"SELECT 'total' AS level, '' AS name, {_M} FROM {_C} UNION ALL SELECT 'stage', coalesce(stage, 'unknown'), {_M} FROM {_C} GROUP BY 2 UNION ALL SELECT 'model', coalesce(model, 'unknown'), {_M} FROM {_C} GROUP BY 2")
def _(spark, d):
    return telemetry.cost_report(view(spark, d, CALLS), "run_1", "2024-01-02T00:00:00")


@query("f32_timestamp_bound", f"SELECT call_id FROM ({CALLS}) WHERE ts > TIMESTAMP '2024-01-03 12:00:00'")
def _(spark, d):
    return view(spark, d, CALLS).filter(F.col("ts") > telemetry.since("2024-01-03T12:00:00")).select("call_id")


_V = "lower(trim(coalesce(verifier_verdict, '')))"


@query("a09_run_manifest", f"SELECT * FROM (SELECT count(DISTINCT cohort_id) AS n_cohorts, count(*) AS n_rows, count(*) FILTER ({_V} = 'ok') AS n_ok, count(*) FILTER ({_V} = 'partial') AS n_partial, count(*) FILTER ({_V} = 'reject') AS n_reject, count(*) FILTER ({_V} NOT IN ('ok', 'partial', 'reject')) AS n_other FROM {EV}), (SELECT count(*) AS n_calls, CAST(sum(cost_microusd) AS BIGINT) AS cost, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM ({CALLS}) WHERE run_id = 'run_1')")
def _(spark, d):
    return telemetry.run_manifest(evidence(spark, d), view(spark, d, CALLS).filter("run_id = 'run_1'"))


_NEW = "CASE WHEN verifier_score > 0.5 AND verifier_verdict = 'partial' THEN 'ok' WHEN anchor_page = 3 THEN 'reject' ELSE verifier_verdict END"
_AGAIN = f"SELECT row_id, verifier_verdict AS old, {_NEW} AS new, CAST(anchor_page * 10 AS BIGINT) AS cost_microusd, anchor_page IN (2, 4) AS cache_hit, CASE WHEN anchor_page = 7 THEN 'timeout' END AS error FROM ({MODELS})"
_AFTER = "CASE WHEN error IS NULL THEN coalesce(new, 'none') ELSE coalesce(old, 'none') END"


@query("a10_reverify_report", f"SELECT coalesce(old, 'none') AS old, {_AFTER} AS new, count(*) AS n, coalesce(old, 'none') <> {_AFTER} AS flipped, CAST(sum(CASE WHEN cache_hit THEN 0 ELSE cost_microusd END) AS BIGINT) AS cost, count(*) FILTER (cache_hit) AS cache_hits, count(error) AS errors FROM ({_AGAIN}) GROUP BY 1, 2")
def _(spark, d):
    return telemetry.reverify_report(view(spark, d, _AGAIN))


_PAGE3 = f"SELECT row_id, 'reject' AS verifier_verdict, 0.25 AS verifier_score, CASE WHEN anchor_bbox IS NULL THEN '0,0,1,1' END AS anchor_bbox FROM ({MODELS}) WHERE anchor_page = 3"
_WRITTEN = ["verifier_verdict", "verifier_score", "anchor_bbox"]


def _stored(spark, d) -> Versions:
    table = Versions(spark, shared_folder(spark))
    table.publish(evidence(spark, d).select("row_id", *_WRITTEN), 0)
    return table


@query("s07_write_back_verdicts", f"SELECT row_id, CASE WHEN anchor_page = 3 THEN 'reject' ELSE verifier_verdict END AS verifier_verdict, CASE WHEN anchor_page = 3 THEN 0.25 ELSE verifier_score END AS verifier_score, CASE WHEN anchor_page = 3 THEN coalesce(anchor_bbox, '0,0,1,1') ELSE anchor_bbox END AS anchor_bbox FROM {EV}")
def _(spark, d):
    updates = view(spark, d, _PAGE3).withColumn("verifier_score", F.col("verifier_score").cast("double"))
    return telemetry.publish_verdicts(_stored(spark, d), updates, "row_id", _WRITTEN)


@query("s07_write_back_dry_run", f"SELECT 2 * count(*) AS n_updates, count(*) AS n_unknown, count(*) FILTER (verifier_verdict IS DISTINCT FROM 'reject') AS changed_verifier_verdict, count(*) FILTER (verifier_score IS DISTINCT FROM 0.25) AS changed_verifier_score, count(*) FILTER (anchor_bbox IS NULL) AS changed_anchor_bbox FROM ({MODELS}) WHERE anchor_page = 3")
def _(spark, d):
    updates = view(spark, d, _PAGE3).withColumn("verifier_score", F.col("verifier_score").cast("double"))
    unknown = updates.withColumn("row_id", F.concat(F.lit("no "), "row_id"))
    return telemetry.publish_verdicts(_stored(spark, d), updates.unionByName(unknown), "row_id", _WRITTEN, dry_run=True)


_COST = f"(SELECT row_id, cohort_id, CAST(length(cohort_id) * 100 AS DOUBLE) AS cost, length(cohort_id) * 1000 AS tokens, length(cohort_id) * 77 AS latency FROM ({MODELS}))"


@query("w02_allocate_cost", f"SELECT row_id, round(cost / count(*) OVER w, 6) AS cost_share, CAST(floor(tokens / count(*) OVER w) AS BIGINT) AS tokens_share, CAST(floor(latency / count(*) OVER w) AS BIGINT) AS latency_share FROM {_COST} WINDOW w AS (PARTITION BY cohort_id)")
def _(spark, d):
    rows = telemetry.allocate(view(spark, d, f"SELECT * FROM {_COST}"), ["cohort_id"])
    return rows.select("row_id", F.round("cost_share", 6).alias("cost_share"), "tokens_share", "latency_share")


@query("a19_undo_repeated_cost", f"SELECT model, sum(cost) AS cost FROM (SELECT cohort_id, substr(cohort_id, 1, 2) AS model, max(cost) AS cost FROM {_COST} GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    rows = view(spark, d, f"SELECT *, substr(cohort_id, 1, 2) AS model FROM {_COST}")
    return telemetry.undo_repeated_cost(rows, ["cohort_id"], ["model"])


@query("a21_call_quality", f"SELECT coalesce(stage, 'unknown') AS stage, count(*) AS n_calls, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(CAST(sum(coalesce(tokens_cached, 0)) AS DOUBLE) / nullif(sum(tokens_in), 0), 6) AS cache_share, CAST(sum(CASE WHEN cost_microusd > 0 THEN cost_microusd ELSE tokens_in + 5 * tokens_out END) AS BIGINT) AS cost FROM ({CALLS}) GROUP BY 1")
def _(spark, d):
    return telemetry.call_quality(view(spark, d, CALLS)).withColumns({c: F.round(c, 6) for c in ("error_rate", "cache_share")})


@query("a12_coverage_by_metric", f"SELECT m AS best_metric, count(best_metric) AS n_predictors FROM (SELECT unnest(['AUC', 'c_index', 'OR', 'HR', 'RR']) AS m) LEFT JOIN {RANKED} ON best_metric = m GROUP BY 1")
def _(spark, d):
    return rank.coverage(rank.rank_predictors(cleaned(spark, d)))


_TARGETS = "SELECT DISTINCT p_brand AS predictor_canonical FROM {part} WHERE p_brand LIKE '%1'"
_TEN = f"(SELECT predictor_canonical FROM {RANKED} ORDER BY {RANK_ORDER} LIMIT 10)"


@query("a12_top_overlap", f"SELECT (SELECT count(*) FROM {_TEN}) AS n_top, count(*) AS n_overlap, coalesce(string_agg(predictor_canonical, ',' ORDER BY predictor_canonical), '') AS overlap, count(*) >= 3 AS passed FROM {_TEN} WHERE predictor_canonical IN ({_TARGETS})")
def _(spark, d):
    return rank.top_overlap(rank.rank_predictors(cleaned(spark, d)), view(spark, d, _TARGETS))


_SHIFT = "CASE WHEN anchor_page % 4 = 0 THEN NULL WHEN anchor_page % 4 = 1 THEN concat(anchor_bbox, '5') ELSE anchor_bbox END"
_BOXES = f"SELECT *, {_SHIFT} AS found_bbox FROM {EV}"
_NUMBERS = "list_transform(string_split({}, ','), lambda x: CAST(x AS DOUBLE))"
_NEAR = f"list_max(list_transform(list_zip({_NUMBERS.format('anchor_bbox')}, {_NUMBERS.format('found_bbox')}), lambda p: abs(p[1] - p[2]))) <= 0.01"


@query("a18_quality_rates", f"SELECT paper_ref, round(avg(CASE WHEN anchor_page IS NULL THEN 0.0 ELSE 1.0 END), 6) AS bound_rate, round(avg(CASE WHEN anchor_bbox IS NOT NULL AND found_bbox IS NOT NULL THEN CASE WHEN {_NEAR} THEN 1.0 ELSE 0.0 END END), 6) AS bbox_rate, round(avg(CASE WHEN coalesce(verifier_verdict, '') = 'reject' THEN 1.0 ELSE 0.0 END), 6) AS reject_rate FROM (SELECT * EXCLUDE (anchor_page), nullif(anchor_page, 9) AS anchor_page, anchor_page AS p FROM ({_BOXES})) GROUP BY 1")
def _(spark, d):
    rows = evidence(spark, d).withColumns({"found_bbox": F.expr(_SHIFT)}).withColumn("anchor_page", F.nullif("anchor_page", F.lit(9)))
    return catalog.quality_rates(rows, ["paper_ref"]).withColumns({c: F.round(c, 6) for c in ("bound_rate", "bbox_rate", "reject_rate")})


_HASHED = ["row_id", "predictors", "effect_size_str", "anchor_text", "verifier_verdict"]
_BITS = "CAST(concat('0x', substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, '')" for c in _HASHED) + ")), 1, 12)) AS BIGINT)"


@query("a20_export_manifest", f"SELECT count(*) AS n_rows, count(DISTINCT paper_ref) AS n_papers, concat(bit_xor({_BITS}), '-', CAST(sum({_BITS} % 2147483648) % 2147483648 AS BIGINT)) AS content, '2024-01-01T00:00:00Z' AS generated_at, '1' AS schema_version FROM {EV}")
def _(spark, d):
    return catalog.export_manifest(evidence(spark, d), _HASHED, "2024-01-01T00:00:00Z")


_SUMMED = "SELECT o_orderkey AS study, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 9 END AS anchor_page, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'warn' ELSE NULL END AS verifier_verdict FROM {orders}"
_GROUPED = "SELECT l_orderkey AS study, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 9 END AS anchor_page, CASE l_returnflag WHEN 'A' THEN 'Pass' WHEN 'R' THEN 'reject' ELSE 'odd' END AS verifier_verdict FROM {lineitem}"
_FACTS = f"(SELECT study, anchor_page IS NOT NULL AS a, {_BUCKET} AS bucket FROM (SELECT * FROM ({_SUMMED}) UNION ALL SELECT * FROM ({_GROUPED})))"
_COUNTS = ", ".join(["count(*) AS n", "count(*) FILTER (a) AS n_anchored", "CAST(count(*) FILTER (a) AS DOUBLE) / count(*) AS anchor_rate", *[f"count(*) FILTER (bucket = '{b}') AS n_{b}" for b in catalog.BUCKETS]])


@query("a11_phenotype_diagnostics", f"SELECT study, false AS overall, {_COUNTS} FROM {_FACTS} GROUP BY 1 UNION ALL SELECT NULL, true, {_COUNTS} FROM {_FACTS}")
def _(spark, d):
    return catalog.phenotype_diagnostics(view(spark, d, _SUMMED), view(spark, d, _GROUPED))
