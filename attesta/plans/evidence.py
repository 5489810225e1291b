"""Queries on the evidence table: joins, filters, de-duplication, ranking, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import stem
from attesta.operators import classify, dedupe, filters, pooling, rank
from attesta.plans.registry import query
from attesta.sources.adapters import COHORTS, EVIDENCE, EVIDENCE_NARROW, MODELS, view
from attesta.sources.staging import stage


def evidence(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVIDENCE_NARROW)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '\\s+', ' ', 'g')))"


#: What the passes of the de-duplication read of a row, besides row_id.
FACT = ("paper_ref", "predictor_canonical", "predictors", "outcome", "outcome_type", "outcome_window_days", "effect_type", "effect_value", "ci_lo", "ci_hi", "auc", "c_index", "effect_size_str", "p_value", "anchor_page")
_SAID = ("paper_ref", "cohort_id", "predictor_canonical", "outcome", "effect_type", "effect_size_str", "model_specification")
_TOLD = ("auc", "paper_ref", "predictor_canonical", "outcome_type", "anchor_section", "anchor_text")

EV = f"({EVIDENCE})"
_KEEP = "coalesce(lower(verifier_verdict), '') <> 'reject'"
_EFFECT = "effect_value, ci_lo, ci_hi, auc, c_index"
_NUMERIC = f"(coalesce({_EFFECT}) IS NOT NULL)"
_TOKENS = r"array_to_string(list_transform(regexp_extract_all(coalesce(effect_size_str, ''), '<\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda x: replace(x, ' ', '')), '|')"
_FACT = f"{norm('paper_ref')}, {norm('coalesce(predictor_canonical, predictors)')}, {norm('outcome')}, {norm('outcome_type')}, outcome_window_days, anchor_page, {_NUMERIC}, CASE WHEN {_NUMERIC} THEN {norm('effect_type')} END, {_EFFECT}, CASE WHEN NOT {_NUMERIC} THEN {_TOKENS} END, p_value"
_TOTAL = f"regexp_matches(concat({norm('cohort_id')}, ' ', {norm('cohort_label')}, ' ', {norm('population_description')}), 'total|overall|all patients|entire cohort|full cohort')"
_POINTS = f"CASE {norm('verifier_verdict')} WHEN 'ok' THEN 3 WHEN 'partial' THEN 2 WHEN 'reject' THEN 0 ELSE 1 END"
_SIZE = r"coalesce(TRY_CAST(regexp_extract(replace(coalesce(cohort_size_n, ''), ',', ''), '\d+') AS BIGINT), 0)"


def exact_sql(rows: str) -> str:
    return f"(SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY {_FACT}, {norm('cohort_id')} ORDER BY row_id) = 1)"


def cross_sql(rows: str, score: str = "coalesce(verifier_score, 0)") -> str:
    best = f"ORDER BY CASE WHEN {_TOTAL} THEN 100 ELSE 0 END + {_POINTS} + {score} DESC, {_SIZE} DESC, {norm('row_id')} DESC"
    return f"(SELECT *, min(row_id) OVER (PARTITION BY {_FACT}) AS ord FROM {rows} QUALIFY row_number() OVER (PARTITION BY {_FACT} {best}) = 1)"


@query("j01_evidence_with_cohort", f"SELECT row_id, cohort_id, paper_ref, cohort_label FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", "cohort_id", "paper_ref", "cohort_label")


@query("j02_paper_evidence", f"SELECT row_id, m.cohort_id, file_name FROM ({MODELS}) m JOIN ({COHORTS}) c ON c.cohort_id = m.cohort_id WHERE file_name LIKE 'NATION_7%'")
def _(spark, d):
    cohorts = view(spark, d, COHORTS).filter(stem(F.col("file_name")).startswith("NATION_7"))
    return view(spark, d, MODELS).join(cohorts, "cohort_id").select("row_id", "cohort_id", "file_name")


@query("p06_evidence_filter", f"SELECT row_id FROM {EV} WHERE outcome_type = 'mortality' AND outcome_window_days = 28 AND (lower(predictor_canonical) = 'brand#1_' OR lower(predictors) LIKE '%w_dg%') AND lower(population_description) LIKE '%septic shock%'")
def _(spark, d):
    return filters.evidence_filter(evidence(spark, d), "mortality", 28, predictor="w_dg", condition="septic shock").select("row_id")


@query("p08_rank_filter", f"SELECT row_id FROM {EV} WHERE outcome_type = 'mortality' AND outcome_window_days = 90 AND lower(paper_ref) LIKE '%199%' AND (lower(population_description) LIKE '%icu%' OR lower(population_location) LIKE '%icu%')")
def _(spark, d):
    return filters.rank_filter(evidence(spark, d), "mortality", 90, "199", "icu").select("row_id")


@query("p07_relax_window", f"""WITH m AS (SELECT row_id, outcome_window_days AS w FROM {EV} WHERE outcome_type = 'mortality'), best AS (SELECT w AS b FROM m WHERE w IN (28, 30, 60, 90, 180, 365) AND abs(w - 33) <= 5 ORDER BY abs(w - 33), w LIMIT 1)
SELECT row_id, CASE WHEN (SELECT count(*) FROM m WHERE w = 33) > 0 THEN 33 ELSE b END AS matched_window, CASE WHEN (SELECT count(*) FROM m WHERE w = 33) = 0 THEN concat('No studies report 33-day; showing ', b, '-day.') END AS note FROM m, best WHERE w = CASE WHEN (SELECT count(*) FROM m WHERE w = 33) > 0 THEN 33 ELSE b END""")
def _(spark, d):
    rows = filters.evidence_filter(evidence(spark, d), "mortality")
    return filters.relax_window(rows, 33).select("row_id", "matched_window", "note")


@query("p07_relax_window_open", f"SELECT row_id, CAST(NULL AS INT) AS matched_window, 'No exact match for 200-day; showing all windows for this outcome.' AS note FROM {EV} WHERE outcome_type = 'los'")
def _(spark, d):
    rows = filters.evidence_filter(evidence(spark, d), "los", paper_ref="NATION_9")
    return filters.relax_window(rows, 200, keep=filters.evidence_filter(evidence(spark, d), "los")).select("row_id", "matched_window", "note")


@query("p15_drop_rejected", f"SELECT row_id, verifier_verdict FROM {EV} WHERE {_KEEP}")
def _(spark, d):
    return filters.drop_rejected(evidence(spark, d)).select("row_id", "verifier_verdict")


@query("p16_scope_rows", f"SELECT row_id FROM {EV} WHERE (lower(concat_ws(' ', paper_ref, cohort_id)) LIKE '%nation_3%' OR lower(concat_ws(' ', paper_ref, cohort_id)) LIKE '%c12%') AND lower(concat_ws(' ', paper_ref, cohort_id)) NOT LIKE '%c121%'")
def _(spark, d):
    def refs(*x):
        return spark.sql("SELECT explode(array({})) AS ref".format(", ".join(f"'{v}'" for v in x)))

    return filters.scope_rows(evidence(spark, d), refs("Nation_3", "c12"), refs("C121")).select("row_id")


@query("p16_scope_rows_many", f"SELECT row_id FROM {EV} WHERE EXISTS (SELECT 1 FROM supplier WHERE contains(lower(concat_ws(' ', paper_ref, cohort_id)), lower(concat('c', CAST(100 + s_suppkey AS VARCHAR)))))")
def _(spark, d):
    refs = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("C"), (F.col("s_suppkey") + 100).cast("string")).alias("ref"))
    return filters.scope_rows(evidence(spark, d), refs).select("row_id")


@query("l04_row_cap", f"SELECT row_id FROM {EV} WHERE outcome_type = 'mortality' ORDER BY row_id LIMIT 200")
def _(spark, d):
    return filters.capped(filters.evidence_filter(evidence(spark, d), "mortality")).select("row_id")


_CLASS = r"""CASE WHEN trim(coalesce(cutoff, '')) <> '' THEN 'cutoff_performance'
 WHEN upper(coalesce(effect_type, '')) = 'AUC' OR auc IS NOT NULL THEN 'performance_auc'
 WHEN effect_type = 'OR' OR (coalesce(effect_type, '') = '' AND effect_value IS NOT NULL AND regexp_matches(concat(anchor_text, ' ', coalesce(model_specification, '')), '(?i)\bor\b|odds ratio')) THEN 'association_or'
 WHEN effect_type = 'HR' OR (coalesce(effect_type, '') = '' AND effect_value IS NOT NULL AND regexp_matches(concat(anchor_text, ' ', coalesce(model_specification, '')), '(?i)\bhr\b|hazard ratio')) THEN 'association_hr'
 WHEN effect_type = 'RR' OR (coalesce(effect_type, '') = '' AND effect_value IS NOT NULL AND regexp_matches(concat(anchor_text, ' ', coalesce(model_specification, '')), '(?i)\brisk ratio\b|\brelative risk\b|\brr\b')) THEN 'association_rr'
 WHEN effect_value IS NULL AND p_value IS NOT NULL AND regexp_matches(concat(coalesce(effect_size_str, ''), ' ', anchor_text), '(?i)median|mean') THEN 'descriptive_group_comparison'
 WHEN effect_value IS NULL AND p_value IS NOT NULL AND regexp_matches(concat(anchor_text, ' ', coalesce(effect_size_str, '')), '(?i)chi.?square|\bF\s*=|\bt\s*=|\bz\s*=') THEN 'p_value_only'
 WHEN regexp_matches(concat(anchor_text, ' ', coalesce(model_specification, '')), '(?i)calibrat|brier|hosmer|risk group|risk strat') THEN 'calibration_or_risk_group'
 WHEN length(coalesce(model_specification, '')) > 30 AND coalesce(effect_type, '') NOT IN ('OR', 'HR', 'RR') THEN 'multivariable_model'
 ELSE 'unknown' END"""


@query("p09_classify_evidence", f"SELECT row_id, {_CLASS} AS evidence_type FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", classify.evidence_class().alias("evidence_type"))


@query("p10_filter_evidence", f"SELECT row_id, {_CLASS} AS evidence_type FROM {EV} WHERE {_KEEP} AND coalesce(verifier_verdict, '') <> 'partial' AND {_CLASS} IN ('performance_auc', 'cutoff_performance') AND auc IS NOT NULL AND NOT regexp_matches(coalesce(outcome, ''), '(?i)or\\s+icu|length of stay|\\blos\\b|composite')")
def _(spark, d):
    return classify.filter_evidence(evidence(spark, d), "auc", hide_partial=True, drop_composite=True).select("row_id", "evidence_type")


@query("p11_predictor_matches", f"SELECT row_id FROM {EV} WHERE trim(regexp_replace(lower(coalesce(predictor_canonical, '')), '[^a-z0-9]+', ' ', 'g')) = 'qsofa' OR regexp_matches(lower(coalesce(model_specification, '')), '(^|[^a-z0-9])qsofa([^a-z0-9]|$)')")
def _(spark, d):
    return evidence(spark, d).filter(classify.predictor_matches("qSOFA", with_model=True)).select("row_id")


@query("p12_evidence_flags", f"SELECT row_id FROM {EV} WHERE {_KEEP} AND {_CLASS} = 'association_or' AND trim(regexp_replace(lower(coalesce(predictor_canonical, '')), '[^a-z0-9]+', ' ', 'g')) = 'brand 13' AND NOT regexp_matches(coalesce(outcome, ''), '(?i)or\\s+icu|length of stay|\\blos\\b|composite')")
def _(spark, d):
    flags = classify.evidence_flags("Brand#13", "or", "lookup", "odds ratio of Brand#13")
    return classify.filter_evidence(evidence(spark, d), "or", "Brand#13", **flags).select("row_id")


_PRED = r"CASE WHEN regexp_matches(coalesce(model_specification, ''), '(?i)(\w+[\s\-]model|Model\s+\d+)') AND predictors <> '' AND length(predictors) < 60 THEN predictors ELSE coalesce(predictor_canonical, predictors, 'Unknown') END"
_SRC = "CASE WHEN paper_ref IS NOT NULL THEN concat(paper_ref, ' p.', anchor_page) ELSE '' END"


@query("p13_project_display", f"""SELECT row_id, coalesce(paper_ref, '') AS "Study", {_PRED} AS "Predictor", coalesce(outcome, '') AS "Outcome", coalesce(effect_size_str, printf('%.2f', effect_value), '') AS "Effect Size",
 CASE WHEN auc IS NOT NULL THEN printf('AUC %.3f', auc) WHEN c_index IS NOT NULL THEN printf('c-idx %.3f', c_index) ELSE '' END AS "Performance", {_SRC} AS "Source" FROM {EV}""")
def _(spark, d):
    return classify.project_display(evidence(spark, d))


@query("p13_project_association", f"""SELECT row_id, coalesce(paper_ref, '') AS "Study", {_PRED} AS "Predictor", coalesce(outcome, '') AS "Outcome", coalesce(effect_size_str, printf('%.2f', effect_value), '') AS "Effect Size",
 CASE WHEN ci_lo IS NULL OR ci_hi IS NULL THEN '' ELSE printf('%.2f-%.2f', ci_lo, ci_hi) END AS "95% CI", coalesce(printf('%.4f', p_value), '') AS "p-value", coalesce(model_specification, '') AS "Model", {_SRC} AS "Source" FROM {EV}""")
def _(spark, d):
    return classify.project_display(evidence(spark, d), "or")


def _cell(c: str) -> str:
    x = f"replace(replace(coalesce(CAST({c} AS VARCHAR), ''), '|', '\\|'), chr(10), ' ')"
    return f"CASE WHEN length({x}) > 80 THEN concat(substr({x}, 1, 77), '...') ELSE {x} END AS {c}"


@query("p14_clip_cells", f"SELECT row_id, {', '.join(_cell(c) for c in classify.TABLE)} FROM {EV}")
def _(spark, d):
    return classify.clip_cells(evidence(spark, d))


@query("d05_exact_evidence_dedupe", f"SELECT row_id FROM {exact_sql(EV)}")
def _(spark, d):
    return dedupe.exact_evidence(evidence(spark, d).select("row_id", *FACT, "cohort_id")).select("row_id")


@query("d06_cross_cohort_dedupe", f"SELECT row_id, ord FROM {cross_sql(exact_sql(EV))}")
def _(spark, d):
    return dedupe.distinct_facts(evidence(spark, d), [])


_EXACT = f"(SELECT * FROM {EV} WHERE {norm('effect_size_str')} = '' UNION ALL SELECT * FROM (SELECT * FROM {EV} WHERE {norm('effect_size_str')} <> '' QUALIFY row_number() OVER (PARTITION BY paper_ref, cohort_id, predictor_canonical, outcome, effect_type, {norm('effect_size_str')}, {norm('model_specification')} ORDER BY row_id) = 1))"


@query("d02_collapse_exact_facts", f"SELECT row_id FROM {_EXACT}")
def _(spark, d):
    return dedupe.collapse_exact(evidence(spark, d).select("row_id", *_SAID)).select("row_id")


def repeated_sql(rows: str) -> str:
    prio = "CASE WHEN lower(anchor_section) LIKE '%table%' THEN 1 WHEN lower(anchor_section) LIKE '%fig%' THEN 2 WHEN regexp_matches(lower(coalesce(anchor_section, '')), 'result|body|method') THEN 3 ELSE 4 END"
    return f"(SELECT * FROM {rows} WHERE auc IS NULL UNION ALL SELECT * FROM (SELECT * FROM {rows} WHERE auc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_ref, predictor_canonical, outcome_type, round(auc, 3) ORDER BY {prio}, length(coalesce(anchor_text, '')) DESC, row_id) = 1))"


@query("d03_collapse_repeated_facts", f"SELECT row_id FROM {repeated_sql(EV)}")
def _(spark, d):
    return dedupe.collapse_repeated(evidence(spark, d).select("row_id", *_TOLD)).select("row_id")


def _lab(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '(?i)non.?survivor|died') THEN 'Non-survivors' WHEN regexp_matches({t}, '(?i)survivor|alive') THEN 'Survivors' END"


def _tok(t: str) -> str:
    return f"regexp_extract_all({t}, '\\d+\\.?\\d*')"


def _ints(t: str) -> str:
    return f"list_transform(list_filter({_tok(t)}, lambda x: NOT contains(x, '.')), lambda x: CAST(x AS BIGINT))"


def _except(a: str, b: str) -> str:
    return f"list_max(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


def pairs_sql(name: str) -> str:
    return f"""WITH e AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY row_id) AS nth FROM {EV} WINDOW w AS (PARTITION BY paper_ref, {name}, anchor_page)),
p AS (SELECT a.row_id AS ida, b.row_id AS idb, a.anchor_text AS ta, b.anchor_text AS tb, a.p_value AS pa, b.p_value AS pb, a.effect_size_str AS ea, b.effect_size_str AS eb, a.cohort_size_n AS na, b.cohort_size_n AS nb
 FROM e a JOIN e b ON a.n = 2 AND b.n = 2 AND a.nth = 1 AND b.nth = 2 AND a.paper_ref IS NOT DISTINCT FROM b.paper_ref AND a.{name} IS NOT DISTINCT FROM b.{name} AND a.anchor_page IS NOT DISTINCT FROM b.anchor_page),
t AS (SELECT *, length(tb) > length(ta) AS swap, {_ints('ta')} AS ia, {_ints('tb')} AS ib, {_lab('ta')} AS la, {_lab('tb')} AS lb FROM p
 WHERE CASE WHEN len({_tok('ta')}) >= 3 AND len({_tok('tb')}) >= 3 THEN len(list_intersect(list_distinct({_tok('ta')}), list_distinct({_tok('tb')}))) >= 0.6 * len(list_distinct(list_concat({_tok('ta')}, {_tok('tb')}))) ELSE coalesce(abs(pa - pb) <= 1e-3, false) END),
m AS (SELECT *, coalesce(TRY_CAST(coalesce(na, nb) AS BIGINT), list_max(list_intersect(ia, ib))) AS total, {_except('ia', 'ib')} AS xa, {_except('ib', 'ia')} AS xb FROM t),
merged AS (SELECT CASE WHEN swap THEN idb ELSE ida END AS row_id,
 concat(coalesce(CASE WHEN swap THEN lb ELSE la END, 'Group A'), ': ', CASE WHEN swap THEN coalesce(eb, substr(tb, 1, 120)) ELSE coalesce(ea, substr(ta, 1, 120)) END, '; ', coalesce(CASE WHEN swap THEN la ELSE lb END, 'Group B'), ': ', CASE WHEN swap THEN coalesce(ea, substr(ta, 1, 120)) ELSE coalesce(eb, substr(tb, 1, 120)) END,
  coalesce('; p=' || CAST(CASE WHEN swap THEN coalesce(pb, pa) ELSE coalesce(pa, pb) END AS VARCHAR), '')) AS effect_size_str,
 nullif(concat_ws('; ', 'Total N=' || total, 'Survivors n=' || coalesce(CASE WHEN la = 'Survivors' THEN xa END, CASE WHEN lb = 'Survivors' THEN xb END), 'Non-survivors n=' || coalesce(CASE WHEN la = 'Non-survivors' THEN xa END, CASE WHEN lb = 'Non-survivors' THEN xb END)), '') AS merged_sample_size,
 'descriptive_group_comparison' AS evidence_type FROM m)
SELECT * FROM merged UNION ALL SELECT row_id, effect_size_str, NULL, NULL FROM e WHERE row_id NOT IN (SELECT ida FROM m UNION ALL SELECT idb FROM m)"""


@query("d01_collapse_descriptive_pairs", pairs_sql("predictors"))
def _(spark, d):
    return dedupe.collapse_pairs(evidence(spark, d), "predictors").select("row_id", "effect_size_str", "merged_sample_size", "evidence_type")


def _exact_of(rows: str) -> str:
    key = f"paper_ref, cohort_id, predictor_canonical, outcome, effect_type, {norm('effect_size_str')}, {norm('model_specification')}"
    return f"(SELECT * FROM {rows} WHERE {norm('effect_size_str')} = '' UNION ALL SELECT * FROM (SELECT * FROM {rows} WHERE {norm('effect_size_str')} <> '' QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY row_id) = 1))"


_MERGED = f"(SELECT e.* REPLACE (m.effect_size_str AS effect_size_str), m.evidence_type FROM {EV} e JOIN ({pairs_sql('predictor_canonical')}) m ON m.row_id = e.row_id)"
_ALL = f"SELECT row_id, effect_size_str, evidence_type FROM {repeated_sql(_exact_of(_MERGED))}"


@query("d04_dedupe_rows", _ALL)
def _(spark, d):
    rows = evidence(spark, d).select("row_id", *dict.fromkeys((*_SAID, *_TOLD, "anchor_page", "p_value", "cohort_size_n")))
    return dedupe.dedupe_rows(rows).select("row_id", "effect_size_str", "evidence_type")


CLEAN = f"(SELECT * FROM {cross_sql(exact_sql(f'(SELECT * FROM {EV} WHERE outcome_type = {chr(39)}mortality{chr(39)} AND outcome_window_days = 28)'), '0')} WHERE {_KEEP})"
RANKED = f"""(WITH r AS (SELECT * FROM {CLEAN} WHERE coalesce(auc, c_index, effect_value) IS NOT NULL AND coalesce(predictor_canonical, '') <> ''),
v AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS mr FROM r),
u AS (SELECT *, CASE mr WHEN 0 THEN auc WHEN 1 THEN c_index ELSE CASE WHEN effect_type = ['OR', 'HR', 'RR'][mr - 1] THEN effect_value END END AS value FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY predictor_canonical, mr ORDER BY CASE WHEN mr < 2 THEN value ELSE abs(value - 1) END DESC, ord) AS nth, median(value) OVER (PARTITION BY predictor_canonical, mr) AS med, count(*) OVER (PARTITION BY predictor_canonical, mr) AS k FROM u WHERE value IS NOT NULL),
c AS (SELECT * FROM b WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY predictor_canonical ORDER BY mr) = 1),
s AS (SELECT predictor_canonical, count(DISTINCT cohort_id) AS n_studies, min(ord) AS first_ord FROM r GROUP BY predictor_canonical)
SELECT predictor_canonical, n_studies, ['AUC', 'c_index', 'OR', 'HR', 'RR'][mr + 1] AS best_metric, value AS best_value, CASE WHEN mr >= 2 THEN ci_lo END AS best_ci_lo, CASE WHEN mr >= 2 THEN ci_hi END AS best_ci_hi,
 paper_ref AS best_paper_ref, cohort_id AS best_cohort_id, CASE WHEN k >= 2 THEN round(med, 6) END AS median_value, mr AS metric_rank, ord AS best_ord, first_ord FROM c JOIN s USING (predictor_canonical))"""
RANK_ORDER = _ORDER = "metric_rank, CASE WHEN metric_rank < 2 THEN best_value ELSE abs(best_value - 1) END DESC, n_studies DESC, first_ord"

#: What the ranking reads of a row, besides its place.
_RANKED = ["predictor_canonical", "cohort_id", "paper_ref", "auc", "c_index", "effect_type", "effect_value", "ci_lo", "ci_hi", "outcome_window_days", "verifier_verdict"]


def cleaned(spark, d) -> DataFrame:
    """Rows of the flagship question, relaxed, de-duplicated and without rejects."""
    rows = filters.rank_filter(evidence(spark, d), "mortality")
    clean = lambda df: filters.drop_rejected(dedupe.distinct_facts(df, _RANKED, with_score=False))
    return filters.relax_window(rows, 28, ranking=True, clean=lambda df: stage(clean(df), "clean"))  # a ranking reads them many times


@query("a03_rank_predictors", f"SELECT * EXCLUDE (first_ord, best_ord), row_number() OVER (ORDER BY {_ORDER}) AS position FROM {RANKED} ORDER BY {_ORDER} LIMIT 50")
def _(spark, d):
    ranked = rounded(rank.rank_predictors(cleaned(spark, d)), "median_value")
    return rank.top_rows(ranked, *rank.ranking_order(), limit=50).drop("first_ord", "best_ord")


@query("l03_ranking_order", f"SELECT predictor_canonical, row_number() OVER (ORDER BY {_ORDER}) AS position FROM {RANKED} ORDER BY {_ORDER} LIMIT 5")
def _(spark, d):
    return rank.top_rows(rank.rank_predictors(cleaned(spark, d)), *rank.ranking_order(), limit=5).select("predictor_canonical", "position")


@query("w05_supporting_rows", f"""SELECT r.predictor_canonical, row_id, row_number() OVER (PARTITION BY r.predictor_canonical ORDER BY CASE WHEN ord = best_ord THEN 0 ELSE 1 END, ord) AS position
 FROM {CLEAN} r JOIN (SELECT predictor_canonical, best_ord FROM {RANKED}) k ON k.predictor_canonical = r.predictor_canonical WHERE coalesce(auc, c_index, effect_value) IS NOT NULL QUALIFY position <= 20""")
def _(spark, d):
    rows = cleaned(spark, d)
    return rank.supporting_rows(rows, rank.rank_predictors(rows)).select("predictor_canonical", "row_id", "position")


@query("w01_stable_ordinal", f"SELECT row_id, row_number() OVER (PARTITION BY paper_ref ORDER BY anchor_page, row_id) AS ord FROM {EV}")
def _(spark, d):
    return pooling.stable_ordinal(evidence(spark, d), ["paper_ref"], ["anchor_page", "row_id"]).select("row_id", "ord")


_QT = "['random', 'forest', 'auc', 'septic', 'shock']"
_RT = "list_distinct(regexp_extract_all(lower(concat_ws(' ', nullif(paper_ref, ''), nullif(cohort_label, ''), nullif(predictors, ''), nullif(outcome, ''), nullif(model_specification, ''), nullif(effect_size_str, ''), nullif(population_description, ''))), '[a-z][a-z0-9_-]+'))"
_SCORE = f"CASE WHEN len({_RT}) = 0 THEN 0 ELSE len(list_intersect({_QT}, {_RT})) / (sqrt(len(list_distinct(list_concat({_QT}, {_RT})))) + 1e-9) END - CASE WHEN lower(coalesce(verifier_verdict, '')) = 'reject' THEN 10 ELSE 0 END"


@query("f08_relevance", f"SELECT row_id, round({_SCORE}, 6) AS score FROM {EV}")
def _(spark, d):
    return rounded(rank.score_rows(evidence(spark, d), "Random forest AUC, septic shock").select("row_id", "score"), "score")


@query("l01_relevance_sort", f"SELECT row_id, row_number() OVER (ORDER BY round({_SCORE}, 6) DESC, row_id) AS position FROM {EV} ORDER BY position LIMIT 200")
def _(spark, d):
    rows = rounded(rank.score_rows(evidence(spark, d), "Random forest AUC, septic shock"), "score")
    return rank.top_rows(rows, F.desc("score"), F.col("row_id"), limit=200).select("row_id", "position")


@query("l02_auc_sort", f"SELECT row_id, auc, row_number() OVER (ORDER BY auc DESC NULLS LAST, row_id) AS position FROM {EV} WHERE outcome_type = 'los' ORDER BY position LIMIT 500")
def _(spark, d):
    rows = filters.evidence_filter(evidence(spark, d), "los")
    return rank.top_rows(rows, F.desc_nulls_last("auc"), F.col("row_id"), limit=500).select("row_id", "auc", "position")


@query("l05_display_cap", f"SELECT row_id, total_rows, total_rows > 20 AS truncated FROM (SELECT row_id, (SELECT count(*) FROM {EV} WHERE outcome_type = 'los') AS total_rows FROM {EV} WHERE outcome_type = 'los' ORDER BY row_id LIMIT 20)")
def _(spark, d):
    rows = filters.evidence_filter(evidence(spark, d), "los").select("row_id")
    total = rows.agg(F.count("*").alias("total_rows"))
    return rows.orderBy("row_id").limit(20).join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total_rows") > 20)


_HARM = f"""(SELECT *, coalesce(effect_type, '') IN ('OR', 'HR', 'RR') AND effect_value IS NOT NULL AND ci_lo IS NOT NULL AND ci_hi IS NOT NULL AND least(effect_value, ci_lo, ci_hi) > 0 AS poolable,
 CASE WHEN coalesce(effect_type, '') NOT IN ('OR', 'HR', 'RR') THEN concat('effect_type ''', coalesce(effect_type, ''), ''' not on log-ratio scale') WHEN effect_value IS NULL OR ci_lo IS NULL OR ci_hi IS NULL THEN 'missing point or CI bounds' WHEN least(effect_value, ci_lo, ci_hi) <= 0 THEN 'log-transform failed' ELSE '' END AS note FROM {EV})"""
_Y = f"(SELECT *, ln(effect_value) AS y, (ln(ci_hi) - ln(ci_lo)) / (2 * 1.959964) AS se FROM {_HARM} WHERE poolable)"


@query("a04_harmonize", f"SELECT row_id, coalesce(effect_type, 'UNKNOWN') AS ratio_type, poolable, note, CASE WHEN poolable THEN round(ln(effect_value), 6) END AS log_effect, CASE WHEN poolable THEN round((ln(ci_hi) - ln(ci_lo)) / (2 * 1.959964), 6) END AS log_se FROM {_HARM}")
def _(spark, d):
    rows = pooling.harmonize(evidence(spark, d)).select("row_id", "ratio_type", "poolable", "note", "log_effect", "log_se")
    return rounded(rows, "log_effect", "log_se")


def _pool_sql(random: bool) -> str:
    tau = "greatest(0, (q - (k - 1)) / nullif(sw - sww / sw, 0))" if random else "0.0"
    return f"""(WITH y AS (SELECT *, 1 / (se * se) AS w FROM {_Y}),
s AS (SELECT predictor_canonical, effect_type, count(*) AS k, sum(w) AS sw, sum(w * y) / sum(w) AS mean, sum(w * w) AS sww FROM y GROUP BY ALL),
q AS (SELECT s.predictor_canonical, s.effect_type, k, sw, sww, sum(w * (y - mean) * (y - mean)) AS q FROM y JOIN s ON s.predictor_canonical IS NOT DISTINCT FROM y.predictor_canonical AND s.effect_type = y.effect_type WHERE s.predictor_canonical IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CASE WHEN k > 1 THEN {tau} END AS tau2, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / q) * 100 END AS i2 FROM q)
SELECT t.predictor_canonical, t.effect_type AS ratio_type, k, tau2, i2, sum(1 / (se * se + coalesce(tau2, 0))) AS sv, sum(y / (se * se + coalesce(tau2, 0))) AS svy FROM y JOIN t ON t.predictor_canonical = y.predictor_canonical AND t.effect_type = y.effect_type GROUP BY ALL)"""


def _pooled_sql(random: bool) -> str:
    return f"""SELECT predictor_canonical, ratio_type, k AS n, CASE WHEN k > 1 THEN round(svy / sv, 6) END AS pooled_log, CASE WHEN k > 1 THEN round(sqrt(1 / sv), 6) END AS se, CASE WHEN k > 1 THEN round(exp(svy / sv), 6) END AS pooled,
 CASE WHEN k > 1 THEN round(exp(svy / sv - 1.959964 * sqrt(1 / sv)), 6) END AS pooled_lo, CASE WHEN k > 1 THEN round(exp(svy / sv + 1.959964 * sqrt(1 / sv)), 6) END AS pooled_hi, round(tau2, 6) AS tau2, round(i2, 6) AS i2, CASE WHEN k < 2 THEN 'fewer than two poolable studies' END AS error FROM {_pool_sql(random)}"""


_POOLED = ("pooled_log", "se", "pooled", "pooled_lo", "pooled_hi", "tau2", "i2")


def _harmonized(spark, d) -> DataFrame:
    return pooling.harmonize(evidence(spark, d).filter("predictor_canonical is not null"))


@query("a05_random_effects_pool", _pooled_sql(True))
def _(spark, d):
    return rounded(pooling.pool(_harmonized(spark, d), ["predictor_canonical", "ratio_type"]), *_POOLED)


@query("a06_fixed_effect_pool", _pooled_sql(False))
def _(spark, d):
    return rounded(pooling.pool(_harmonized(spark, d), ["predictor_canonical", "ratio_type"], random=False), *_POOLED)


_WEIGHTS = f"SELECT y.*, p.ratio_type, (1 / (se * se + coalesce(tau2, 0))) / sv AS weight FROM {_Y} y JOIN {_pool_sql(True)} p ON p.predictor_canonical = y.predictor_canonical AND p.ratio_type = y.effect_type"


@query("a07_study_weights", f"SELECT row_id, ratio_type, round(weight, 9) AS weight FROM ({_WEIGHTS})")
def _(spark, d):
    h, by = _harmonized(spark, d), ["predictor_canonical", "ratio_type"]
    return pooling.weights(h, pooling.pool(h, by), by).select("row_id", "ratio_type", F.round("weight", 9).alias("weight"))


@query("a08_forest_table", f"""SELECT predictor_canonical, ratio_type, 'study' AS kind, concat(cohort_id, ' | ', predictor_canonical) AS label, effect_value AS point, ci_lo AS lo, ci_hi AS hi, round(weight, 6) AS weight FROM ({_WEIGHTS})
 UNION ALL SELECT predictor_canonical, ratio_type, 'pooled', 'Pooled (random effects)', pooled, pooled_lo, pooled_hi, 1.0 FROM ({_pooled_sql(True)}) WHERE n > 1""")
def _(spark, d):
    return rounded(pooling.forest(_harmonized(spark, d), ["predictor_canonical", "ratio_type"]), "point", "lo", "hi", "weight")
