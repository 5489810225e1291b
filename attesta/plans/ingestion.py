"""Ingestion jobs and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import effects, text, vocab
from attesta.operators import ingest
from attesta.plans.evidence import EV, evidence, norm
from attesta.plans.registry import query
from attesta.sources.adapters import CALLS, COHORTS, MODELS, PAPERS, view
from attesta.sources.staging import shared_folder, stage
from attesta.sources.versions import Responses, Versions

SCHEMA = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("auc", T.DoubleType()), T.StructField("sens", T.DoubleType()), T.StructField("anchor_page", T.IntegerType())])


@query("s02_align_schema", f"SELECT row_id, auc, CAST(NULL AS DOUBLE) AS sens, anchor_page FROM ({MODELS})")
def _(spark, d):
    return ingest.align_schema(view(spark, d, MODELS).withColumnRenamed("row_id", "id"), SCHEMA)


@query("s04_call_log", f"SELECT call_id, ts, error IS NOT NULL AS failed FROM ({CALLS})")
def _(spark, d):
    return view(spark, d, CALLS).select("call_id", "ts", F.col("error").isNotNull().alias("failed"))


_TARGET = "SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS state, o_custkey FROM {orders}"
_UPDATES = "SELECT l_orderkey + CASE WHEN l_partkey % 50 = 0 THEN 900000000 ELSE 0 END AS k, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('New ', CAST(l_partkey AS VARCHAR(9))) END AS title, 'X' AS state, CAST(l_partkey AS BIGINT) * 100000 + l_suppkey * 10 + l_linenumber AS seq FROM {lineitem} WHERE l_quantity > 25"


@query("s05_upsert", f"SELECT coalesce(t.k, u.k) AS k, CASE WHEN u.k IS NOT NULL THEN u.title ELSE t.title END AS title, CASE WHEN u.k IS NOT NULL THEN u.state ELSE t.state END AS state, o_custkey FROM ({_TARGET}) t FULL JOIN (SELECT k, title, state FROM ({_UPDATES}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) u ON u.k = t.k")
def _(spark, d):
    table = Versions(spark, shared_folder(spark))
    table.publish(view(spark, d, _TARGET), 0)
    return table.read(table.change(lambda rows: ingest.upsert(rows, view(spark, d, _UPDATES), "k", ["title", "state"], "seq")))


@query("s10_pending", f"SELECT k FROM ({_TARGET}) WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 20) OR state = 'P'")
def _(spark, d):
    targets = view(spark, d, _TARGET)
    runs = view(spark, d, "SELECT l_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n_errors FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_quantity < 20")
    return ingest.pending(targets, runs, "k").select("k")


#: The claim's fields, its span, the document's text and the judging model.
_CLAIM = ["predictors", "predictor_canonical", "outcome", "outcome_type", "outcome_window_days", "model_specification", "effect_type", "effect_value", "ci_lo", "ci_hi", "p_value", "effect_size_str", "auc", "c_index", "cutoff", "timing_predictor_measurement", "cohort_id", "paper_ref", "cohort_label", "cohort_size_n", "population_description", "population_location", "study_design", "mortality_rate_pct", "mortality_timepoint", "anchor_section", "anchor_text", "title", "judge"]


def _claims(spark, d):
    return evidence(spark, d).withColumns({"title": F.concat(F.lit("Document of "), "paper_ref"), "judge": F.lit("m1")})


_SAME = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce(nullif(trim(CAST({c} AS VARCHAR)), ''), chr(30))" for c in _CLAIM if c not in ("title", "judge")) + "))"


@query("s11_cached_lookup", f"WITH c AS (SELECT *, {_SAME} AS same FROM {EV}), k AS (SELECT same, arg_max(anchor_page, anchor_page) AS p FROM c WHERE anchor_page < 5 GROUP BY 1) SELECT row_id, coalesce('seen ' || p, 'asked') AS response FROM c LEFT JOIN k ON k.same = c.same")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()  # from the files' footers
    claims, store = _claims(spark, d), Responses(spark, shared_folder(spark), Responses.buckets_for(lines))
    claims = store.keyed(claims.select("row_id", "anchor_page", F.unhex(ingest.cache_key(claims, _CLAIM)).alias("input_hash")))
    seen = claims.filter("anchor_page < 5").select("input_hash", F.concat(F.lit("seen "), F.col("anchor_page").cast("string")).alias("response"), (-F.col("anchor_page")).alias("ts"))
    store.append("seen", seen)
    _, misses = store.lookup(claims)
    store.append("asked", misses.select("input_hash", F.lit("asked").alias("response"), F.lit(9).alias("ts")))
    return store.answered(claims).select("row_id", "response")


@query("s12_fingerprint", "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 12) AS short FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    return docs.select("doc_id", "sha256", F.substring("sha256", 1, 12).alias("short"))


_BODY = "CASE WHEN event_id % 5 = 0 THEN 'no object' WHEN event_id % 7 = 0 THEN replace(props, '}', ', \"verdict\": \"maybe\"}') WHEN event_id % 11 = 0 THEN concat(replace(props, '}', ', \"verdict\": \"ok\", \"score\": 1.7}')) ELSE concat('Answer: ', props, ' done') END"


@query("s13_model_responses", f"""SELECT event_id, TRY_CAST(json_extract_string(j, '$.k') AS INT) AS k, coalesce(json_extract_string(j, '$.verdict'), 'partial') AS verdict, least(greatest(coalesce(CAST(json_extract_string(j, '$.score') AS DOUBLE), 0.5), 0), 1) AS score,
 CASE WHEN j IS NULL THEN 'no JSON object' WHEN TRY_CAST(json_extract_string(j, '$.k') AS INT) IS NULL THEN 'missing field' WHEN coalesce(json_extract_string(j, '$.verdict'), 'partial') NOT IN ('ok', 'partial', 'reject') THEN 'verdict not allowed' END AS reason
 FROM (SELECT event_id, nullif(regexp_extract({_BODY}, '\\{{.*\\}}'), '') AS j FROM events)""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return ingest.ingest_responses(events.select("event_id", F.expr(_BODY).alias("response"))).drop("response")


_POS = "(SELECT o_orderkey AS study, o_orderstatus <> 'P' AS positive FROM {orders})"


@query("s18_phenotype_clusters", f"SELECT sha256(CAST(study AS VARCHAR)) AS summary_id, l_linenumber AS label, CAST(l_quantity AS INT) AS size FROM {_POS} JOIN {{lineitem}} ON l_orderkey = study WHERE positive")
def _(spark, d):
    clusters = view(spark, d, "SELECT l_orderkey AS study, l_linenumber AS label, CAST(l_quantity AS INT) AS size FROM {lineitem}").groupBy("study").agg(F.collect_list(F.struct("label", "size")).alias("clusters"))
    return ingest.ingest_phenotypes(view(spark, d, f"SELECT * FROM {_POS}").join(clusters, "study"))[1]


@query("s18_phenotype_summaries", f"SELECT CASE WHEN positive THEN sha256(CAST(study AS VARCHAR)) END AS summary_id, study, CASE WHEN positive THEN n END AS n_clusters, positive, 0 AS n_errors FROM {_POS} JOIN (SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM {{lineitem}} GROUP BY 1) ON l_orderkey = study")
def _(spark, d):
    clusters = view(spark, d, "SELECT l_orderkey AS study, l_linenumber AS label, CAST(l_quantity AS INT) AS size FROM {lineitem}").groupBy("study").agg(F.collect_list(F.struct("label", "size")).alias("clusters"))
    summaries, _, done = ingest.ingest_phenotypes(view(spark, d, f"SELECT * FROM {_POS}").join(clusters, "study"))
    return done.join(summaries, "study", "left").select("summary_id", "study", "n_clusters", "positive", "n_errors")


# The twin of the effect parser knows how the test texts are made: clauses apart by "; ", numbers in a fixed order.
_NUMS = r"list_transform(regexp_extract_all({}, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))"
_CLAUSES = f"(SELECT row_id, c, {_NUMS.format('c[1]')} AS h, {_NUMS.format('c[2]')} AS a, {_NUMS.format('c[3]')} AS q, upper(regexp_extract(c[1], '^[A-Za-z]+')) AS label FROM (SELECT row_id, string_split(trim(coalesce(effect_size_str, '')), '; ') AS c FROM {EV}))"
_RATIO = "label IN ('OR', 'AHR', 'RR')"
PARSED = _PARSED = f"""(SELECT row_id, CASE WHEN {_RATIO} THEN right(label, 2) WHEN len(a) > 0 THEN 'AUC' END AS effect_type,
 CASE WHEN {_RATIO} THEN h[1] ELSE a[1] END AS effect_value, CASE WHEN {_RATIO} THEN h[3] ELSE a[3] END AS ci_lo, CASE WHEN {_RATIO} THEN h[4] ELSE a[4] END AS ci_hi,
 h[5] AS p_value, a[1] AS auc, a[3] AS auc_ci_lo, a[4] AS auc_ci_hi, q[1] / 100 AS sens, q[2] AS spec, regexp_extract(c[4], '[0-9.]+$') AS cutoff FROM {_CLAUSES})"""
_FIELDS = ("effect_type", "effect_value", "ci_lo", "ci_hi", "p_value", "auc", "auc_ci_lo", "auc_ci_hi", "sens", "spec", "cutoff")


@query("f11_parse_effect", f"SELECT * FROM {_PARSED}")
def _(spark, d):
    rows = effects.with_parsed(evidence(spark, d).select("row_id", "effect_size_str"), "effect_size_str", "p")
    return rows.select("row_id", *[F.col(f"p.{f}").alias(f) for f in _FIELDS])


@query("s06_append_facts", f"SELECT m.row_id, coalesce(m.effect_value, p.effect_value) AS effect_value, coalesce(m.auc, p.auc) AS auc, coalesce(m.ci_lo, p.ci_lo) AS ci_lo, sha256(concat_ws(chr(31), m.row_id, coalesce(m.cohort_id, ''))) AS id FROM ({MODELS}) m JOIN {_PARSED} p ON p.row_id = m.row_id")
def _(spark, d):
    rows = effects.with_effect_fields(view(spark, d, MODELS)).withColumn("id", ingest.fact_id(["row_id", "cohort_id"]))
    return rows.select("row_id", "effect_value", "auc", "ci_lo", "id")


@query("s08_export_rows", "SELECT " + ", ".join((f"TRY_CAST(nullif(CAST({c} AS VARCHAR), '') AS {'VARCHAR' if t == 'string' else t}) AS {c}" if t != "int" or c != "cohort_size_n" else f"TRY_CAST(nullif({c}, '') AS INT) AS {c}") for c, t in ingest.EXPORT) + f" FROM {EV}")
def _(spark, d):
    return ingest.export_rows(evidence(spark, d))


_PREFERRED = ["paper_ref", "predictors"]


@query("s09_export_csv_columns", f"SELECT * FROM {EV}")
def _(spark, d):
    rows = evidence(spark, d).withColumn("_score", F.lit(1.0))
    return rows.select(*ingest.csv_columns(rows, _PREFERRED))


_TXT = "SELECT l_orderkey, l_linenumber, l_partkey, concat(CASE l_partkey % 6 WHEN 0 THEN '  Mean   Arterial – Pressure ' WHEN 1 THEN 'Seymour 2016 (Hagel, 2013)  Overall' WHEN 2 THEN '2019 to 2021.' WHEN 3 THEN 'SOFA and saps II, DBP' WHEN 4 THEN '１,234 ﬁt patients' ELSE 'In-hospital mortality;' END, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR(8)) END) AS s FROM {lineitem}"
_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "s")


def _plain(c: str) -> str:
    return f"translate(replace(replace({c}, '１', '1'), 'ﬁ', 'fi'), '‐‑‒–—―−', '-------')"


_FIELD = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({_plain('s')})), '(\\d{{4}})\\s*to\\s*(\\d{{4}})', '\\1-\\2', 'g'), '\\s+', ' ', 'g'), '[.,;:]+$', '')"


@query("f01_norm_text", f"SELECT l_orderkey, l_linenumber, l_partkey, s, {norm('s')} AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, text.norm_text(F.col("s")).alias("out"))


@query("f02_norm_anchor", f"SELECT l_orderkey, l_linenumber, l_partkey, s, lower(trim(regexp_replace(regexp_replace({_plain('s')}, '(\\d),(\\d{{3}})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, text.norm_anchor(F.col("s")).alias("out"))


@query("f03_norm_field", f"SELECT l_orderkey, l_linenumber, l_partkey, s, {_FIELD} AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, text.norm_field(F.col("s")).alias("out"))


@query("f04_norm_id_loose", f"SELECT l_orderkey, l_linenumber, l_partkey, s, regexp_replace(regexp_replace(lower(s), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, text.norm_id_loose(F.col("s")).alias("out"))


@query("f05_numeric_tokens", f"SELECT row_id, array_to_string(regexp_extract_all(anchor_text, '\\d+\\.?\\d*'), '|') AS tokens, array_to_string(list_transform(regexp_extract_all(coalesce(effect_size_str, ''), '<\\s*\\d+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda x: replace(x, ' ', '')), '|') AS effect_tokens FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", F.array_join(text.numeric_tokens(F.col("anchor_text")), "|").alias("tokens"), F.array_join(text.effect_tokens(F.col("effect_size_str")), "|").alias("effect_tokens"))


def _w(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


_A, _B = _w("outcome"), _w("model_specification")
_COMMON = f"len(list_intersect({_A}, {_B}))"


@query("f06_jaccard", f"SELECT row_id, round({_COMMON} / len(list_distinct(list_concat({_A}, {_B}))), 6) AS out FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", F.round(text.jaccard(text.words(F.col("outcome")), text.words(F.col("model_specification"))), 6).alias("out"))


@query("f07_token_f1", f"SELECT row_id, round(CASE WHEN len({_A}) + len({_B}) = 0 THEN 1 WHEN len({_A}) = 0 OR len({_B}) = 0 THEN 0 ELSE 2 * {_COMMON} / (len({_A}) + len({_B})) END, 6) AS out FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", F.round(text.token_f1(text.words(F.col("outcome")), text.words(F.col("model_specification"))), 6).alias("out"))


@query("f09_group_label", f"SELECT row_id, CASE WHEN regexp_matches(lower(anchor_text), 'non.?survivor|died') THEN 'Non-survivors' WHEN regexp_matches(lower(anchor_text), 'survivor|alive') THEN 'Survivors' END AS label FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", text.group_label(F.col("anchor_text")).alias("label"))


@query("f10_section_priority", f"SELECT row_id, CASE WHEN lower(anchor_section) LIKE '%table%' THEN 1 WHEN lower(anchor_section) LIKE '%fig%' THEN 2 WHEN regexp_matches(lower(coalesce(anchor_section, '')), 'result|body|method') THEN 3 ELSE 4 END AS priority FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", text.section_priority(F.col("anchor_section")).alias("priority"))


@query("f13_comma_decimals", f"SELECT l_orderkey, l_linenumber, l_partkey, s, CASE WHEN regexp_matches(s, '\\d\\.\\d') THEN s ELSE regexp_replace(s, '(\\d),(\\d)', '\\1.\\2', 'g') END AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, effects.comma_decimals(F.col("s")).alias("out"))


_CAT = " ".join(f"WHEN lower(trim(name)) IN ({', '.join(repr(w) for w in words)}) THEN '{c}'" for c, words in vocab.CATEGORIES.items())
_NAMES = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 8 WHEN 0 THEN ' Lactate' WHEN 1 THEN 'SOFA' WHEN 2 THEN 'age' WHEN 3 THEN 'GCS ' WHEN 4 THEN NULL WHEN 5 THEN 'news2' WHEN 6 THEN '' ELSE 'novel marker' END AS name FROM {lineitem}"


@query("f14_predictor_category", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE {_CAT} ELSE 'other' END AS category FROM ({_NAMES})")
def _(spark, d):
    return view(spark, d, _NAMES).select("l_orderkey", "l_linenumber", "l_partkey", vocab.predictor_category(F.col("name")).alias("category"))


def _chain(c: str, table) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{v}'" for p, v in table) + " END"


@query("f15_method", f"SELECT row_id, coalesce({_chain('model_specification', [(p, f) for p, f, _ in vocab.METHODS])}, 'other') AS family, coalesce({_chain('model_specification', [(p, n) for p, _, n in vocab.METHODS])}, 'other') AS method FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", vocab.method_family(F.col("model_specification")).alias("family"), vocab.method_name(F.col("model_specification")).alias("method"))


@query("f16_care_setting", f"SELECT row_id, coalesce({_chain('population_description', vocab.SETTINGS)}, {_chain('model_specification', vocab.SETTINGS)}, 'unknown') AS setting FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", vocab.care_setting(F.col("population_description"), F.col("model_specification")).alias("setting"))


_TP = "SELECT c_custkey, concat(CASE c_custkey % 9 WHEN 0 THEN '28-day' WHEN 1 THEN 'In-hospital mortality' WHEN 2 THEN 'ICU' WHEN 3 THEN 'death within one year' WHEN 4 THEN 'One-year  mortality.' WHEN 5 THEN '90 day mortality' WHEN 6 THEN '' WHEN 7 THEN 'mortality at 30d' ELSE 'readmission ' END, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' END) AS s FROM {customer}"
_TPN = "regexp_replace(regexp_replace(lower(trim(s)), '\\s+', ' ', 'g'), '[.,;:]+$', '')"
_CUT = f"trim(regexp_replace({_TPN}, '\\s*mortality\\s*$', ''))"


def _in(c: str, words: tuple[str, ...]) -> str:
    return f"{c} IN ({', '.join(repr(w) for w in words)})"


def _class_case(test) -> str:
    return "CASE " + " ".join(f"WHEN {test(w)} THEN '{k}'" for k, w in vocab.OUTCOMES.items()) + " END"


@query("f17_outcome_class", f"SELECT c_custkey, coalesce({_class_case(lambda w: _in(_TPN, w))}, {_class_case(lambda w: _in(_CUT, w))}, {_class_case(lambda w: '(' + ' OR '.join(f'contains(concat(chr(32), {_TPN}, chr(32)), {chr(39)} {x} {chr(39)})' for x in w) + ')')}, {_TPN}) AS class FROM ({_TP})")
def _(spark, d):
    return view(spark, d, _TP).select("c_custkey", vocab.outcome_class(F.col("s")).alias("class"))


def _expanded() -> str:
    out = f"concat(' ', {_FIELD}, ' ')"
    for a in sorted(vocab.ABBREVIATIONS, key=len, reverse=True):
        out = f"regexp_replace({out}, '([^a-z0-9]){a}([^a-z0-9])', '\\1{vocab.ABBREVIATIONS[a]}\\2', 'g')"
    return f"substr({out}, 2, length({out}) - 2)"


@query("f18_expand_abbreviations", f"SELECT l_orderkey, l_linenumber, l_partkey, s, {_expanded()} AS out FROM ({_TXT})")
def _(spark, d):
    return view(spark, d, _TXT).select(*_KEY, vocab.expand(F.col("s")).alias("out"))


_TIME = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Within 24 h of ICU admission' WHEN 1 THEN 'First 24 hours' WHEN 2 THEN 'ICU day 1' WHEN 3 THEN 'Day 7.' ELSE 'first day in ICU' END AS s FROM {orders}"


@query("f19_timing_bucket", f"SELECT o_orderkey, CASE WHEN contains(lower(s), '24 h') OR contains(lower(s), 'icu day 1') OR contains(lower(s), 'first day in icu') THEN 'FIRST_24H_ICU' ELSE rtrim(lower(s), '.') END AS bucket FROM ({_TIME})")
def _(spark, d):
    return view(spark, d, _TIME).select("o_orderkey", vocab.timing_bucket(F.col("s")).alias("bucket"))


_DOI = "SELECT o_orderkey, concat(CASE o_orderkey % 3 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'DOI: ' ELSE ' ' END, '10.1/X', CAST(o_custkey AS VARCHAR(9))) AS doi, concat('MIMIC-III', CASE o_orderkey % 4 WHEN 0 THEN ' v1.4' WHEN 1 THEN ' (Johnson)' WHEN 2 THEN ' 2016' ELSE '' END) AS label FROM {orders}"


@query("f20_doi_and_dataset", f"SELECT o_orderkey, substr(lower(doi), strpos(doi, '10.1')) AS doi, rtrim(replace(split_part(split_part(split_part(lower(label), ' v', 1), ' (', 1), ' 2', 1), ' ', '-'), '-') AS label FROM ({_DOI})")
def _(spark, d):
    return view(spark, d, _DOI).select("o_orderkey", text.norm_doi(F.col("doi")).alias("doi"), text.norm_dataset(F.col("label")).alias("label"))


@query("f22_cohort_size", f"SELECT cohort_id, coalesce(TRY_CAST(regexp_extract(replace(coalesce(cohort_size_n, ''), ',', ''), '\\d+') AS BIGINT), 0) AS size FROM ({COHORTS})")
def _(spark, d):
    return view(spark, d, COHORTS).select("cohort_id", text.cohort_size(F.col("cohort_size_n")).alias("size"))


@query("f23_year_and_stem", f"SELECT cohort_id, regexp_replace(file_name, '\\.pdf$', '') AS stem, TRY_CAST(regexp_extract(regexp_replace(file_name, '\\.pdf$', ''), '_(\\d{{4}})(_|$)', 1) AS INT) AS year FROM ({COHORTS})")
def _(spark, d):
    return view(spark, d, COHORTS).select("cohort_id", text.stem(F.col("file_name")).alias("stem"), text.year_of_stem(text.stem(F.col("file_name"))).alias("year"))


_BB = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN concat('[', l_partkey, ', 2.5, 3, ', l_suppkey, ']') WHEN 1 THEN concat(l_partkey, ',2,3') WHEN 2 THEN NULL ELSE concat('l: ', l_partkey, ', t: 1, r: 7.126, b: 9') END AS raw, l_suppkey FROM {lineitem}"


@query("f25_bbox", f"SELECT l_orderkey, l_linenumber, l_partkey, raw, CASE WHEN len(n) = 4 THEN concat_ws(',', printf('%.2f', n[1]), printf('%.2f', n[2]), printf('%.2f', n[3]), printf('%.2f', n[4])) END AS bbox FROM (SELECT *, list_transform(regexp_extract_all(coalesce(raw, ''), '[0-9.]+'), lambda x: CAST(x AS DOUBLE)) AS n FROM ({_BB}))")
def _(spark, d):
    return view(spark, d, _BB).select("l_orderkey", "l_linenumber", "l_partkey", "raw", text.bbox_text(F.col("raw")).alias("bbox"))


@query("f30_display_formats", f"SELECT row_id, CASE WHEN ci_lo IS NULL OR ci_hi IS NULL THEN '' ELSE printf('%.2f-%.2f', ci_lo, ci_hi) END AS ci, coalesce(printf('%.3f', auc), '') AS auc_text, CASE WHEN paper_ref IS NOT NULL THEN concat(paper_ref, ' p.', anchor_page) ELSE '' END AS source FROM {EV}")
def _(spark, d):
    return evidence(spark, d).select("row_id", text.interval(F.col("ci_lo"), F.col("ci_hi")).alias("ci"), text.fixed(F.col("auc")).alias("auc_text"), text.source(F.col("paper_ref"), F.col("anchor_page")).alias("source"))
