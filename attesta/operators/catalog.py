"""Corpus catalog, verdict buckets, phenotype nesting and display sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import stem, text_of, year_of_stem

BUCKETS = ("ok", "weak", "fail", "unverified")


def normalize_verdict(c: Column) -> Column:
    """ok, weak, fail; NULL for blank; anything else is unverified."""
    v = F.lower(F.trim(text_of(c)))
    return F.when(v == "", None).when(v.isin("ok", "pass"), "ok").when(v.isin("weak", "warn", "partial"), "weak").when(v.isin("fail", "reject"), "fail").otherwise("unverified")


def bucket(c: Column) -> Column:
    return F.coalesce(normalize_verdict(c), F.lit("unverified"))


def verdict_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per group in total and per bucket."""
    own = bucket(F.col("verifier_verdict"))
    return rows.groupBy(*by).agg(F.count("row_id").alias("n_rows"), *[F.count(F.when(F.col("row_id").isNotNull() & (own == b), 1)).alias(f"n_{b}") for b in BUCKETS])


def catalog(papers: DataFrame, cohorts: DataFrame, models: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per paper of either table: counts, title, year (from the name if NULL), parsed flag.

    The evidence is counted per cohort before the join, so that it is not
    shuffled again by paper.
    """
    per_cohort = verdict_counts(models, "cohort_id")
    counts = cohorts.select(stem(F.col("file_name")).alias("stem"), "cohort_id").join(per_cohort, "cohort_id", "left")
    names = ["n_rows", *[f"n_{b}" for b in BUCKETS]]
    counts = counts.groupBy("stem").agg(F.count("cohort_id").alias("n_cohorts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    known = papers.select(stem(F.col("file_name")).alias("stem"), "title", "year")
    out = known.join(counts, "stem", "full").join(listing.select("stem", F.lit(True).alias("parsed")), "stem", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ["n_cohorts", *names]}
    return out.withColumns({**zero, "year": F.coalesce("year", year_of_stem(F.col("stem"))), "parsed": F.coalesce("parsed", F.lit(False))})


def known_keys(keys: DataFrame, papers: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Keys (column stem) of a paper or a cohort, with or without the file ending."""
    both = papers.select(stem(F.col("file_name")).alias("known")).unionByName(cohorts.select(stem(F.col("file_name")).alias("known")))
    return keys.join(both, stem(F.col("stem")) == F.col("known"), "left_semi")


def document_states(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds parsed and translated to (stem): whether stem.json and stem.pre-translate.json are listed."""
    names = listing.select("name").distinct()
    parsed = names.filter("name like '%.json' and name not like '%.pre-translate.json'").select(F.regexp_replace("name", r"\.json$", "").alias("stem"), F.lit(True).alias("p"))
    translated = names.filter("name like '%.pre-translate.json'").select(F.regexp_replace("name", r"\.pre-translate\.json$", "").alias("stem"), F.lit(True).alias("t"))
    out = documents.join(parsed, "stem", "left").join(translated, "stem", "left")
    return out.withColumns({"parsed": F.coalesce("p", F.lit(False)), "translated": F.coalesce("t", F.lit(False))}).drop("p", "t")


def nest_clusters(summaries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Summaries with their clusters as an array ordered by label (NULL as '')."""
    own = F.struct(text_of(F.col("cluster_label")).alias("label"), F.col("cluster_size").alias("size"))
    nested = clusters.groupBy("summary_id").agg(F.sort_array(F.collect_list(own)).alias("clusters"))
    return summaries.join(nested, "summary_id", "left")


SORTS = {"title": "text", "year": "number", "n_rows": "number", "n_ok": "number", "n_weak": "number", "n_fail": "number", "n_unverified": "number", "stem": "text", "n_cohorts": "number"}


def catalog_order(column: str = "n_rows", descending: bool = True) -> list[Column]:
    key = F.coalesce(column, F.lit(0)) if SORTS[column] == "number" else F.lower(text_of(F.col(column)))
    return [key.desc() if descending else key.asc(), F.col("stem")]


def evidence_order(key: str, descending: bool = False) -> list[Column]:
    """Order by the first number of the effect text, by verdict, or by a plain column."""
    if key == "effect":
        first = F.regexp_extract(text_of(F.col("effect_size_str")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
        value = F.coalesce(first, F.lit(float("inf")))
    elif key == "verdict":
        value = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket(F.col("verifier_verdict")))
    else:
        value = F.lower(text_of(F.col(key)))
    return [value.desc() if descending else value.asc(), F.col("row_id")]


def phenotype_diagnostics(summaries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Anchors and verdicts of phenotype facts (study, anchor_page, verifier_verdict), summaries and clusters
    together: a row for each study and one, with study NULL, for all."""
    columns = ("study", "anchor_page", "verifier_verdict")
    facts = summaries.select(*columns).unionByName(clusters.select(*columns))
    facts = facts.withColumns({"anchored": F.col("anchor_page").isNotNull(), "bucket": bucket(F.col("verifier_verdict"))})
    counts = [F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in BUCKETS]
    out = facts.groupingSets([["study"], []], "study").agg(F.count("*").alias("n"), F.count_if("anchored").alias("n_anchored"), *counts, F.grouping("study").alias("g"))
    share = F.try_divide(F.col("n_anchored").cast("double"), F.col("n"))
    return out.select("study", (F.col("g") == 1).alias("overall"), "n", "n_anchored", share.alias("anchor_rate"), *[f"n_{b}" for b in BUCKETS])


def quality_rates(rows: DataFrame, by: list[str], tolerance: float = 0.01) -> DataFrame:
    """Per group: share of rows with a bound anchor, share of stored boxes (bbox_text) that agree with the
    resolved one (found_bbox) in all four numbers, share of rejected rows. NULL without any to judge."""

    def box(c: str):
        return F.transform(F.split(F.col(c), ","), lambda x: x.try_cast("double"))

    near = F.zip_with(box("anchor_bbox"), box("found_bbox"), lambda a, b: F.abs(a - b) <= tolerance)
    both = F.col("anchor_bbox").isNotNull() & F.col("found_bbox").isNotNull()
    agree = F.size(box("anchor_bbox")) == 4
    agree = agree & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))
    rejected = F.lower(F.trim(text_of(F.col("verifier_verdict")))) == "reject"
    return rows.groupBy(*by).agg(
        F.avg(F.col("anchor_page").isNotNull().cast("double")).alias("bound_rate"),
        F.avg(F.when(both, agree.cast("double"))).alias("bbox_rate"),
        F.avg(rejected.cast("double")).alias("reject_rate"),
    )


def export_manifest(rows: DataFrame, content: list[str], generated_at: str, version: str = "1") -> DataFrame:
    """One row: rows, papers, a hash of the content columns that no order of rows changes, time and version.

    The hash is the exclusive or of 48 bits of each row's MD5, and their sum modulo 2 to the 31: equal rows
    that come in pairs still count.
    """
    text = F.concat_ws("\x1f", *[text_of(F.col(c)) for c in content])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    out = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("paper_ref").alias("n_papers"), F.bit_xor(bits).alias("x"), F.sum(F.pmod(bits, F.lit(2**31))).alias("s"))
    return out.select("n_rows", "n_papers", F.concat_ws("-", F.coalesce("x", F.lit(0)), F.pmod(F.coalesce("s", F.lit(0)), F.lit(2**31))).alias("content"), F.lit(generated_at).alias("generated_at"), F.lit(version).alias("schema_version"))
