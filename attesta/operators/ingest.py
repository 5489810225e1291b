"""Ingestion jobs: schemas, merges, resumable work, logged responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import text_of


def align_schema(rows: DataFrame, schema: T.StructType, key: str = "row_id", other_key: str = "id") -> DataFrame:
    """Columns of the schema in its order; absent ones are NULL; the key may have its other name."""
    if key not in rows.columns and other_key in rows.columns:
        rows = rows.withColumnRenamed(other_key, key)
    return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Target with the updates' listed columns; new keys are added; the last update of a key wins."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__u"))
    out = target.join(last, key, "full")
    return out.select(key, *[(F.when(F.col("__u").isNotNull(), F.col(f"__u.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in target.columns if c != key])


def pending(targets: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Targets that are not completed; only runs without errors complete a key."""
    return targets if force else targets.join(done.filter("n_errors = 0").select(key), key, "left_anti")


def cache_key(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns; blanks are left out, names are sorted."""
    named = [F.when(F.trim(text_of(F.col(c))) != "", F.col(c).cast("string")).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def ingest_responses(raw: DataFrame, schema: str = "k int, score double, verdict string", verdicts: tuple[str, ...] = ("ok", "partial", "reject")) -> DataFrame:
    """Adds the parsed fields of ``response`` and reason (NULL if it is valid).

    The text from the first brace to the last is read as JSON; scores are clamped to [0, 1].
    """
    body = F.regexp_extract(text_of(F.col("response")), r"(?s)\{.*\}", 0)
    rows = raw.withColumn("__j", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    verdict = F.coalesce("__j.verdict", F.lit("partial"))
    reason = F.when(body == "", "no JSON object").when(F.col("__j.k").isNull(), "missing field").when(~verdict.isin(*verdicts), "verdict not allowed")
    score = F.least(F.greatest(F.coalesce("__j.score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({"k": F.col("__j.k"), "verdict": verdict, "score": score, "reason": reason}).drop("__j")


def ingest_phenotypes(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, clusters, done) of classifications (study, positive, clusters array).

    A positive one gives a summary and its clusters, which carry the summary's id; a negative one gives no
    facts, but its study is done all the same.
    """
    yes = responses.filter("positive").withColumn("summary_id", F.sha2(F.col("study").cast("string"), 256))
    done = responses.select("study", F.coalesce("positive", F.lit(False)).alias("positive"), F.lit(0).alias("n_errors"))
    return yes.select("summary_id", "study", F.size("clusters").alias("n_clusters")), yes.select("summary_id", F.explode("clusters").alias("c")).select("summary_id", "c.*"), done


def fact_id(columns: list[str]) -> Column:
    """Id of a fact from its business key: the same for every retry."""
    return F.sha2(F.concat_ws("\x1f", *[text_of(F.col(c)) for c in columns]), 256)


# The exported columns in their order, with their types.
EXPORT = (
    ("row_id", "string"), ("paper_ref", "string"), ("cohort_label", "string"), ("file_name", "string"), ("cohort_size_n", "int"),
    ("population_description", "string"), ("population_location", "string"), ("study_design", "string"), ("mortality_rate_pct", "double"), ("mortality_timepoint", "string"),
    ("predictors", "string"), ("predictor_canonical", "string"), ("outcome", "string"), ("outcome_type", "string"), ("outcome_window_days", "int"), ("model_specification", "string"),
    ("effect_size_str", "string"), ("effect_type", "string"), ("effect_value", "double"), ("ci_lo", "double"), ("ci_hi", "double"), ("p_value", "double"), ("auc", "double"),
    ("anchor_page", "int"), ("anchor_bbox", "string"), ("anchor_text", "string"), ("anchor_section", "string"), ("verifier_verdict", "string"), ("verifier_score", "double"),
)


def export_rows(rows: DataFrame) -> DataFrame:
    """Fixed columns in fixed order; what does not fit its type, and '', is NULL. Columns of their type are not cast."""
    types = dict(rows.dtypes)

    def exported(c: str, t: str) -> Column:
        if c not in types:
            return F.lit(None).cast(t)
        if types[c] == t:
            return F.when(F.col(c) != "", F.col(c)) if t == "string" else F.col(c)
        return F.nullif(F.col(c).cast("string"), F.lit("")).try_cast(t)

    return rows.select([exported(c, t).alias(c) for c, t in EXPORT])


def csv_columns(rows: DataFrame, preferred: list[str]) -> list[str]:
    """Scalar columns without leading underscore: preferred first, the others by name."""
    scalar = [f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and not f.name.startswith("_")]
    return [c for c in preferred if c in scalar] + sorted(c for c in scalar if c not in preferred)


def write_csv(rows: DataFrame, path: str, preferred: list[str]) -> None:
    """Every cell quoted, quotes doubled."""
    rows.select(*csv_columns(rows, preferred)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def text_offsets(items: DataFrame, heading_most: int = 40) -> DataFrame:
    """(doc_id, item, text, start, end, section) of ordered layout items; blank ones are skipped.

    Short items are headings; a text belongs to the last heading at or before it.
    """
    rows = items.withColumn("text", F.trim("text")).filter("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("item")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    section = F.last(F.when(F.length("text") < heading_most, F.col("text")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"start": start, "section": section})
    return rows.select("doc_id", "item", "text", "start", (F.col("start") + F.length("text")).alias("end"), "section")


def section_texts(offsets: DataFrame) -> DataFrame:
    """(doc_id, section, text): the section's items joined by newlines, in order."""
    own = F.sort_array(F.collect_list(F.struct("item", "text")))
    return offsets.groupBy("doc_id", "section").agg(own.alias("i")).select("doc_id", "section", F.array_join("i.text", "\n").alias("text"))


STOCK_TITLES = ("original article", "research article", "open access")


def pick_title(items: DataFrame) -> DataFrame:
    """(doc_id, title): the first title item, else the longest first-page header of 15 characters or more."""
    low = F.lower("text")
    upper = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit(1))
    shouted = (upper > 0.75) & ~F.col("text").contains(" ")
    good = (F.col("label") == "section_header") & (F.col("page") == 1) & (F.length("text") >= 15) & F.col("text").rlike("[A-Za-z]") & ~shouted & ~low.isin(*STOCK_TITLES)
    first = F.min(F.when((F.col("label") == "title") & (F.trim("text") != ""), F.struct("item", "text")))
    longest = F.max(F.when(good, F.struct(F.length("text").alias("n"), F.col("text").alias("text"))))
    return items.groupBy("doc_id").agg(first.alias("a"), longest.alias("b")).select("doc_id", F.coalesce("a.text", "b.text", F.concat(F.lit("document-"), F.col("doc_id").cast("string"))).alias("title"))


def grounding_context(titles: DataFrame, bodies: DataFrame, cells: DataFrame, most: int = 150_000) -> DataFrame:
    """(doc_id, context): title, body and each table's rows in order, at most ``most`` characters.

    Cells are (doc_id, table, row, col, text); tables stand in their order, apart by blank lines.
    """
    rows = cells.groupBy("doc_id", "table", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("c"))
    rows = rows.select("doc_id", "table", "row", F.array_join("c.text", " | ").alias("line"))
    tables = rows.groupBy("doc_id", "table").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("r"))
    tables = tables.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table", F.array_join("r.line", "\n").alias("lines")))).alias("t"))
    tables = tables.select("doc_id", F.array_join("t.lines", "\n\n").alias("tables"))
    out = titles.join(bodies, "doc_id", "left").join(tables, "doc_id", "left")
    return out.select("doc_id", F.substring(F.concat_ws("\n\n", F.concat(F.lit("TITLE: "), "title"), "body", "tables"), 1, most).alias("context"))


BULKY = ("full_text", "offsets")


def slim_documents(documents: DataFrame, most: int = 200_000) -> DataFrame:
    """(doc_id, slim): each document as JSON without its bulky columns, at most ``most`` characters."""
    kept = [c for c in documents.columns if c not in BULKY]
    return documents.select("doc_id", F.substring(F.to_json(F.struct(*kept)), 1, most).alias("slim"))
