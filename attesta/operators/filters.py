"""Filters of the evidence table, with relaxation of the outcome window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import text_of

COMMON_WINDOWS = (28, 30, 60, 90, 180, 365)


#: Letters of the grams by which references are looked up.
GRAM = 3


def like(c: Column, part: str) -> Column:
    """Case-insensitive LIKE %part%; wildcards in part keep their meaning."""
    return F.lower(c).like(f"%{part.lower()}%")


def evidence_filter(rows: DataFrame, outcome_type: str | None = None, window: int | None = None, predictor: str | None = None, paper_ref: str | None = None, condition: str | None = None, setting: str | None = None) -> DataFrame:
    """Conjunction of the given conditions."""
    tests = []
    if outcome_type:
        tests.append(F.col("outcome_type") == outcome_type)
    if window is not None:
        tests.append(F.col("outcome_window_days") == window)
    if predictor:
        tests.append((F.lower("predictor_canonical") == predictor.lower()) | like(F.col("predictors"), predictor))
    if paper_ref:
        tests.append(like(F.col("paper_ref"), paper_ref))
    if condition:
        tests.append(like(F.col("population_description"), condition))
    if setting:
        tests.append(like(F.col("population_description"), setting) | like(F.col("population_location"), setting))
    for t in tests:
        rows = rows.filter(t)
    return rows


def rank_filter(rows: DataFrame, outcome_type: str = "mortality", window: int | None = None, paper_ref: str | None = None, population: str | None = None) -> DataFrame:
    rows = evidence_filter(rows, outcome_type, window, paper_ref=paper_ref)
    return rows.filter(like(F.col("population_description"), population) | like(F.col("population_location"), population)) if population else rows


def drop_rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.lower(text_of(F.col("verifier_verdict"))) != "reject")


def window_tier(window: Column, target: int) -> Column:
    """0 the target itself, 1… the common windows within five days, nearest and smaller first, last any other."""
    near = sorted((w for w in COMMON_WINDOWS if w != target and abs(w - target) <= 5), key=lambda w: (abs(w - target), w))
    tier = F.when(window == target, 0)
    for i, w in enumerate(near, 1):
        tier = tier.when(window == w, i)
    return tier.otherwise(len(near) + 1)


def relax_window(rows: DataFrame, target: int | None, ranking: bool = False, clean=lambda df: df, keep: DataFrame | None = None) -> DataFrame:
    """Rows of the first window tier that has any after ``clean``, with matched_window and note.

    The last tier shows all windows: it holds the rows of every tier; ``keep``
    replaces the rows of that tier (another filter may hold without a window).
    The least tier is one row, joined back by broadcast.
    """
    if target is None:
        return clean(rows).withColumns({"matched_window": F.lit(None).cast("int"), "note": F.lit(None).cast("string")})
    cleaned = clean(rows).withColumn("tier", window_tier(F.col("outcome_window_days"), target))
    near = sum(w != target and abs(w - target) <= 5 for w in COMMON_WINDOWS)
    first = F.broadcast(cleaned.agg(F.coalesce(F.min("tier"), F.lit(near + 1)).alias("first")))
    exact = F.lit(f"Exact {target}-day window matched." if ranking else None).cast("string")
    word = "snapped to" if ranking else "showing"
    shown = F.concat(F.lit(f"No studies report {target}-day; {word} "), F.col("outcome_window_days").cast("string"), F.lit("-day."))
    missed = F.lit(f"No exact match for {target}-day; showing all windows for this outcome.")
    is_open = F.col("first") > near
    rows = cleaned.join(first, F.lit(True)).filter((F.col("tier") == F.col("first")) | is_open if keep is None else (F.col("tier") == F.col("first")) & ~is_open)
    if keep is not None:
        rows = rows.unionByName(clean(keep).withColumn("tier", F.lit(near + 1)).join(first, F.lit(True)).filter(is_open))
    rows = rows.withColumns({"matched_window": F.when(~is_open, F.col("outcome_window_days")), "note": F.when(is_open, missed).when(F.col("tier") == 0, exact).otherwise(shown)})
    return rows.drop("tier", "first")


def capped(rows: DataFrame, limit: int = 200) -> DataFrame:
    return rows.orderBy("row_id").limit(limit)


def _holding(names: DataFrame, refs: DataFrame) -> DataFrame:
    """The names (name) that hold a reference (ref): each reference is looked up by its rarest gram among the names.

    References too short to have a gram are few different ones, whatever their number; they are tested on every name.
    """
    refs = refs.select(F.lower("ref").alias("ref")).filter("ref is not null").distinct()

    def grams(rows: DataFrame, c: str) -> DataFrame:
        return rows.select(c, F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("gram"))

    index = grams(names, "name")
    known = grams(refs.filter(F.length("ref") >= GRAM), "ref").join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = known.groupBy("ref").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("ref", "g.gram")
    long = index.join(rarest, "gram").filter(F.col("name").contains(F.col("ref"))).select("name")
    short = names.join(refs.filter(F.length("ref") < GRAM), F.col("name").contains(F.col("ref")), "left_semi")
    return long.unionByName(short).distinct()


def scope_rows(rows: DataFrame, refs: DataFrame, held_out: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """Rows whose paper_ref and cohort_id hold a reference (column ref), case-insensitively, and no held-out one;
    with a run_id, of that run alone.

    Names repeat over many rows, so the distinct names are tested, and rows are kept by an equi-join on the name.
    """
    rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
    rows = rows.withColumn("__name", F.lower(F.concat_ws(" ", "paper_ref", "cohort_id")))
    names = rows.select(F.col("__name").alias("name")).distinct()
    wanted = _holding(names, refs)
    if held_out is not None:
        wanted = wanted.join(_holding(wanted, held_out), "name", "left_anti")
    return rows.join(wanted.withColumnRenamed("name", "__name"), "__name", "left_semi").drop("__name")


def key_hashes(keys: list[Column]) -> list[Column]:
    """128 bits that stand for the values of the keys, NULLs included."""
    told = [x for k in keys for x in (k.isNull(), k)]
    return [F.xxhash64(*told).alias("__h1"), F.xxhash64(F.lit("second"), *told).alias("__h2")]


def first_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, by ascending order, then row_id, which tells rows apart.

    One aggregation with partial combine on hashes of the key carries the row along: no window over a hot key, the
    input is read once, and nothing is joined back. Callers select the columns that they need before.
    """
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "row_id")
    rest = [c for c in rows.columns if c != "row_id"]
    if not rest:
        won = rows.select(*key_hashes(keys), place.alias("place")).groupBy("__h1", "__h2").agg(F.min("place").alias("place"))
        return won.select("place.row_id")
    narrow = rows.select(*key_hashes(keys), place.alias("place"), F.struct(*rest).alias("row"))
    won = narrow.groupBy("__h1", "__h2").agg(F.min_by(F.struct("row", "place.row_id"), "place").alias("won"))
    return won.select("won.row_id", "won.row.*").select(*rows.columns)
