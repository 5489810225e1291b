"""Phrase search over ordered text items, and vector top-k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space; the soft hyphen, which is not there for a reader.
BLANK, SOFT = r" \t\n\r\f\x{00A0}", r"\x{00AD}"
#: Items of one block, of which a task holds the running sum; letters of one stretch of text that is searched as a whole.
BLOCK, STRETCH = 4096, 4096


def _folded(c: Column) -> Column:
    """Lower case, letter by letter: only where no letter becomes two."""
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def placed(items: DataFrame) -> DataFrame:
    """(doc_id, item, text, piece, start): what each item adds to the joined text of its document, and where.

    White space is collapsed, soft hyphens are dropped, one blank stands between items. An item that ends in a hyphen
    loses it, and the blank, where the next one begins with a letter. Items without a letter add nothing. Running sums
    are taken in blocks of items and over the blocks, so a long document is not one task.
    """
    body = F.regexp_replace(F.regexp_replace(F.col("text"), f"^[{BLANK}{SOFT}]+|(?<![{SOFT}]){SOFT}+", ""), f"[{BLANK}]+", " ")
    rows = items.select("doc_id", "item", "text", _folded(body).alias("body"), F.floor(F.col("item") / BLOCK).alias("block")).filter("body <> ''")
    blocks = rows.groupBy("doc_id", "block").agg(F.min_by(F.substring("text", 1, 1), "item").alias("head"))
    after = blocks.select("doc_id", "block", F.lead("head").over(Window.partitionBy("doc_id").orderBy("block")).alias("later"))
    own = Window.partitionBy("doc_id", "block").orderBy("item")
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.block") == F.col("a.block"))
    following = F.coalesce(F.lead(F.substring("text", 1, 1)).over(own), "later", F.lit(""))
    rows = rows.alias("r").join(after.alias("a"), same).select("r.doc_id", "item", "text", "body", "r.block", "later").withColumn("next", following)
    joins = F.col("text").endswith("-") & F.col("next").rlike("^[A-Za-z]")
    piece = F.when(joins, F.expr("substring(body, 1, length(body) - 1)")).when(F.col("body").endswith(" "), F.col("body")).otherwise(F.concat("body", F.lit(" ")))
    rows = rows.withColumn("piece", piece).withColumn("inside", F.coalesce(F.sum(F.length("piece")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = rows.groupBy("doc_id", "block").agg(F.sum(F.length("piece")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("doc_id", "block", before.alias("before")).alias("s")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.block") == F.col("s.block"))
    return rows.alias("r").join(sums, same).select("r.doc_id", "item", "text", "piece", (F.col("inside") + F.col("before")).cast("long").alias("start"))


def _stretches(rows: DataFrame, overlap: int) -> DataFrame:
    """(doc_id, stretch, text): STRETCH letters of the joined text, and ``overlap`` more."""
    end = F.col("start") + F.length("piece")
    first, last = F.floor(F.greatest(F.col("start") - overlap, F.lit(0)) / STRETCH), F.floor((end - 1) / STRETCH)
    each = rows.select("doc_id", "start", "piece", F.explode(F.sequence(first, last)).alias("stretch"))
    lo = F.greatest(F.col("start"), F.col("stretch") * STRETCH)
    hi = F.least(end, (F.col("stretch") + 1) * STRETCH + overlap)
    part = F.substring("piece", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    parts = each.withColumn("part", part).groupBy("doc_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("p"))
    return parts.select("doc_id", "stretch", F.array_join("p.part", "").alias("text"))


def _apart(found: DataFrame, length: int) -> DataFrame:
    """Places (doc_id, at) that are taken from the left, each where the one before has ended."""
    order = Window.partitionBy("doc_id").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) >= length).cast("int"), F.lit(1))
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "run").agg(F.sort_array(F.collect_list("at")).alias("run_at"))
    none = F.array().cast("array<bigint>")
    taken = F.aggregate("run_at", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) >= length), F.concat(acc, F.array(x))).otherwise(acc))
    return runs.select("doc_id", F.explode(F.when(F.size("run_at") == 1, F.col("run_at")).otherwise(taken)).alias("at"))


def _raw_offset(text: Column, k: Column) -> Column:
    """Offset in the item's text of letter k of what it adds: each letter is one unit of the text."""
    lead = F.regexp_extract(text, f"^[{BLANK}{SOFT}]*", 0)
    units = F.regexp_extract_all(F.substring(text, F.length(lead) + 1, F.length(text)), F.lit(f"[{BLANK}][{BLANK}{SOFT}]*|[^{BLANK}{SOFT}]{SOFT}*"), F.lit(0))
    return (F.length(lead) + F.length(F.array_join(F.slice(units, F.lit(1), k), ""))).cast("int")


def phrase_hits(items: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, start_item, start_offset, end_item, end_offset) of hits that do not overlap, whatever their case.

    The joined text is searched in overlapping stretches; a hit's ends meet the items that lie in their stretch.
    """
    needle = re.sub("[ \t\n\r\f\u00a0]+", " ", phrase.replace("\u00ad", "")).strip().lower()
    rows = placed(items.filter("text is not null"))
    if not needle:
        return rows.select("doc_id", *[F.col("item").alias(c) for c in ("start_item", "start_offset", "end_item", "end_offset")]).limit(0)
    texts = _stretches(rows, len(needle) - 1).filter(F.col("text").contains(needle))
    cut = F.posexplode(F.split("text", f"(?=\\Q{needle}\\E)"))  # a part begins at each hit, and one at the front
    parts = texts.select("doc_id", "stretch", F.col("text").startswith(needle).alias("at_front"), cut.alias("pos", "part"))
    order = Window.partitionBy("doc_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum(F.length("part")).over(order), F.lit(0)))
    found = parts.filter(((F.col("pos") > 0) | F.col("at_front")) & (F.col("before") < STRETCH))
    return _located(_apart(found.select("doc_id", (F.col("stretch") * STRETCH + F.col("before")).alias("at")), len(needle)), rows, len(needle))


def _located(hits: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Both ends of each hit as (item, offset in its text): an interval join of places and items by stretch."""
    end = F.col("start") + F.length("piece")
    spread = rows.select("doc_id", "item", "text", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((end - 1) / STRETCH))).alias("stretch"))
    ends = F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("at").alias("place")), F.struct(F.lit("end").alias("side"), (F.col("at") + length - 1).alias("place"))))
    each = hits.select("doc_id", "at", ends.alias("e")).select("doc_id", "at", "e.*").withColumn("stretch", F.floor(F.col("place") / STRETCH))
    h, r = each.alias("h"), spread.alias("r")
    inside = F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.stretch") == F.col("r.stretch")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))
    met = h.join(r, inside).select("h.doc_id", "at", "side", "item", _raw_offset(F.col("text"), (F.col("place") - F.col("start")).cast("int")).alias("offset"))
    by = met.groupBy("doc_id", "at").agg(*[F.max(F.when(F.col("side") == side, F.struct("item", "offset"))).alias(side) for side in ("start", "end")])
    return by.select("doc_id", F.col("start.item").alias("start_item"), F.col("start.offset").alias("start_offset"), F.col("end.item").alias("end_item"), (F.col("end.offset") + 1).alias("end_offset"))


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, cosine): the k vectors nearest to the one of ``query`` (a table of one row)."""
    q = F.broadcast(query.select(F.col("embedding").cast("array<double>").alias("q")).limit(1))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(q, F.lit(True))
    cosine = F.try_divide(dot(F.col("v"), F.col("q")), F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q"))))
    return rows.select("vec_id", cosine.alias("cosine")).orderBy(F.desc_nulls_last("cosine"), "vec_id").limit(k)
