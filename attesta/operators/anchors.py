"""Binding of verbatim anchors to spans of documents.

Anchors meet the spans that an inverted index names (``anchor_index``). On these
pairs a case expression tries the tiers from exact to loose, and one aggregation
per anchor with partial combine keeps the first tier that hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import jaccard, norm_anchor, text_of, words
from attesta.operators.anchor_index import ALIKE, ALIKE_LENGTH, HEAD_LENGTH, PROBE_LENGTH, candidates, label_of, long_documents, packed, paired, prepared, probe_of
from attesta.sources.staging import stage

EXACT, NORMAL, PACKED, PIPE, TOKENS, HEAD, LABEL = range(1, 8)


def with_forms(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"text_packed": packed(F.col("text_norm")), "text_words": words(F.col("text"))})


def tier(last: int = LABEL) -> Column:
    """Tier of a pair of anchor and span, up to the last, NULL if none holds."""
    n = F.length("anchor")
    probe, label = probe_of(F.col("anchor_norm")), label_of(F.col("anchor_norm"))
    tests = {
        EXACT: F.col("text").contains(F.col("anchor")),
        NORMAL: (F.col("anchor_norm") != "") & F.col("text_norm").contains(F.col("anchor_norm")),
        PACKED: (F.length("anchor_packed") >= 12) & F.col("text_packed").contains(F.col("anchor_packed")),
        PIPE: F.col("anchor").contains("|") & (F.length(probe) >= PROBE_LENGTH) & F.col("text_norm").contains(probe),
        TOKENS: (n >= ALIKE_LENGTH) & (jaccard(F.col("anchor_words"), F.col("text_words")) >= ALIKE),
        HEAD: (n >= HEAD_LENGTH) & F.col("text_norm").contains(F.substring("anchor_norm", 1, HEAD_LENGTH)),
        LABEL: (label != "") & (F.col("kind") == "table_cell") & (F.col("text_norm") == label),
    }
    return reduce(lambda out, t: out.when(tests[t], t), range(NORMAL, last + 1), F.when(tests[EXACT], EXACT))


def resolve(anchors: DataFrame, spans: DataFrame, last: int = LABEL, keep: tuple[str, ...] = ("item", "text", "page")) -> DataFrame:
    """(anchor_id, tier, and item, text and page, or what is kept of them) of anchors (anchor_id, doc_id, anchor,
    anchor_section).

    Spans are (doc_id, item, text, page, section, kind). Of a piped anchor's hits
    table cells and spans inside the anchor come first; then those of the anchor's
    section, the shortest text, the least item. Heads must hit once, labels are
    table cells on one page; a tier that fails so gives way to the next. Empty
    anchors have no hit. Tiers after the last are not tried. Documents of many spans and anchors are resolved by the
    index, the others pair by pair.
    """
    spans = stage(spans.select("doc_id", "item", "text", "page", "section", "kind"), "spans")
    anchors = anchors.filter("anchor <> ''").select("anchor_id", "doc_id", "anchor", "anchor_section")
    long = long_documents(anchors, spans)
    tests = {"alike": last >= TOKENS, "labels": last >= LABEL}
    if long is None:
        pairs = _tiers(paired(anchors, spans, **tests), last)
    else:
        a, s = (x.join(long, "doc_id", "left_semi") for x in (anchors, spans))
        s = prepared(s)
        named = candidates(a, s, full=last >= TOKENS).withColumnRenamed("doc_id", "own").join(s, "span").filter("own = doc_id")
        pairs = _tiers(with_forms(named), last)
        short = _tiers(paired(*(x.join(long, "doc_id", "left_anti") for x in (anchors, spans)), **tests), last)
        pairs = pairs.unionByName(short)
    per = pairs.groupBy("anchor_id", "tier").agg(F.min_by(F.struct(*keep), "order").alias("hit"), F.count("*").alias("n"), (F.min("page") != F.max("page")).alias("pages"))
    per = per.filter(~((F.col("tier") == HEAD) & (F.col("n") > 1)) & ~((F.col("tier") == LABEL) & F.coalesce("pages", F.lit(False))))
    best = per.groupBy("anchor_id").agg(F.min_by("hit", "tier").alias("hit"), F.min("tier").alias("tier"))
    return best.select("anchor_id", "tier", *[f"hit.{c}" for c in keep])


def _tiers(pairs: DataFrame, last: int) -> DataFrame:
    """(anchor_id, tier, item, text, page, order) of the pairs that hit; the least order is the best of a tier."""
    if "text_words" not in pairs.columns:
        pairs = pairs.withColumn("text_words", words(F.col("text")))
    # a filter on the tier would become part of the join, whose code would then be too long for the JVM to compile
    pairs = pairs.withColumn("tier", F.explode(F.filter(F.array(tier(last)), lambda t: t.isNotNull())))
    section = F.lower(F.trim(text_of(F.col("anchor_section"))))
    miss = F.when((section != "") & (F.lower(F.trim(text_of(F.col("section")))) == section), 0).otherwise(1)
    inside = F.col("anchor_norm").contains(F.col("text_norm")) | F.coalesce(F.col("kind") == "table_cell", F.lit(False))
    outside = F.when((F.col("tier") == PIPE) & ~inside, 1).otherwise(0)
    order = F.struct(outside.alias("outside"), miss.alias("miss"), F.length("text").alias("length"), F.col("item"))
    return pairs.select("anchor_id", "tier", "item", "text", "page", order.alias("order"))


def contained(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """(anchor_id, item) of every span of the anchor's document that holds the anchor as it stands."""
    spans = prepared(spans.select("doc_id", "item", "text", "page", "section", "kind"))
    named = candidates(anchors.filter("anchor <> ''").select("anchor_id", "doc_id", "anchor"), spans, full=False).withColumnRenamed("doc_id", "own")
    return named.join(spans, "span").filter((F.col("own") == F.col("doc_id")) & F.col("text").contains(F.col("anchor"))).select("anchor_id", "item")


def rebind(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (row_id, page, section, bbox) with the hit's values; a bbox is never replaced by NULL."""
    new = hits.select("row_id", *[F.col(c).alias(f"__{c}") for c in ("page", "section", "bbox")], F.lit(True).alias("__hit"))
    out = rows.join(new, "row_id", "left")
    out = out.withColumns({"page": F.when(F.col("__hit"), F.col("__page")).otherwise(F.col("page")), "section": F.when(F.col("__hit"), F.col("__section")).otherwise(F.col("section")), "bbox": F.coalesce("__bbox", "bbox"), "anchor_unresolved": F.col("__hit").isNull()})
    return out.drop("__page", "__section", "__bbox", "__hit")


def demote_unresolved(rows: DataFrame) -> DataFrame:
    """Accepted rows without an anchor become partial; the rationale is tagged once."""
    lost = F.col("anchor_unresolved") & (F.col("verifier_verdict") == "ok")
    tagged = F.when(text_of(F.col("rationale")).contains("anchor_unresolved"), F.col("rationale")).otherwise(F.concat_ws("; ", "rationale", F.lit("anchor_unresolved")))
    return rows.withColumns({"rationale": F.when(lost, tagged).otherwise(F.col("rationale")), "verifier_verdict": F.when(lost, "partial").otherwise(F.col("verifier_verdict"))})


def _resolved(old: DataFrame, hits: DataFrame) -> DataFrame:
    """Old rows with status: gain, lost, changed (a box moved by a point or more), unchanged or missed."""

    def box(c: str) -> Column:
        return F.transform(F.split(F.col(c), ","), lambda x: x.try_cast("double"))

    rows = old.join(hits.select("row_id", F.col("bbox").alias("__bbox"), F.lit(True).alias("__hit")), "row_id", "left")
    had, hit = text_of(F.col("bbox")).isin("", "null") == F.lit(False), F.col("__hit").isNotNull()
    moved = F.exists(F.zip_with(box("bbox"), box("__bbox"), lambda x, y: F.abs(x - y) >= 1.0), lambda x: F.coalesce(x, F.lit(False)))
    status = F.when(had & ~hit, "lost").when(had & F.coalesce(moved, F.lit(False)), "changed").when(had, "unchanged").when(hit, "gain").otherwise("missed")
    return rows.withColumn("status", status).drop("__bbox", "__hit")


def anchor_audit(old: DataFrame, hits: DataFrame) -> DataFrame:
    """Per table of old rows (row_id, table, bbox) against resolved hits (row_id, bbox): rows of each status, and
    preserved ones, which are those that had a box and still have a hit."""
    names = ("gain", "lost", "changed", "unchanged", "missed")
    counts = [F.count_if(F.col("status") == n).alias(f"n_{n}") for n in names]
    return _resolved(old, hits).groupBy("table").agg(*counts).withColumn("n_preserved", F.col("n_changed") + F.col("n_unchanged"))


def top_gains(old: DataFrame, hits: DataFrame, held_out: DataFrame, k: int = 15) -> DataFrame:
    """(paper, n_gain): the papers with most new anchors, without the held-out ones (column paper)."""
    won = _resolved(old, hits).filter("status = 'gain'").groupBy("paper").agg(F.count("*").alias("n_gain"))
    return won.join(held_out.select("paper"), "paper", "left_anti").orderBy(F.desc("n_gain"), "paper").limit(k)


TABLE_KEY = ("doc_id", "caption", "table")
BOX = ("x0", "y0", "x1", "y1")


def table_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, caption, table, row, c, x0, y0, x1, y1, page): c holds the row's cells (col, text) in order."""
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return cells.groupBy(*TABLE_KEY, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("c"), *box, F.min("page").alias("page"))


def row_union(cells: DataFrame) -> DataFrame:
    """(doc_id, caption, table, row, text, x0, y0, x1, y1, page) of cells of these and col."""
    return table_rows(cells).withColumn("text", F.array_join("c.text", " ")).drop("c")


def slabs(rows: DataFrame, most: int = 3) -> DataFrame:
    """Unions of 2 to ``most`` consecutive rows of a table: (doc_id, caption, table, row, n, text, box)."""
    order = Window.partitionBy(*TABLE_KEY).orderBy("row")
    parts = []
    for n in range(2, most + 1):
        ahead = [F.lead(F.struct("row", "text", *BOX), i).over(order) for i in range(1, n)]
        wide = rows.withColumns({f"r{i}": a for i, a in enumerate(ahead, 1)}).filter(F.col(f"r{n - 1}.row") == F.col("row") + n - 1)
        every = lambda c, n=n: [F.col(c), *[F.col(f"r{i}.{c}") for i in range(1, n)]]
        box = [(F.least if c in ("x0", "y0") else F.greatest)(*every(c)).alias(c) for c in BOX]
        parts.append(wide.select(*TABLE_KEY, "row", F.lit(n).alias("n"), F.concat_ws(" ", *every("text")).alias("text"), *box))
    return reduce(DataFrame.unionByName, parts)


CONTINUED = r"(?i)\s*\(?(continued|cont\.?|cont'd)\)?\s*$"


def strip_continued(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(c), CONTINUED, ""))


def _table_number(c: Column) -> Column:
    return F.upper(F.regexp_extract(text_of(c), r"(?i)table\s+([0-9ivx]+)", 1))


def caption_matches(a: Column, b: Column) -> Column:
    """Same table number; if neither names a table, equality or containment."""
    ta, tb = _table_number(a), _table_number(b)
    la, lb = F.lower(F.trim(text_of(a))), F.lower(F.trim(text_of(b)))
    loose = (la != "") & (lb != "") & ((la == lb) | la.contains(lb) | lb.contains(la))
    return F.when((ta != "") & (tb != ""), ta == tb).when((ta != "") | (tb != ""), F.lit(False)).otherwise(loose)


def cross_page_slabs(rows: DataFrame) -> DataFrame:
    """Pairs of the last row of a page and the first of the next under one caption: text of both, box of the first."""
    rows = rows.withColumn("canon", F.lower(strip_continued(F.col("caption"))))
    order = Window.partitionBy("doc_id", "canon").orderBy("page", "table", "row")
    wide = rows.withColumn("nxt", F.lead(F.struct("page", "text")).over(order)).filter(F.col("nxt.page") == F.col("page") + 1)
    return wide.select(*TABLE_KEY, "row", F.lit(2).alias("n"), F.concat_ws(" ", "text", "nxt.text").alias("text"), *BOX, "canon", "page")


def _in_scope(anchors: DataFrame, candidates: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Pairs of anchors (anchor_id, doc_id, anchor, anchor_caption) and candidates of their document: of the named
    caption (``caption_matches``, joined on the table's number, which both or neither must have); without a name only where all table rows of the document have one caption (never without rows)."""
    named = text_of(F.col("anchor_caption")) != ""
    own, other = F.lower(F.trim(text_of(F.col("anchor_caption")))), F.lower(F.trim(text_of(F.col("caption"))))
    asked, told = (x.withColumn("__tag", _table_number(F.col(c))) for x, c in ((anchors, "anchor_caption"), (candidates, "caption")))
    loose = (own != "") & (other != "") & ((own == other) | own.contains(other) | other.contains(own))
    pairs = asked.filter(named).join(told, ["doc_id", "__tag"]).filter((F.col("__tag") != "") | loose).drop("__tag")
    if rows is None:
        return pairs
    one = rows.groupBy("doc_id").agg(F.countDistinct(F.lower(strip_continued(F.col("caption")))).alias("n")).filter("n <= 1").select("doc_id")
    return pairs.unionByName(anchors.filter(~named).join(one, "doc_id", "left_semi").join(candidates, "doc_id"))


def _slab_hits(anchors: DataFrame, wide: DataFrame, rows: DataFrame) -> DataFrame:
    pairs = _in_scope(anchors, wide, rows).withColumns({"aw": words(F.col("anchor")), "sw": words(F.col("text"))})
    cover = F.size(F.array_intersect("aw", "sw")) / F.greatest(F.size("aw"), F.lit(1))
    needle = norm_anchor(F.col("anchor"))
    ok = (needle != "") & (norm_anchor(F.col("text")).contains(needle) | (cover >= 0.8))
    best = pairs.filter(ok).groupBy("anchor_id").agg(F.min(F.struct("n", "table", "row", *BOX)).alias("b"))
    return best.select("anchor_id", "b.*")


def slab_hits(anchors: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """(anchor_id, kind, n, table, row, box): the smallest union of consecutive rows, in the scope of the anchor's
    caption, that holds the anchor or 0.8 of its words; where there is none, such a union across two pages."""
    first = stage(_slab_hits(anchors, slabs(rows, most), rows), "first")
    rest = anchors.join(first.select("anchor_id"), "anchor_id", "left_anti")
    second = _slab_hits(rest, cross_page_slabs(rows).drop("canon", "page"), rows)
    return first.withColumn("kind", F.lit("rows")).unionByName(second.withColumn("kind", F.lit("pages")))


def numbers(c: Column) -> Column:
    plain = F.regexp_replace(text_of(c), r"(?<=\d),(?=\d{3})", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def fingerprint_hits(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor_id, table, row): the one row under the anchor's caption that holds all of its three or more numbers
    with the fewest others."""
    a, r = anchors.withColumn("an", numbers(F.col("anchor"))).filter(F.size("an") >= 3), rows.withColumn("rn", numbers(F.col("text")))
    held = _in_scope(a, r).filter(F.size(F.array_except("an", "rn")) == 0).withColumn("extra", F.size(F.array_except("rn", "an")))
    per = held.groupBy("anchor_id", "extra").agg(F.count("*").alias("n"), F.min(F.struct("table", "row")).alias("at"))
    best = per.groupBy("anchor_id").agg(F.min(F.struct("extra", "n", "at")).alias("b"))
    return best.filter("b.n = 1").select("anchor_id", "b.at.*")


def screen_box(rows: DataFrame, height: float = 792.0) -> DataFrame:
    """Boxes (l, t, r, b, coord_origin) as x0, y0, x1, y1 from the top left."""
    flip = F.upper(text_of(F.col("coord_origin"))) == "BOTTOMLEFT"
    h = F.coalesce("page_height", F.lit(height))
    top, bottom = F.when(flip, h - F.col("t")).otherwise(F.col("t")), F.when(flip, h - F.col("b")).otherwise(F.col("b"))
    return rows.withColumns({"x0": F.col("l"), "y0": F.least(top, bottom), "x1": F.col("r"), "y1": F.greatest(top, bottom)})


def verbatim_gate(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds reason: NULL if the anchor, white space collapsed, is in the document's text."""
    own = documents.select("doc_id", F.regexp_replace(text_of(F.col("text")), r"\s+", " ").alias("__t"))
    needle = F.trim(F.regexp_replace(text_of(F.col("anchor")), r"\s+", " "))
    reason = F.when(needle == "", "empty anchor").when(F.col("__t").isNull(), "unknown document").when(~F.col("__t").contains(needle), "not verbatim")
    return anchors.join(own, "doc_id", "left").withColumn("reason", reason).drop("__t")
