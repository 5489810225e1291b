"""Span tables of parsed documents: slices of the text, table cells, and whole table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.anchors import BOX, table_rows

#: Code points of one piece of a text; slices are cut from pieces, so a long text is many rows.
PIECE = 4096


def slices(documents: DataFrame, offsets: DataFrame) -> DataFrame:
    """Offsets (doc_id, item, start, end, ...) with ``text``, that part of the document's full_text.

    Texts are cut into pieces of PIECE code points and meet the offsets on document and piece; a slice over a seam is
    put together again. Offsets beyond the text are cut off, empty and reversed ones give no row.
    """
    part = F.regexp_extract_all("full_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = documents.select("doc_id", F.posexplode(part).alias("piece", "part"))
    first, last = (F.floor(F.greatest(F.col(c), F.lit(0)) / PIECE).cast("int") for c in ("start", "__last"))
    spread = offsets.withColumn("__last", F.col("end") - 1).filter("start < end and end > 0").withColumn("piece", F.explode(F.sequence(first, last))).drop("__last")
    met = spread.join(pieces, ["doc_id", "piece"])
    begin = F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0))
    cut = F.substring("part", (begin + 1).cast("int"), (F.col("end") - F.col("piece") * PIECE - begin).cast("int"))
    parts = met.withColumn("cut", cut).groupBy(*offsets.columns).agg(F.sort_array(F.collect_list(F.struct("piece", "cut"))).alias("p"))
    return parts.withColumn("text", F.array_join("p.cut", "")).drop("p").filter("text <> ''")


def build_spans(documents: DataFrame, offsets: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, item, text, page, section, kind, x0, y0, x1, y1).

    documents are (doc_id, full_text); offsets (doc_id, item, start, end, page, section, kind, box); cells (doc_id,
    caption, table, row, col, text, page, box). A cell has the page and box of its row and the caption as section;
    every row gives a span of its cells' texts too. ``item`` tells spans of a document apart and orders them: offsets
    keep theirs, cells follow by table (a number below 2^30), row (2^20) and column (1,023), each row after its cells.
    """
    out = ["doc_id", "item", "text", "page", "section", "kind", *BOX]
    body = slices(documents, offsets).withColumn("kind", F.coalesce("kind", F.lit("body")))
    rows = table_rows(cells.filter(F.coalesce("text", F.lit("")) != "")).withColumn("section", F.col("caption"))
    place = lambda col: F.lit(1 << 60) + F.col("table") * (1 << 30) + F.col("row") * (1 << 10) + col
    each = rows.withColumn("cell", F.explode("c"))
    cell_spans = each.withColumns({"text": F.col("cell.text"), "kind": F.lit("table_cell"), "item": place(F.col("cell.col"))})
    row_spans = rows.withColumns({"text": F.array_join("c.text", " "), "kind": F.lit("table_row"), "item": place(F.lit(1023))}).filter(F.trim("text") != "")
    typed = [F.col(c).cast("double").alias(c) if c in BOX else F.col(c).cast("long").alias(c) if c == "item" else F.col(c) for c in out]
    return body.select(*typed).unionByName(cell_spans.select(*typed)).unionByName(row_spans.select(*typed))
