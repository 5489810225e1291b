"""Spans of the documents, anchors bound to them, and numeric verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.effects import with_effect_fields
from attesta.operators import anchors, ingest, search, verify
from attesta.operators.spans import build_spans
from attesta.plans.evidence import EV, evidence
from attesta.plans.ingestion import PARSED
from attesta.plans.registry import query
from attesta.sources.adapters import COHORTS, MODELS, view
from attesta.sources.staging import stage

ITEMS = "(SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS item, unnest(string_split(text, chr(10))) AS text FROM documents)"


def items(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("item", "text"))


_T = f"(SELECT doc_id, item, trim(text) AS text FROM {ITEMS} WHERE trim(text) <> '')"
_OFF = f"(SELECT doc_id, item, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, last_value(CASE WHEN length(text) < 40 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {_T})"


@query("s14_text_offsets", f'SELECT doc_id, item, start, start + length(text) AS "end", section FROM {_OFF}')
def _(spark, d):
    return ingest.text_offsets(items(spark, d)).select("doc_id", "item", "start", "end", "section")


@query("w07_section_texts", f"SELECT doc_id, section, string_agg(text, chr(10) ORDER BY item) AS text FROM {_OFF} GROUP BY ALL")
def _(spark, d):
    return ingest.section_texts(ingest.text_offsets(items(spark, d)))


_LAB = "CASE WHEN item = 0 AND doc_id % 5 = 0 THEN 'title' WHEN item < 3 THEN 'section_header' ELSE 'text' END"
_UP = "CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.75 * greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1) AND NOT contains(text, ' ') THEN true ELSE false END"


@query("s15_pick_title", f"""WITH i AS (SELECT doc_id, item, text, {_LAB} AS label FROM {ITEMS}),
a AS (SELECT doc_id, arg_min(text, item) AS t FROM i WHERE label = 'title' AND trim(text) <> '' GROUP BY 1),
b AS (SELECT doc_id, arg_max(text, (length(text), text)) AS t FROM i WHERE label = 'section_header' AND length(text) >= 15 AND regexp_matches(text, '[A-Za-z]') AND NOT {_UP} AND lower(text) NOT IN ('original article', 'research article', 'open access') GROUP BY 1)
SELECT d.doc_id, coalesce(a.t, b.t, concat('document-', d.doc_id)) AS title FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def _(spark, d):
    label = F.when((F.col("item") == 0) & (F.col("doc_id") % 5 == 0), "title").when(F.col("item") < 3, "section_header").otherwise("text")
    return ingest.pick_title(items(spark, d).withColumns({"page": F.lit(1), "label": label}))


#: Every line of an order is a table row of the document that the order's part of the corpus has; two tables or more a document.
_OF = "l_orderkey % (SELECT count(*) FROM documents)"
_CELLS = f"SELECT {_OF} AS doc_id, l_orderkey AS \"table\", l_linenumber * 1000000 + l_partkey AS row, unnest([0, 1, 2]) AS col, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)]) AS text FROM lineitem"


@query("s16_grounding_context", f"""WITH c AS ({_CELLS}), r AS (SELECT doc_id, "table", row, string_agg(text, ' | ' ORDER BY col, text) AS line FROM c GROUP BY ALL),
t AS (SELECT doc_id, "table", string_agg(line, chr(10) ORDER BY row, line) AS lines FROM r GROUP BY 1, 2), u AS (SELECT doc_id, string_agg(lines, chr(10) || chr(10) ORDER BY "table") AS tables FROM t GROUP BY 1)
SELECT doc_id, substr(concat_ws(chr(10) || chr(10), concat('TITLE: Document ', doc_id), text, tables), 1, 150000) AS context FROM documents LEFT JOIN u USING (doc_id)""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.agg(F.count("*").alias("n"))  # one row
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(F.broadcast(n), F.lit(True))
    texts = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    cells = lines.select((F.col("l_orderkey") % F.col("n")).alias("doc_id"), F.col("l_orderkey").alias("table"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("row"), F.posexplode(texts).alias("col", "text"))
    titles = docs.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    return ingest.grounding_context(titles, docs.select("doc_id", F.col("text").alias("body")), cells)


_UPPER = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_VAR = f"""CASE item % 6 WHEN 0 THEN substr(text, 5, 45) WHEN 1 THEN translate(substr(text, 3, 50), {_UPPER}) WHEN 2 THEN replace(substr(text, 1, 40), ' ', '')
 WHEN 3 THEN CASE item % 18 WHEN 3 THEN concat('Heart rate | ', CAST(item AS VARCHAR(9))) WHEN 9 THEN concat('SPECIFIED | ', CAST(item AS VARCHAR(9)), ' | 7') ELSE concat(substr(text, 1, 25), ' | nothing') END
 WHEN 4 THEN CASE WHEN item % 12 = 4 THEN concat('Heart rate ', CAST(item AS VARCHAR(9)), ' of 90') ELSE concat('zzz ', substr(text, 1, 200)) END
 ELSE concat(substr(text, 1, 70), ' qqq www') END"""
_ANCH = f"""(SELECT concat(CAST(doc_id AS VARCHAR(20)), '-', CAST(item AS VARCHAR(20))) AS anchor_id, doc_id, {_VAR} AS anchor,
 CASE WHEN item % 4 = 0 THEN concat('S', CAST(item % 3 AS VARCHAR(4))) END AS anchor_section FROM {ITEMS})"""

#: Offsets: the lines of a document in its text. Cells: a heart rate in each document (in every third one on two pages),
#: and the orders of the corpus as rows of the documents' tables.
_OFFSETS = f"""(SELECT doc_id, item, start, start + n AS "end", CAST(1 + floor(item / 5) AS INT) AS page, concat('s', CAST(item % 3 AS VARCHAR(4))) AS section,
 CASE WHEN n < 40 THEN 'heading' END AS kind, text FROM (SELECT doc_id, item, length(text) AS n, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {ITEMS}))"""
_DOC = "(SELECT count(*) FROM documents)"
_TABLE_CELLS = f"""(SELECT doc_id, 's1' AS caption, 0 AS tab, r, unnest([0, 1, 2]) AS col, unnest(['Heart rate', CAST(doc_id % 200 AS VARCHAR), '90']) AS text, 3 + 2 * r AS page, 5 * r AS y FROM (SELECT doc_id, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) AS r FROM documents)
 UNION ALL SELECT o_orderkey % {_DOC}, concat('Table ', CAST(o_orderkey % 7 AS VARCHAR(9))), o_orderkey, 0, unnest([0, 1, 2]), unnest([o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, CAST(o_custkey AS VARCHAR)]), CAST(o_orderkey % 11 AS INT), 0 FROM orders)"""
_PLACE = "1152921504606846976 + tab * 1073741824 + r * 1024"
_FILLED = f"(SELECT * FROM {_TABLE_CELLS} WHERE text <> '')"
_SPAN = f"""(SELECT doc_id, CAST(item AS BIGINT) AS item, text, page, section, coalesce(kind, 'body') AS kind, CAST(NULL AS DOUBLE) AS y1 FROM {_OFFSETS} WHERE text <> ''
 UNION ALL SELECT doc_id, {_PLACE} + col, text, page, caption, 'table_cell', CAST(y + 4 AS DOUBLE) FROM {_FILLED}
 UNION ALL SELECT doc_id, {_PLACE} + 1023, string_agg(text, ' ' ORDER BY col), min(page), caption, 'table_row', CAST(max(y + 4) AS DOUBLE) FROM {_FILLED} GROUP BY doc_id, caption, tab, r)"""


def _offsets(spark, d) -> DataFrame:
    rows = items(spark, d).withColumn("n", F.length("text"))
    before = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))
    rows = rows.select("doc_id", "item", start.alias("start"), (start + F.col("n")).alias("end"), (F.floor(F.col("item") / 5) + 1).cast("int").alias("page"), F.concat(F.lit("s"), (F.col("item") % 3).cast("string")).alias("section"), F.when(F.col("n") < 40, "heading").alias("kind"))
    return rows.withColumns({c: F.lit(None).cast("double") for c in anchors.BOX})


def _table_cells(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))  # one row
    own = docs.select("doc_id", F.lit("s1").alias("caption"), F.lit(0).cast("long").alias("table"), F.explode(F.sequence(F.lit(0), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))).alias("row"), F.array(F.lit("Heart rate"), (F.col("doc_id") % 200).cast("string"), F.lit("90")).alias("texts"))
    own = own.withColumns({"page": F.col("row") * 2 + 3, "y0": F.col("row") * 5})
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").join(F.broadcast(n), F.lit(True)).select((key % F.col("n")).alias("doc_id"), F.concat(F.lit("Table "), (key % 7).cast("string")).alias("caption"), key.alias("table"), F.lit(0).alias("row"), F.array("o_orderpriority", status, F.col("o_custkey").cast("string")).alias("texts"), (key % 11).cast("int").alias("page"), F.lit(0).alias("y0"))
    rows = own.unionByName(orders).select("*", F.posexplode("texts").alias("col", "text")).drop("texts")
    return rows.withColumns({"x0": F.col("col") * 10, "x1": F.col("col") * 10 + 8, "y1": F.col("y0") + 4})


def spans(spark, d) -> DataFrame:
    """Lines of the documents by their offsets, table cells and table rows."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("full_text"))
    return build_spans(docs, _offsets(spark, d), _table_cells(spark, d))


def anchored(spark, d) -> DataFrame:
    return items(spark, d).select(F.concat_ws("-", "doc_id", "item").alias("anchor_id"), "doc_id", F.expr(_VAR).alias("anchor"), F.expr("CASE WHEN item % 4 = 0 THEN concat('S', CAST(item % 3 AS STRING)) END").alias("anchor_section"))


def _n(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def _w(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


_JAC = "len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"
_RESOLVED = f"""(WITH a AS (SELECT *, {_n('anchor')} AS an, replace({_n('anchor')}, ' ', '') AS ap, {_w('anchor')} AS aw FROM {_ANCH}),
s AS (SELECT *, {_n('text')} AS tn, replace({_n('text')}, ' ', '') AS tp, {_w('text')} AS tw FROM {_SPAN}),
p AS (SELECT anchor_id, anchor_section, an, item, text, page, section, kind, tn, CASE WHEN contains(text, anchor) THEN 1 WHEN an <> '' AND contains(tn, an) THEN 2 WHEN length(ap) >= 12 AND contains(tp, ap) THEN 3
 WHEN contains(anchor, '|') AND length(trim(split_part(an, '|', 1))) >= 6 AND contains(tn, trim(split_part(an, '|', 1))) THEN 4 WHEN length(anchor) >= 30 AND {_JAC.format(a='aw', b='tw')} >= 0.85 THEN 5
 WHEN length(anchor) >= 60 AND contains(tn, substr(an, 1, 60)) THEN 6 WHEN regexp_extract(an, '^([a-z][a-z \\-]{{3,}}?)\\s*\\d', 1) <> '' AND kind = 'table_cell' AND tn = regexp_extract(an, '^([a-z][a-z \\-]{{3,}}?)\\s*\\d', 1) THEN 7 END AS tier FROM a JOIN s USING (doc_id) WHERE anchor <> ''),
g AS (SELECT *, count(*) OVER (PARTITION BY anchor_id, tier) AS n, count(DISTINCT page) OVER (PARTITION BY anchor_id, tier) AS pages FROM p WHERE tier IS NOT NULL)
SELECT anchor_id, tier, item, page FROM g WHERE NOT (tier = 6 AND n > 1) AND NOT (tier = 7 AND pages > 1)
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY tier, CASE WHEN tier = 4 AND NOT contains(an, tn) AND kind <> 'table_cell' THEN 1 ELSE 0 END, CASE WHEN anchor_section IS NOT NULL AND lower(anchor_section) = lower(section) THEN 0 ELSE 1 END, length(text), item) = 1)"""


@query("t00_build_spans", f"SELECT doc_id, item, page, section, kind, y1, md5(text) AS text_md5 FROM {_SPAN}")
def _(spark, d):
    return spans(spark, d).select("doc_id", "item", "page", "section", "kind", "y1", F.md5("text").alias("text_md5"))


@query("t10_resolve_anchors", f"SELECT * FROM {_RESOLVED}")
def _(spark, d):
    return anchors.resolve(anchored(spark, d), spans(spark, d), keep=("item", "page"))


for _name, _tier in (("t01_exact", 1), ("t02_normalised", 2), ("t03_packed", 3), ("t04_pipe_probe", 4), ("t05_token_jaccard", 5), ("t06_unique_head", 6), ("t07_leading_label", 7)):

    @query(_name, f"SELECT anchor_id, item FROM {_RESOLVED} WHERE tier = {_tier}")
    def _(spark, d, tier=_tier):
        return anchors.resolve(anchored(spark, d), spans(spark, d), last=tier, keep=("item",)).filter(F.col("tier") == tier).select("anchor_id", "item")


@query("j09_anchor_containment", f"SELECT anchor_id, s.item FROM {_ANCH} a JOIN {_SPAN} s ON s.doc_id = a.doc_id AND a.anchor <> '' AND contains(s.text, a.anchor)")
def _(spark, d):
    return anchors.contained(anchored(spark, d), spans(spark, d))


@query("t12_verbatim_gate", f"SELECT anchor_id, CASE WHEN trim(regexp_replace(anchor, '\\s+', ' ', 'g')) = '' THEN 'empty anchor' WHEN NOT contains(regexp_replace(text, '\\s+', ' ', 'g'), trim(regexp_replace(anchor, '\\s+', ' ', 'g'))) THEN 'not verbatim' END AS reason FROM {_ANCH} a JOIN documents d USING (doc_id)")
def _(spark, d):
    return anchors.verbatim_gate(anchored(spark, d), spark.read.parquet(f"{d}/documents.parquet")).select("anchor_id", "reason")


_OLD = f"SELECT row_id, CASE WHEN anchor_page % 4 = 0 THEN NULL ELSE anchor_page END AS page, anchor_section AS section, CASE WHEN anchor_page % 2 = 0 THEN '1,2,3,4' END AS bbox, coalesce(verifier_verdict, 'ok') AS verifier_verdict, CASE WHEN anchor_page = 5 THEN 'anchor_unresolved' END AS rationale FROM ({MODELS})"
_HIT = f"SELECT row_id, 1 + anchor_page % 3 AS page, 'Found' AS section, CASE WHEN anchor_page > 4 THEN '9,9,9,9' END AS bbox FROM ({MODELS}) WHERE anchor_page <> 3 AND anchor_page <> 5"
_BOUND = f"(SELECT o.row_id, CASE WHEN h.row_id IS NOT NULL THEN h.page ELSE o.page END AS page, CASE WHEN h.row_id IS NOT NULL THEN h.section ELSE o.section END AS section, coalesce(h.bbox, o.bbox) AS bbox, h.row_id IS NULL AS anchor_unresolved, verifier_verdict, rationale FROM ({_OLD}) o LEFT JOIN ({_HIT}) h ON h.row_id = o.row_id)"


def _bound(spark, d):
    return anchors.rebind(view(spark, d, _OLD), view(spark, d, _HIT))


@query("t11_rebind", f"SELECT row_id, page, section, bbox, anchor_unresolved FROM {_BOUND}")
def _(spark, d):
    return _bound(spark, d).select("row_id", "page", "section", "bbox", "anchor_unresolved")


_LOST = "(anchor_unresolved AND verifier_verdict = 'ok')"


@query("p18_demote_unresolved", f"SELECT row_id, CASE WHEN {_LOST} THEN 'partial' ELSE verifier_verdict END AS verifier_verdict, CASE WHEN {_LOST} THEN 'anchor_unresolved' ELSE rationale END AS rationale FROM {_BOUND}")
def _(spark, d):
    return anchors.demote_unresolved(_bound(spark, d)).select("row_id", "verifier_verdict", "rationale")


_AUDITED = f"SELECT row_id, CASE WHEN outcome_type = 'los' THEN 'secondary' ELSE 'primary' END AS \"table\", coalesce(paper_ref, 'none') AS paper, CASE WHEN anchor_page % 4 = 0 THEN NULL ELSE anchor_bbox END AS bbox FROM {EV}"
_FOUND = f"SELECT row_id, CASE WHEN anchor_page > 6 THEN concat('9', anchor_bbox) ELSE coalesce(anchor_bbox, '1,2,3,4') END AS bbox FROM {EV} WHERE anchor_page <> 3"
_STATUS = f"(SELECT o.*, CASE WHEN o.bbox IS NOT NULL AND h.row_id IS NULL THEN 'lost' WHEN o.bbox IS NOT NULL AND o.bbox <> h.bbox THEN 'changed' WHEN o.bbox IS NOT NULL THEN 'unchanged' WHEN h.row_id IS NOT NULL THEN 'gain' ELSE 'missed' END AS status FROM ({_AUDITED}) o LEFT JOIN ({_FOUND}) h ON h.row_id = o.row_id)"


def _audit(spark, d):
    rows = evidence(spark, d)
    return rows.selectExpr("row_id", "CASE WHEN outcome_type = 'los' THEN 'secondary' ELSE 'primary' END AS table", "coalesce(paper_ref, 'none') AS paper", "CASE WHEN anchor_page % 4 = 0 THEN NULL ELSE anchor_bbox END AS bbox"), rows.filter("anchor_page <> 3").selectExpr("row_id", "CASE WHEN anchor_page > 6 THEN concat('9', anchor_bbox) ELSE coalesce(anchor_bbox, '1,2,3,4') END AS bbox")


@query("a17_anchor_audit", "SELECT \"table\", " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("gain", "lost", "changed", "unchanged", "missed")) + f", count(*) FILTER (status IN ('changed', 'unchanged')) AS n_preserved FROM {_STATUS} GROUP BY 1")
def _(spark, d):
    return anchors.anchor_audit(*_audit(spark, d))


@query("a17_top_gains", f"SELECT paper, count(*) AS n_gain FROM {_STATUS} WHERE status = 'gain' AND paper NOT LIKE '%1' GROUP BY 1 ORDER BY n_gain DESC, paper LIMIT 15")
def _(spark, d):
    old, hits = _audit(spark, d)
    return anchors.top_gains(old, hits, old.filter("paper like '%1'").select("paper").distinct())


#: Tables: four orders a document, one caption each, of which every second one continues that before; two lines a page.
_CELL = """SELECT l_orderkey // 16 AS doc_id, l_orderkey AS tab, concat('Table ', CAST((l_orderkey // 2) % 8 AS VARCHAR(4)), CASE WHEN l_orderkey % 2 = 1 THEN ' (continued)' ELSE '' END) AS caption,
 CAST((l_orderkey % 16) * 4 + l_linenumber // 2 AS INT) AS page, l_linenumber AS r, min(l_partkey) AS k, min(l_suppkey) AS s, min(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_ROWS = f"(SELECT doc_id, caption, tab AS \"table\", r AS row, concat_ws(' ', k, s, q) AS text, 0 AS x0, r * 5 AS y0, 28 AS x1, r * 5 + 4 AS y1, page FROM ({_CELL}))"
_TEXT2, _TEXT3 = "concat_ws(' ', a.text, b.text)", "concat_ws(' ', a.text, b.text, c.text)"
_ON = "{0}.\"table\" = a.\"table\" AND {0}.row = a.row + {1}"
_SLABS = f"(SELECT a.doc_id, a.caption, a.\"table\", a.row, 2 AS n, {_TEXT2} AS text, a.y0, b.y1 FROM {_ROWS} a JOIN {_ROWS} b ON {_ON.format('b', 1)} UNION ALL SELECT a.doc_id, a.caption, a.\"table\", a.row, 3, {_TEXT3}, a.y0, c.y1 FROM {_ROWS} a JOIN {_ROWS} b ON {_ON.format('b', 1)} JOIN {_ROWS} c ON {_ON.format('c', 2)})"
_CANON = "lower(replace(caption, ' (continued)', ''))"
_ACROSS = f"(SELECT doc_id, caption, \"table\", row, 2 AS n, concat_ws(' ', text, lead(text) OVER w) AS text, {_CANON} AS canon, page, lead(page) OVER w AS np FROM {_ROWS} WINDOW w AS (PARTITION BY doc_id, {_CANON} ORDER BY page, \"table\", row))"


def _rows(spark, d) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    key = F.col("l_orderkey")
    caption = F.concat(F.lit("Table "), (F.floor(key / 2) % 8).cast("string"), F.when(key % 2 == 1, " (continued)").otherwise(""))
    page = ((key % 16) * 4 + F.floor(F.col("row") / 2)).cast("int")
    cells = lines.select(F.floor(key / 16).alias("doc_id"), caption.alias("caption"), key.alias("table"), "row", page.alias("page"), F.posexplode(F.array("k", "s", F.col("q").cast("long"))).alias("col", "v"))
    box = {"x0": F.col("col") * 10, "y0": F.col("row") * 5, "x1": F.col("col") * 10 + 8, "y1": F.col("row") * 5 + 4}
    return anchors.row_union(cells.withColumn("text", F.col("v").cast("string")).withColumns(box).drop("v"))


@query("w06_table_row_union", f"SELECT * FROM {_ROWS}")
def _(spark, d):
    return _rows(spark, d)


@query("w03_row_slabs", f"SELECT * FROM {_SLABS}")
def _(spark, d):
    return anchors.slabs(_rows(spark, d)).select("doc_id", "caption", "table", "row", "n", "text", "y0", "y1")


@query("w04_cross_page_slabs", f"SELECT doc_id, canon, page, \"table\", row, text FROM {_ACROSS} WHERE np = page + 1")
def _(spark, d):
    return anchors.cross_page_slabs(_rows(spark, d)).select("doc_id", "canon", "page", "table", "row", "text")


#: Anchors: a pair of rows shuffled, a pair across two pages, three rows, a row of another caption, and no caption.
_KIND = "CASE {t} % 5 WHEN 0 THEN concat_ws(' ', b.text, a.text) WHEN 1 THEN concat_ws(' ', a.text, b.text, c.text) ELSE concat_ws(' ', a.text, b.text) END"
_WANTED = f"(SELECT concat('a', a.\"table\", '-', a.row) AS anchor_id, a.doc_id, {_KIND.format(t='a.' + chr(34) + 'table' + chr(34))} AS anchor, CASE a.\"table\" % 7 WHEN 3 THEN 'Table 99' WHEN 4 THEN NULL ELSE a.caption END AS anchor_caption FROM {_ROWS} a JOIN {_ROWS} b ON b.doc_id = a.doc_id AND ((b.\"table\" = a.\"table\" AND b.row = a.row + 1) OR (b.\"table\" = a.\"table\" + 1 AND a.\"table\" % 2 = 0 AND b.row = 1 AND b.page = a.page + 1)) LEFT JOIN {_ROWS} c ON c.\"table\" = a.\"table\" AND c.row = a.row + 2 WHERE a.row % 2 = 1)"
_TAG = "regexp_extract({}, 'Table (\\d+)', 1)"
_SCOPE = f"CASE WHEN a.anchor_caption IS NOT NULL THEN {_TAG.format('a.anchor_caption')} = {_TAG.format('s.caption')} ELSE a.doc_id IN (SELECT doc_id FROM {_ROWS} GROUP BY 1 HAVING count(DISTINCT {_CANON}) <= 1) END"


def _held(a: str, s: str) -> str:
    return f"(contains({s}, {a}) OR len(list_intersect({_w(a)}, {_w(s)})) >= 0.8 * len({_w(a)}))"


_FIRST = f"(SELECT anchor_id, min((n, s.\"table\", s.row)) AS b FROM {_WANTED} a JOIN {_SLABS} s ON s.doc_id = a.doc_id AND {_SCOPE} AND {_held('a.anchor', 's.text')} GROUP BY 1)"
_SECOND = f"(SELECT anchor_id, min((n, s.\"table\", s.row)) AS b FROM {_WANTED} a JOIN (SELECT * FROM {_ACROSS} WHERE np = page + 1) s ON s.doc_id = a.doc_id AND {_SCOPE} AND {_held('a.anchor', 's.text')} WHERE anchor_id NOT IN (SELECT anchor_id FROM {_FIRST}) GROUP BY 1)"


def _wanted(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", "caption", "table", "row", "text", "page")
    a, b, c = (rows.select(*[F.col(x).alias(f"{n}_{x}") for x in rows.columns]) for n in "abc")
    near = ((F.col("b_table") == F.col("a_table")) & (F.col("b_row") == F.col("a_row") + 1)) | ((F.col("b_table") == F.col("a_table") + 1) & (F.col("a_table") % 2 == 0) & (F.col("b_row") == 1) & (F.col("b_page") == F.col("a_page") + 1))
    pairs = a.filter("a_row % 2 = 1").join(b, (F.col("a_doc_id") == F.col("b_doc_id")) & near).join(c, (F.col("c_table") == F.col("a_table")) & (F.col("c_row") == F.col("a_row") + 2), "left")
    kind = F.when(F.col("a_table") % 5 == 0, F.concat_ws(" ", "b_text", "a_text")).when(F.col("a_table") % 5 == 1, F.concat_ws(" ", "a_text", "b_text", "c_text")).otherwise(F.concat_ws(" ", "a_text", "b_text"))
    caption = F.when(F.col("a_table") % 7 == 3, "Table 99").when(F.col("a_table") % 7 != 4, F.col("a_caption"))
    return pairs.select(F.concat(F.lit("a"), F.col("a_table").cast("string"), F.lit("-"), F.col("a_row").cast("string")).alias("anchor_id"), F.col("a_doc_id").alias("doc_id"), kind.alias("anchor"), caption.alias("anchor_caption"))


@query("t08_slab_anchor", f"SELECT anchor_id, kind, b[1] AS n, b[2] AS \"table\", b[3] AS row FROM (SELECT *, 'rows' AS kind FROM {_FIRST} UNION ALL SELECT *, 'pages' FROM {_SECOND})")
def _(spark, d):
    rows = stage(_rows(spark, d), "rows")  # rows, anchors and slabs are made of them
    return anchors.slab_hits(stage(_wanted(rows), "wanted"), rows).select("anchor_id", "kind", "n", "table", "row")


_NUMS = "list_distinct(regexp_extract_all({}, '\\d+(?:\\.\\d+)?'))"
_SINGLE = f"(SELECT concat('a', \"table\") AS anchor_id, doc_id, CASE WHEN \"table\" % 3 = 0 THEN concat('of ', arg_max(text, row), ' x') ELSE arg_max(text, row) END AS anchor, CASE WHEN \"table\" % 7 <> 4 THEN max(caption) END AS anchor_caption FROM {_ROWS} GROUP BY doc_id, \"table\")"


@query("t09_numeric_fingerprint", f"""WITH r AS (SELECT *, {_NUMS.format('text')} AS rn FROM {_ROWS}), a AS (SELECT *, {_NUMS.format('anchor')} AS an FROM {_SINGLE}),
h AS (SELECT anchor_id, "table", row, len(rn) - len(an) AS extra FROM a JOIN r ON r.doc_id = a.doc_id AND {_TAG.format('anchor_caption')} = {_TAG.format('caption')} WHERE len(an) >= 3 AND len(list_intersect(an, rn)) = len(an)),
m AS (SELECT *, min(extra) OVER (PARTITION BY anchor_id) AS least FROM h)
SELECT anchor_id, min("table") AS "table", min(row) AS row FROM m WHERE extra = least GROUP BY 1 HAVING count(*) = 1""")
def _(spark, d):
    rows = stage(_rows(spark, d), "rows")
    own = rows.groupBy("doc_id", "table").agg(F.max_by("text", "row").alias("last"), F.max("caption").alias("c"))
    anchor = F.when(F.col("table") % 3 == 0, F.concat(F.lit("of "), "last", F.lit(" x"))).otherwise(F.col("last"))
    own = own.select(F.concat(F.lit("a"), F.col("table").cast("string")).alias("anchor_id"), "doc_id", anchor.alias("anchor"), F.when(F.col("table") % 7 != 4, F.col("c")).alias("anchor_caption"))
    return anchors.fingerprint_hits(own, rows)


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 500 AS DOUBLE) AS l, CAST(l_suppkey % 700 AS DOUBLE) AS t, CAST(l_partkey % 500 + 9 AS DOUBLE) AS r, CAST(l_suppkey % 700 + 5 AS DOUBLE) AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END AS coord_origin, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(800 AS DOUBLE) END AS page_height FROM {lineitem}"


@query("f26_screen_box", f"SELECT l_orderkey, l_linenumber, l_partkey, l AS x0, CASE WHEN coord_origin = 'BOTTOMLEFT' THEN coalesce(page_height, 792) - b ELSE t END AS y0, CASE WHEN coord_origin = 'BOTTOMLEFT' THEN coalesce(page_height, 792) - t ELSE b END AS y1 FROM ({_BOX})")
def _(spark, d):
    return anchors.screen_box(view(spark, d, _BOX)).select("l_orderkey", "l_linenumber", "l_partkey", "x0", "y0", "y1")


def claims(spark, d) -> DataFrame:
    rows = evidence(spark, d)
    return with_effect_fields(rows).withColumns({"span": F.concat_ws(" ", "effect_size_str", "anchor_text"), "anchor_unresolved": F.col("anchor_section").isNull(), "cross_check": F.col("cohort_size_n").isNotNull()})


_GIVEN = ("effect_value", "ci_lo", "ci_hi", "p_value", "auc", "auc_ci_lo", "auc_ci_hi", "sens", "spec", "ppv", "npv", "c_index")
_ABSENT = ("auc_ci_lo", "auc_ci_hi", "sens", "spec", "ppv", "npv")
_SEEN = "list_transform(regexp_extract_all(regexp_replace(concat_ws(' ', effect_size_str, anchor_text), '(\\d),(\\d{3})', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE))"


def _near(v: str, percent: bool = False) -> str:
    one = [f"len(list_filter(seen, lambda x: abs(x - {w}) < 1e-3)) > 0" for w in ([v, f"{v} * 100", f"{v} / 100"] if percent else [v])]
    return "(" + " OR ".join(one) + ")"


def _atom(f: str) -> str:
    told = f"p.{f}" if f in ("effect_value", "ci_lo", "ci_hi", "p_value", "auc", "auc_ci_lo", "auc_ci_hi", "sens", "spec") else "CAST(NULL AS DOUBLE)"
    v = f"coalesce(e.{f}, {told})" if f not in _ABSENT else told
    hit = _near(v, f in ("sens", "spec", "ppv", "npv", "auc"))
    return f"CASE WHEN {v} IS NOT NULL THEN concat('{f}=', CASE WHEN {hit} THEN 'matched' WHEN {told} <> 0 AND abs({told} - {v}) > 1e-3 THEN 'contradicted' ELSE 'absent' END) END"


_EXTRA = f"CASE WHEN size > 100 THEN concat('cohort_size=', CASE WHEN {_near('size')} THEN 'matched' ELSE 'absent' END) END, CASE WHEN mortality_rate_pct IS NOT NULL THEN concat('mortality=', CASE WHEN {_near('mortality_rate_pct')} THEN 'matched' ELSE 'absent' END) END"
_COHORT_SIZE = "coalesce(TRY_CAST(regexp_extract(replace(coalesce(cohort_size_n, ''), ',', ''), '\\d+') AS BIGINT), 0)"


_V1 = f"SELECT e.row_id, concat_ws(';', {', '.join(_atom(f) for f in _GIVEN)}, {_EXTRA}) AS atoms FROM (SELECT *, {_SEEN} AS seen, {_COHORT_SIZE} AS size FROM {EV}) e JOIN {PARSED} p ON p.row_id = e.row_id"


@query("v01_numeric_atoms", _V1)
def _(spark, d):
    rows = verify.atoms(claims(spark, d))
    return rows.select("row_id", F.array_join(F.transform("atoms", lambda a: F.concat_ws("=", a["field"], a["state"])), ";").alias("atoms"))


_AT = f"(SELECT row_id, list_filter(list_transform(string_split(atoms, ';'), lambda x: split_part(x, '=', 2)), lambda x: x <> '') AS l_state FROM ({_V1}))"


def _cnt(state: str) -> str:
    return f"len(list_filter(l_state, lambda x: x = '{state}'))"


@query("v02_verdicts", f"SELECT row_id, CASE WHEN c > 0 THEN 'reject' WHEN s + a = 0 THEN 'partial' WHEN (s + 0.5 * a) / (s + a) >= 0.7 THEN 'ok' ELSE 'partial' END AS verdict, round(CASE WHEN c > 0 THEN greatest(0, s / (s + c) - 0.2) WHEN s + a = 0 THEN 0.5 ELSE (s + 0.5 * a) / (s + a) END, 6) AS score FROM (SELECT row_id, {_cnt('matched')} AS s, {_cnt('contradicted')} AS c, {_cnt('absent')} AS a FROM {_AT})")
def _(spark, d):
    return verify.verdicts(verify.atoms(claims(spark, d))).select("row_id", "verdict", F.round("score", 6).alias("score"))


@query("v03_needs_judge", f"SELECT row_id, anchor_section IS NOT NULL AND {_cnt('contradicted')} = 0 AND NOT (len(l_state) > 0 AND {_cnt('matched')} = len(l_state) AND cohort_size_n IS NULL) AS needs_judge FROM {_AT} JOIN {EV} USING (row_id)")
def _(spark, d):
    rows = verify.atoms(claims(spark, d))
    return verify.needs_judge(rows).select("row_id", "needs_judge")


@query("v04_hypotheses", f"""SELECT row_id, concat_ws('~', concat(predictors, ' predicts ', CASE WHEN outcome_window_days IS NULL THEN '' WHEN outcome_window_days <= 2 THEN 'in-hospital ' ELSE concat(outcome_window_days, '-day ') END, outcome_type, '.'),
 'The study population is ' || population_description || '.', CASE WHEN population_location IS NOT NULL AND NOT contains(lower(coalesce(population_description, '')), lower(population_location)) THEN concat('The study was done in ', population_location, '.') END, 'The cohort has ' || cohort_size_n || ' patients.') AS hypotheses FROM {EV}""")
def _(spark, d):
    return verify.hypotheses(evidence(spark, d)).select("row_id", F.array_join("hypotheses", "~").alias("hypotheses"))


@query("j05_cohort_context", f"SELECT row_id, CASE WHEN anchor_page = 1 THEN 'own text' ELSE population_description END AS population_description, population_location FROM {EV}")
def _(spark, d):
    rows = view(spark, d, MODELS).withColumn("population_description", F.when(F.col("anchor_page") == 1, "own text"))
    return verify.cohort_context(rows, view(spark, d, COHORTS), ["population_description", "population_location"]).select("row_id", "population_description", "population_location")


@query("p17_reverify_selection", f"SELECT row_id FROM {EV} WHERE lower(paper_ref) LIKE '%nation_3 %' AND verifier_verdict IS NULL AND outcome_type <> 'los'")
def _(spark, d):
    rows = evidence(spark, d).withColumn("run_id", F.when(F.col("outcome_type") == "los", "r9").when(F.col("outcome_type") == "mortality", "r1"))
    return verify.reverify_selection(rows, "Nation_3 ", only_missing=True, run_id="r9").select("row_id")


@query("l08_vector_top_k", "SELECT vec_id, round(CAST(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS DOUBLE), 6) AS cosine FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return search.vector_top_k(rows, rows.filter("vec_id = 0")).withColumn("cosine", F.round("cosine", 6))


_BLANKS = "[ \\t\\n\\r\\f\\x{00A0}]"
_KEPT = f"list_filter(range(length(text)), lambda i: NOT regexp_matches(substr(text, CAST(i AS INTEGER) + 1, 1), '{_BLANKS}') OR (i > 0 AND NOT regexp_matches(substr(text, CAST(i AS INTEGER), 1), '{_BLANKS}')))"


@query("v05_phrase_search", f"""WITH b AS (SELECT doc_id, item, text, lower(regexp_replace(regexp_replace(text, '^{_BLANKS}+', ''), '{_BLANKS}+', ' ', 'g')) AS body FROM {ITEMS}),
n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY item) AS nxt FROM b WHERE body <> ''),
p AS (SELECT *, CASE WHEN text LIKE '%-' AND regexp_matches(nxt, '^[A-Za-z]') THEN left(body, -1) WHEN body LIKE '% ' THEN body ELSE concat(body, ' ') END AS piece FROM n),
s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
t AS (SELECT doc_id, string_split(string_agg(piece, '' ORDER BY item), 'of the') AS parts FROM p GROUP BY doc_id),
u AS (SELECT doc_id, unnest(range(1, len(parts))) AS k, parts FROM t),
h AS (SELECT doc_id, k, 6 * (k - 1) + list_sum(list_transform(parts[1:k], lambda x: length(x))) AS at FROM u),
e AS (SELECT h.doc_id, h.k, h.at, s.item, ({_KEPT})[CAST(h.at - s.start AS INTEGER) + 1] AS start_offset FROM h JOIN s ON s.doc_id = h.doc_id AND h.at >= s.start AND h.at < s.start + length(piece)),
z AS (SELECT h.doc_id, h.k, s.item, ({_KEPT})[CAST(h.at + 5 - s.start AS INTEGER) + 1] AS last FROM h JOIN s ON s.doc_id = h.doc_id AND h.at + 5 >= s.start AND h.at + 5 < s.start + length(piece))
SELECT e.doc_id, e.item AS start_item, e.start_offset, z.item AS end_item, z.last + 1 AS end_offset FROM e JOIN z ON z.doc_id = e.doc_id AND z.k = e.k""")
def _(spark, d):
    return search.phrase_hits(items(spark, d), "of the")
