import random
import re

from pyspark.sql import functions as F

from attesta.functions.text import norm_anchor, words
from attesta.operators import anchor_index, anchors, ingest, search, spans, verify

SPANS = [
    (1, 0, "Introduction", 1, "Intro", "heading"), (1, 1, "The odds ratio of lactate was 2.56 in 1,388 adults with septic shock.", 1, "Results", "body"),
    (1, 2, "The odds ratio of lactate was 2.56 in 1,388 adults with septic shock. Longer copy.", 2, "Table 1", "body"), (1, 3, "Heart rate", 3, "T", "table_cell"),
    (1, 4, "Heart rate 1 2", 3, "T", "table_row"), (1, 5, "Body temperature of all", 3, "T", "table_cell"), (1, 6, "Body temperature", 3, "T", "body"),
]
SPAN = "doc_id int, item int, text string, page int, section string, kind string"


def test_tiers(spark):
    want = [
        ("odds ratio of lactate", None, (anchors.EXACT, 1)), ("odds ratio of lactate", "table 1", (anchors.EXACT, 2)), ("ODDS  RATIO of lactate was 2.56 in 1388", None, (anchors.NORMAL, 1)),
        ("oddsratiooflactatewas2.56", None, (anchors.PACKED, 1)), ("odds ratio of | nothing", None, (anchors.PIPE, 1)),
        ("in 1,388 adults the odds ratio of lactate was 2.56 with septic shock", None, (anchors.TOKENS, 1)), ("Heart rate 85 90", None, (anchors.LABEL, 3)), ("nothing like it", None, None), ("", None, None),
        ("septic shock. Longer copy", None, (anchors.EXACT, 2)), ("Heart rate | 7", None, (anchors.PIPE, 3)),  # the cell, which the anchor holds, not the row
        ("Body temp | 7", None, (anchors.PIPE, 5)),  # the longer text, since it is a cell
        ("he", None, (anchors.EXACT, 1)), ("H", None, (anchors.EXACT, 3)),
    ]
    a = spark.createDataFrame([(str(i), 1, anchor, section) for i, (anchor, section, _) in enumerate(want)], "anchor_id string, doc_id int, anchor string, anchor_section string")
    got = {r.anchor_id: (r.tier, r.item) for r in anchors.resolve(a, spark.createDataFrame(SPANS, SPAN)).collect()}
    assert [got.get(str(i)) for i in range(len(want))] == [w for _, _, w in want]


def all_pairs(spark, a, s):
    """The resolution with every span of the document as a candidate."""
    own = a.join(s.withColumnRenamed("doc_id", "own"), F.col("doc_id") == F.col("own")).filter("anchor <> ''")
    forms = {}
    for side, c in (("anchor", "anchor"), ("text", "text")):
        norm = norm_anchor(F.col(c))
        forms |= {f"{side}_norm": norm, f"{side}_packed": F.regexp_replace(norm, r"\s", ""), f"{side}_words": words(F.col(c))}
    return {(r.anchor_id, r.item, r.tier) for r in own.withColumns(forms).withColumn("tier", anchors.tier()).filter("tier is not null").collect()}


def test_index_names_every_hit(spark):
    rng = random.Random(21)
    vocabulary = ["the", "septic", "shock", "3,500", "1.97", "Ärzte", "é", "e\u0301", "ΑΣ", "ﬁrst", "—", "a|b", "|", "\u2009", "mortality", "risk", "of", "12"]
    s = [(d, i, "".join(w + rng.choice([" ", " ", "", "  "]) for w in rng.choices(vocabulary, k=rng.randint(1, 40))), i % 4, "S", rng.choice(["body", "table_cell", "table_row"])) for d in range(6) for i in range(40)]
    s += [(d, 900 + i, t, 1, "S", "table_cell") for d in range(6) for i, t in enumerate(("Heart rate", "age", ""))] + s[:5]
    a = []
    for n, (d, i, text, *_) in enumerate(s[:200]):
        at = rng.randrange(len(text))
        part = text[at : at + rng.choice([1, 3, 6, 9, 14, 40, 90, 400])]
        a.append((f"{n}", d, rng.choice([part, part.upper(), part.replace(" ", ""), part + "zz", part[:7] + " | q", " ".join(sorted(part.split())), "Heart rate 12 of 90", part[:60] + "x" * 30]), None))
    a += [("n", None, "septic", None), ("m", 1, None, None), ("e", 1, "", None), ("b", 1, "  ", None), ("o", 77, "septic shock", None), ("d", 2, "mortality", None), ("d", 2, "mortality", None)]
    a, s = spark.createDataFrame(a, "anchor_id string, doc_id int, anchor string, anchor_section string"), spark.createDataFrame(s, SPAN)
    table = anchor_index.prepared(s)
    pairs = anchor_index.candidates(a.filter("anchor <> ''"), table).withColumnRenamed("doc_id", "own").join(table, "span").filter("own = doc_id")
    pairs = anchors.with_forms(pairs).withColumn("tier", anchors.tier()).filter("tier is not null")
    want = all_pairs(spark, a, s)
    assert {(r.anchor_id, r.item, r.tier) for r in pairs.collect()} == want and {t for _, _, t in want} == set(range(1, 8))
    assert {(r.anchor_id, r.item) for r in anchors.contained(a, s).collect()} == {(k, i) for k, i, t in want if t == anchors.EXACT}


def test_hot_features_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(anchor_index, "SALT_ROWS", 7)
    s = spark.createDataFrame([(1, i, "always the same words here", 1, "S", "body") for i in range(100)] + [(2, 0, "other", 1, "S", "body")], SPAN)
    a = spark.createDataFrame([("a", 1, "the same words"), ("b", 1, "same"), ("c", 2, "the same words")], "anchor_id string, doc_id int, anchor string")
    assert sorted((r.anchor_id, r.item) for r in anchors.contained(a, s).collect()) == [(k, i) for k in "ab" for i in range(100)]


def test_spans_of_three_kinds(spark):
    text = "Häading\n" + "x" * 5000 + "\nlast 🙂 line"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, full_text string")
    box = ", ".join(f"{c} double" for c in anchors.BOX)
    given = [(1, 0, 0, 7, 1, "s", "heading"), (1, 1, 8, 5008, 1, "s", None), (1, 2, 5009, 9999, 2, "s", "body"), (1, 3, 5, 5, 1, "s", None), (1, 4, -3, 2, 1, None, None), (2, 0, 0, 5, 1, "s", None), (9, 0, 0, 5, 1, "s", None)]
    offsets = spark.createDataFrame([(*g, None, None, None, None) for g in given], f"doc_id int, item int, start int, end int, page int, section string, kind string, {box}")
    cells = [(1, None, 0, 0, 0, "Age", 4, 0.0, 1.0, 5.0, 2.0), (1, None, 0, 0, 1, "61", 4, 6.0, 0.0, 9.0, 2.0), (1, None, 0, 0, 2, None, 4, 0.0, 0.0, 99.0, 99.0), (1, "T", 1, 3, 0, " ", 5, 0.0, 0.0, 1.0, 1.0)]
    cells = spark.createDataFrame(cells, f"doc_id int, caption string, table int, row int, col int, text string, page int, {box}")
    got = spans.build_spans(docs, offsets, cells).orderBy("item").collect()
    assert [(r.kind, r.text) for r in got if r.kind not in ("table_cell", "table_row")] == [("heading", "Häading"), ("body", "x" * 5000), ("body", "last 🙂 line"), ("body", "Hä")]
    assert [(r.kind, r.text, r.section, r.page, r.x0, r.y0, r.x1, r.y1) for r in got if r.section is None and r.kind != "body"] == [("table_cell", "Age", None, 4, 0, 0, 9, 2), ("table_cell", "61", None, 4, 0, 0, 9, 2), ("table_row", "Age 61", None, 4, 0, 0, 9, 2)]
    assert [(r.kind, r.text) for r in got if r.section == "T"] == [("table_cell", " ")]


ROWS = [(1, "Table 1", "t", 1, "Not present 413 18.2 13", 1), (1, "Table 1", "t", 2, "Present 1858 81.8 126", 1), (1, "Table 1", "t", 4, "Other 5 6 7", 1), (1, "Table 2", "u", 1, "Heart 44 55", 1), (1, "Table 2 (continued)", "v", 1, "rate 66 77", 2)]
ANCHOR = "anchor_id string, doc_id int, anchor string, anchor_caption string"


def test_slabs_and_numbers(spark):
    rows = spark.createDataFrame(ROWS, "doc_id int, caption string, table string, row int, text string, page int")
    for c in ("x0", "y0", "x1", "y1"):
        rows = rows.withColumn(c, F.col("row") * 1.0)
    assert [(r.table, r.row, r.n, r.y1) for r in anchors.slabs(rows).collect()] == [("t", 1, 2, 2.0)]
    both = "Not present 413 18.2 13 Present 1858 81.8 126"
    a = spark.createDataFrame([("a", 1, both, "table 1"), ("b", 1, both, "Table 9"), ("c", 1, both, None), ("d", 1, "Heart 44 55 rate 66 77", "Table 2"), ("e", 1, "", "Table 1")], ANCHOR)
    got = {r.anchor_id: (r.kind, r.n, r.table, r.row) for r in anchors.slab_hits(a, rows).collect()}
    assert got == {"a": ("rows", 2, "t", 1), "d": ("pages", 2, "u", 1)}  # another caption; no caption, but two in the document
    one = rows.filter("table = 't'")
    assert {r.anchor_id for r in anchors.slab_hits(a, one).collect()} == {"a", "c"}
    n = spark.createDataFrame([("b", 1, "413 of 18.2 and 13", "Table 1"), ("c", 1, "413 of 18.2 and 13", None), ("d", 1, "44 55", "Table 2")], ANCHOR)
    assert [tuple(r) for r in anchors.fingerprint_hits(n, rows).collect()] == [("b", "t", 1)]


def test_verdicts_of_claims(spark):
    kind = "row_id int, auc double, effect_value double, ci_lo double, ci_hi double, p_value double, cohort_size_n string, span string"
    given = [(1, 0.829, None, 0.791, 0.868, None, None, "0.829 (0.791-0.868)"), (2, None, 1.2, None, None, None, None, "OR 3.50 (95% CI 2.0-5.0)"), (3, None, None, None, None, None, None, "text"), (4, 0.81, None, None, None, None, "200", "AUC 81 in 200")]
    rows = verify.verdicts(verify.atoms(spark.createDataFrame(given, kind)))
    got = {r.row_id: (r.verdict, r.score) for r in rows.collect()}
    assert got == {1: ("ok", 1.0), 2: ("reject", 0.0), 3: ("partial", 0.5), 4: ("ok", 1.0)}


def test_unresolved_rows_are_demoted_once(spark):
    rows = spark.createDataFrame([(1, True, "ok", None), (2, True, "ok", "x; anchor_unresolved"), (3, False, "ok", None), (4, True, "reject", None)], "row_id int, anchor_unresolved boolean, verifier_verdict string, rationale string")
    got = {r.row_id: (r.verifier_verdict, r.rationale) for r in anchors.demote_unresolved(rows).collect()}
    assert got == {1: ("partial", "anchor_unresolved"), 2: ("partial", "x; anchor_unresolved"), 3: ("ok", None), 4: ("reject", None)}


def test_phrase_over_line_ends(spark):
    items = spark.createDataFrame([(1, 0, "A septic sho-"), (1, 1, "ck and septic   shock"), (1, 2, "septic"), (1, 3, "shock"), (None, 0, "Septic sh\u00adock")], "doc_id int, item int, text string")
    hits = sorted((tuple(r) for r in search.phrase_hits(items, " septic  SHOCK").collect()), key=str)
    assert hits == [(1, 0, 2, 1, 2), (1, 1, 7, 1, 21), (1, 2, 0, 3, 5), (None, 0, 0, 0, 13)]
    assert search.phrase_hits(items, " \u00ad ").count() == 0 and search.phrase_hits(items.limit(0), "a").count() == 0


def searched(texts, needle):
    """Hits in the joined text of one document, letter by letter."""
    joined, kept = [], [(i, t) for i, t in enumerate(texts) if t and re.search("[^ \\t\\n\\r\\f\u00a0\u00ad]", t)]
    for n, (i, t) in enumerate(kept):
        letters = []
        for at, c in enumerate(t):
            blank = c in " \t\n\r\f\u00a0"
            if c == "\u00ad" or (blank and (not letters or letters[-1][0] == " ")):
                continue
            letters.append((" " if blank else c.lower(), i, at))
        if t.endswith("-") and n + 1 < len(kept) and re.match("[A-Za-z]", kept[n + 1][1]):
            letters.pop()
        elif letters[-1][0] != " ":
            letters.append((" ", None, None))
        joined += letters
    text, out, at = "".join(c for c, _, _ in joined), [], 0
    while (at := text.find(needle, at)) >= 0:
        (_, a, b), (_, c, d) = joined[at], joined[at + len(needle) - 1]
        out.append((a, b, c, d + 1))
        at += len(needle)
    return out


def test_phrases_equal_a_search_letter_by_letter(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "STRETCH", 16)
    rng = random.Random(31)
    docs = {d: ["".join(rng.choices(["a", "aa", "b", " ", "  ", "-", "\u00ad", "\u00a0", "A", "\n", "é"], k=rng.randint(0, 12))) + rng.choice(["", "", "-"]) for _ in range(rng.randint(1, 14))] for d in range(60)}
    items = spark.createDataFrame([(d, i, t) for d, own in docs.items() for i, t in enumerate(own)], "doc_id int, item int, text string").repartition(3)
    for needle in ("aa", "a b", "aba a"):
        want = {(d, *h) for d, own in docs.items() for h in searched(own, needle)}
        assert {tuple(r) for r in search.phrase_hits(items, needle).collect()} == want and want


def test_offsets_and_titles(spark):
    items = spark.createDataFrame([(1, 0, "Heading"), (1, 1, " " * 3), (1, 2, "x" * 50)], "doc_id int, item int, text string")
    assert [(r.item, r.start, r.end, r.section) for r in ingest.text_offsets(items).orderBy("item").collect()] == [(0, 0, 7, "Heading"), (2, 8, 58, "Heading")]


def test_index_keeps_only_what_anchors_look_up(spark, monkeypatch):
    kept, write = {}, anchor_index.stage
    monkeypatch.setattr(anchor_index, "stage", lambda rows, name: kept.setdefault(name, write(rows, name)))
    s = spark.createDataFrame([(1, i, f"line {i} tells of septic shock and much else that nobody asks for", 1, "S", "body") for i in range(30)], SPAN)
    a = spark.createDataFrame([("a", 1, "line 7 tells of septic shock", None), ("b", 1, "line 7", None)], "anchor_id string, doc_id int, anchor string, anchor_section string")
    got = {(r.anchor_id, r.item) for r in anchors.contained(a, s).collect()}
    assert got == {("a", 7), ("b", 7)}
    assert kept["index"].join(kept["asked"], "feature", "left_anti").isEmpty() and not kept["index"].isEmpty()


def test_scope_meets_on_the_table_number(spark):
    rows = [(1, c, i, 1, f"{i} {i + 1} {i + 2}") for i, c in enumerate(["Table 1", "TABLE 1 (continued)", "Table 2", "Patients", "All patients", None, " "])] + [(2, "x", 9, 1, "9 10 11")]
    asked = [("a", 1, "Table 1"), ("b", 1, "patients"), ("c", 1, None), ("d", 2, None), ("e", 1, "Table 9"), ("f", 2, " "), ("g", 3, "x")]
    r = spark.createDataFrame(rows, "doc_id int, caption string, table int, row int, text string")
    a = spark.createDataFrame(asked, "anchor_id string, doc_id int, anchor_caption string")
    got = {(x.anchor_id, x.table) for x in anchors._in_scope(a, r, r).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 3), ("b", 4), ("d", 9)}
    plan = anchors._in_scope(a, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "__tag" in plan[plan.index("Join") :].split("\n")[0]


def _some(spark):
    rng = random.Random(22)
    vocabulary = ["the", "septic", "shock", "3,500", "1.97", "Ärzte", "é", "é", "ΑΣ", "ﬁrst", "—", "|", " ", "mortality", "risk", "of", "12", "🙂"]
    s = [(d, i, "".join(w + rng.choice([" ", " ", "", "  "]) for w in rng.choices(vocabulary, k=rng.randint(1, 40))), i % 4, rng.choice(["S", "T"]), rng.choice(["body", "table_cell", "table_row"])) for d in range(5) for i in range(30)]
    s += [(d, 900 + i, t, 1, "S", "table_cell") for d in range(5) for i, t in enumerate(("Heart rate", "age", "", None))] + s[:3]
    a = []
    for n, (d, _, text, *_) in enumerate(s[:150]):
        at = rng.randrange(len(text))
        part = text[at : at + rng.choice([1, 3, 6, 9, 14, 40, 90, 400])]
        a.append((f"{n}", d, rng.choice([part, part.upper(), part.replace(" ", ""), part[:7] + " | q", " ".join(sorted(part.split())), "Heart rate 12 of 90", part[:60] + "x" * 30]), rng.choice([None, "s"])))
    a += [("n", None, "septic", None), ("m", 1, None, None), ("e", 1, "", None), ("o", 77, "septic shock", None)]
    return spark.createDataFrame(a, "anchor_id string, doc_id int, anchor string, anchor_section string"), spark.createDataFrame(s, SPAN)


def test_pairs_name_every_hit(spark):
    a, s = _some(spark)
    pairs = anchor_index.paired(a.filter("anchor <> ''"), s).withColumn("tier", anchors.tier()).filter("tier is not null")
    want = all_pairs(spark, a, s)
    assert {(r.anchor_id, r.item, r.tier) for r in pairs.collect()} == want and {t for _, _, t in want} >= {1, 2, 3, 4, 5, 7}


def test_short_and_long_documents_resolve_alike(spark, monkeypatch):
    a, s = _some(spark)
    got = {}
    for most in (1 << 31, 120_000, 0):  # all pair by pair, some, none
        monkeypatch.setattr(anchor_index, "PAIRED", most)
        got[most] = {tuple(r) for r in anchors.resolve(a, s).collect()}
    assert got[0] == got[120_000] == got[1 << 31] and len(got[0]) > 60
    for last in (anchors.EXACT, anchors.PIPE, anchors.HEAD):
        for most in (0, 1 << 31):
            monkeypatch.setattr(anchor_index, "PAIRED", most)
            kept = {tuple(r) for r in anchors.resolve(a, s, last=last, keep=("item",)).collect()}
            assert {k for k in kept if k[1] == last} == {r[:3] for r in got[0] if r[1] == last}


def test_short_documents_need_no_index(spark, monkeypatch):
    written = []
    monkeypatch.setattr(anchors, "prepared", lambda rows: written.append(rows))
    a, s = _some(spark)
    assert anchors.resolve(a, s).count() and not written


def test_texts_that_may_change_are_told(spark):
    from attesta.functions.text import STABLE, unstable

    texts = ["", "plain", "Ärzte é", "ﬁrst", "a b", "é" * 5000 + "a" * 5000 + "é", "x ", "🙂", "—", "a\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unstable(F.col("t")).alias("odd"), F.col("t").rlike(f"[^{STABLE}]").alias("want"))
    assert all(r.odd == r.want for r in rows.collect())
