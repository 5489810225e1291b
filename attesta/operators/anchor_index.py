"""Candidate spans of anchors from an inverted index, instead of all spans of the document.

Every span is cut into features: the blocks of GRAM letters of its packed form
(normalised, without white space), the prefix of its words, and its whole normal
form. Features are hashed with the document, so an index row is narrow and a
document of any number of spans is spread over all tasks. Only index rows whose
feature some anchor looks up are written.

Containment: where a span holds an anchor in one of the tiers that ask for it,
its packed form holds the interior of the anchor's shortest needle (the whole,
the head or the part before a pipe, all packed). One of GRAM neighbouring grams
of that interior is a block of the span then, whatever the alignment. Of RUNS
such runs of grams, spread over the needle, the one with the fewest index rows
is looked up. Needles too short for that meet the document's spans once for each
different needle, dealt by salts, and keep the spans whose packed form holds them.

Alike words: two sets of similarity t share a word among the first
``n - ceil(t n) + 1`` words of either, in one order of all words, long ones
(which are rare) first; sizes must be within t of each other.

Whoever uses the candidates must test them: they are a superset of the hits.

A document whose spans and anchors are few enough (PAIRED) needs no index: there each span is tested on each anchor,
which costs less than the features of its spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import nfkc, norm_anchor, norm_compatible, text_of, unstable, words
from attesta.sources.staging import stage

GRAM, HEAD_LENGTH, PROBE_LENGTH = 6, 60, 6
#: Needles from so many letters on hold a block of GRAM letters, whatever the alignment.
WHOLE = 2 * GRAM - 1
#: Runs of neighbouring grams of a needle among which the rarest is looked up.
RUNS = 2
ALIKE, ALIKE_LENGTH = 0.85, 30
#: Letters that the spans of a document may have, times its anchors, for each span to be tested on each anchor.
PAIRED = 1 << 31
#: Index rows of one feature that meet their probes in one task.
SALT_ROWS, SHORT_SALTS = 4096, 16


def packed(norm: Column) -> Column:
    return F.regexp_replace(norm, r"\s", "")


def probe_of(norm: Column) -> Column:
    """What stands before the first pipe."""
    return F.trim(F.substring_index(norm, "|", 1))


def label_of(norm: Column) -> Column:
    """The leading words of a row of numbers."""
    return F.regexp_extract(norm, r"^([a-z][a-z \-]{3,}?)\s*\d", 1)


def needle_of(anchor: Column, norm: Column) -> Column:
    """The packed text that every span which contains the anchor, its head or its probe must hold.

    What a span's normalisation may do to the ends of an anchor inside it (marks that combine, letters with a final
    form) touches the first and last letter with their marks alone, and a comma that up to two digits follow, since a third
    may follow in the span; these are left out.
    """
    probe = probe_of(norm)
    piped = anchor.contains("|") & (F.length(probe) >= PROBE_LENGTH)
    head = F.when(F.length(anchor) >= HEAD_LENGTH, F.substring(norm, 1, HEAD_LENGTH)).otherwise(norm)
    shortest = packed(F.when(piped & (F.length(probe) < F.length(head)), probe).otherwise(head))
    shortest = F.regexp_replace(shortest, r",\d{0,2}$", "")
    return F.regexp_replace(F.regexp_replace(shortest, r"(?s)^\p{M}*.", ""), r"(?s).\p{M}*$", "")


def span_key() -> Column:
    """Names a span: its document, place and content."""
    return F.xxhash64("doc_id", "item", "text", "page", "section")


def _prefix(tokens: Column) -> Column:
    order = F.sort_array(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    n = F.size(tokens)
    return F.transform(F.slice(order, 1, F.when(n > 0, n - F.ceil(n * ALIKE - 1e-9).cast("int") + 1).otherwise(0)), lambda x: x["t"])


def _feature(kind: str, value: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(kind), value).alias("feature")


def _blocks() -> Column:
    return F.array_distinct(F.regexp_extract_all("text_packed", F.lit(f"(?s).{{{GRAM}}}"), F.lit(0)))


def _index(spans: DataFrame, full: bool) -> DataFrame:
    """(feature, span, size): one row for each feature of each span."""
    spans = spans.withColumns({"text_words": words(F.col("text")), "text_packed": packed(F.col("text_norm"))})

    def rows(kind: str, values: Column) -> DataFrame:
        return spans.select("doc_id", "span", F.size("text_words").alias("size"), F.explode(values).alias("v")).select(_feature(kind, F.col("v")), "span", "size")

    parts = [rows("gram", _blocks())]
    if full:
        cells = spans.filter("kind = 'table_cell'").select(_feature("label", F.col("text_norm")), "span", F.size("text_words").alias("size"))
        parts += [rows("word", _prefix(F.col("text_words"))), cells]
    return reduce(DataFrame.unionByName, parts)


def _looked_up(anchors: DataFrame, full: bool) -> DataFrame:
    """(anchor_key, kind, pos, feature, own): the runs of grams of the needles (pos: the run), with full words and labels."""
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda i: F.floor(i * (F.length("needle") - WHOLE) / (RUNS - 1)).cast("int")))
    runs = anchors.filter(F.length("needle") >= WHOLE).select("anchor_key", "doc_id", "needle", F.explode(starts).alias("pos"))
    each = runs.select("anchor_key", "doc_id", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda i: F.substring(F.col("needle"), F.col("pos") + i, F.lit(GRAM)))).alias("v"))
    parts = [each.select("anchor_key", F.lit("gram").alias("kind"), "pos", _feature("gram", F.col("v")), F.lit(-1).alias("own"))]
    if full:
        tokens = anchors.filter(F.length("anchor") >= ALIKE_LENGTH).select("anchor_key", "doc_id", F.size("anchor_words").alias("own"), F.explode(_prefix(F.col("anchor_words"))).alias("v"))
        label = label_of(F.col("anchor_norm"))
        parts += [tokens.select("anchor_key", F.lit("word").alias("kind"), F.lit(0).alias("pos"), _feature("word", F.col("v")), "own")]
        parts += [anchors.filter(label != "").select("anchor_key", F.lit("label").alias("kind"), F.lit(0).alias("pos"), _feature("label", label), F.lit(-1).alias("own"))]
    return reduce(DataFrame.unionByName, parts)


def _rarest(grams: DataFrame) -> DataFrame:
    """Of each anchor's runs of grams (pos, feature, n) the one with the fewest index rows."""
    runs = grams.groupBy("anchor_key", "pos").agg(F.sum("n").alias("total"), F.collect_set(F.struct("feature", "n")).alias("g"))
    best = runs.groupBy("anchor_key").agg(F.min_by("g", F.struct("total", "pos")).alias("g"))
    return best.select("anchor_key", F.explode("g").alias("x")).select("anchor_key", F.lit(-1).alias("own"), "x.feature", "x.n")


def _met(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(anchor_key, span) of probes (anchor_key, feature, n, own); features of many rows are dealt over salts."""
    hot = probes.filter(F.col("n") > SALT_ROWS).select("feature", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")).distinct()
    salts = F.coalesce("salts", F.lit(1))
    dealt = index.join(hot, "feature", "left").withColumn("salt", F.pmod(F.col("span"), salts).cast("int")).drop("salts")
    each = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / SALT_ROWS).cast("int"), F.lit(1)) - 1))
    near = (F.col("own") < 0) | (F.least("own", "size") >= ALIKE * F.greatest("own", "size") - 1e-9)
    return probes.withColumn("salt", each).join(dealt, ["feature", "salt"]).filter(near).select("anchor_key", "span")


def prepared(spans: DataFrame) -> DataFrame:
    """Spans with their key and normal form, written once: every step of a resolution reads this table."""
    return stage(spans.withColumns({"span": span_key(), "text_norm": norm_anchor(F.col("text"))}), "spans")


def long_documents(anchors: DataFrame, spans: DataFrame) -> DataFrame | None:
    """(doc_id) of the documents with more letters than PAIRED to be tested; None if there are none."""
    asked = anchors.groupBy("doc_id").agg(F.count("*").alias("n"))
    letters = spans.groupBy("doc_id").agg(F.sum(F.length("text") + 1).alias("letters"))
    over = stage(letters.join(asked, "doc_id").filter(F.col("letters") > PAIRED / F.col("n")).select("doc_id"), "long")
    return None if over.isEmpty() else over


def _compatible(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``__form``, the compatibility form of a text where it is another; other rows never leave the JVM."""
    odd, own = F.coalesce(unstable(F.col(text)), F.lit(False)), F.lit(None).cast("string")
    return rows.filter(~odd).withColumn("__form", own).unionByName(rows.filter(odd).withColumn("__form", nfkc(F.col(text))))


def _marks(tokens: Column) -> Column:
    """One of 64 bits for each word."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return F.aggregate(tokens, none, lambda s, t: s.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))


def paired(anchors: DataFrame, spans: DataFrame, alike: bool = True, labels: bool = True) -> DataFrame:
    """Anchors with their forms, and the span (doc_id named own) of each pair that may hit, as by ``candidates``: every
    span of a document is tested on every anchor of it. Both sides are moved once, as they are, and get their forms there.

    alike, labels: also pairs of alike words, and labels. Sets of a and b words of similarity t differ in at most
    (a + b) (1 - t) / (1 + t) words, and so do their marks in bits.
    """
    a = _compatible(anchors, "anchor").repartition("doc_id").withColumn("anchor_norm", norm_compatible(F.coalesce("__form", text_of(F.col("anchor"))))).drop("__form")
    long = F.length("anchor") >= ALIKE_LENGTH
    a = a.withColumns({"anchor_packed": packed(F.col("anchor_norm")), "needle": needle_of(F.col("anchor"), F.col("anchor_norm")), "__w": F.when(long, words(F.col("anchor")))})
    a = a.withColumns({"label": label_of(F.col("anchor_norm")), "own_size": F.size("__w"), "own_marks": _marks(F.col("__w"))}).drop("__w")
    s = _compatible(spans.withColumnRenamed("doc_id", "own"), "text").repartition("own").withColumn("text_norm", norm_compatible(F.coalesce("__form", text_of(F.col("text"))))).drop("__form")
    s = s.withColumns({"text_packed": packed(F.col("text_norm")), "__w": words(F.col("text"))}).withColumns({"size": F.size("__w"), "marks": _marks(F.col("__w"))}).drop("__w")
    near, both = F.col("text_packed").contains(F.col("needle")), F.col("own_size") + F.col("size")
    sets = (F.least("own_size", "size") >= ALIKE * F.greatest("own_size", "size") - 1e-9) & (F.bit_count(F.col("own_marks").bitwiseXOR(F.col("marks"))) <= both * ((1 - ALIKE) / (1 + ALIKE)) + 1e-9)
    if alike:
        near = near | sets
    if labels:
        near = near | ((F.col("label") != "") & (F.col("kind") == "table_cell") & (F.col("text_norm") == F.col("label")))
    pairs = s.join(a.hint("shuffle_hash"), (F.col("own") == F.col("doc_id")) & near)
    # only pairs that may be alike need their words
    told = {f"{c}_words": F.when(sets, words(F.col(c))) if alike else F.lit(None).cast("array<string>") for c in ("anchor", "text")}
    return pairs.withColumns({c: F.coalesce(w, F.array().cast("array<string>")) for c, w in told.items()}).drop("needle", "label", "own_size", "own_marks", "size", "marks")


def candidates(anchors: DataFrame, spans: DataFrame, full: bool = True) -> DataFrame:
    """Anchors with their forms and ``span``, the key of each of the prepared spans that may hit in some tier.

    full: also by words and labels; else by containment alone.
    """
    norm = norm_anchor(F.col("anchor"))
    a = anchors.withColumns({"anchor_norm": norm, "anchor_words": words(F.col("anchor")), "anchor_key": F.xxhash64(*anchors.columns)})
    a = stage(a.withColumns({"anchor_packed": packed(F.col("anchor_norm")), "needle": needle_of(F.col("anchor"), F.col("anchor_norm"))}), "anchors")
    each = stage(_looked_up(a, full), "asked")
    index = stage(_index(spans, full).join(each.select("feature").distinct(), "feature", "left_semi"), "index")
    known = each.join(index.groupBy("feature").agg(F.count("*").alias("n")), "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    others = known.filter("kind in ('word', 'label')").select("anchor_key", "own", "feature", "n")
    probes = stage(_rarest(known.filter("kind = 'gram'")).unionByName(others).filter("n > 0"), "probes")
    pairs = _met(probes, index).unionByName(_short(a, spans)).distinct()
    return pairs.join(a.drop("needle"), "anchor_key").drop("anchor_key")


def _short(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """(anchor_key, span) of needles shorter than WHOLE: each different one of a document is tested once on its spans."""
    a = anchors.filter(F.length("needle") < WHOLE).select("anchor_key", "doc_id", "needle")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SHORT_SALTS - 1))).alias("salt")
    wide = spans.select("doc_id", "span", packed(F.col("text_norm")).alias("text_packed"), F.pmod(F.col("span"), F.lit(SHORT_SALTS)).cast("int").alias("salt"))
    held = a.select("doc_id", "needle").distinct().select("*", salts).join(wide, ["doc_id", "salt"]).filter(F.col("text_packed").contains(F.col("needle")))
    return a.join(held.select("doc_id", "needle", "span"), ["doc_id", "needle"]).select("anchor_key", "span")
