"""Benchmark decontamination with DataFrame functions only.

Every benchmark item becomes windows of ``n`` consecutive words (an item of
fewer words, but not none, is one shorter window). A bit set over
the hashes of the windows' leading words travels with the plan; one scan over
the documents keeps the windows whose bits are set. Only those are joined with
the set of benchmark windows, which is broadcast when it holds at most
``max_broadcast_windows`` (else joined by shuffle), and verified word by word.

Defined cases: null or empty text has no words; repeated documents are judged
each; documents that share a ``doc_id`` but differ in text are kept apart; a
null ``doc_id`` is a value like any other; benchmark rows with a null id mark
words but are not listed as items; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import stage

#: Words are runs of ASCII digits, ASCII letters and code points from U+0080 on.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased."""
    spaced = F.translate(F.coalesce(text, F.lit("")), OTHER + LETTERS.upper(), " " * len(OTHER) + LETTERS)
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, h, gram, items): each distinct window with the items that hold it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    items = items.withColumn("len", F.least(F.size("w"), F.lit(n))).filter("len > 0")
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    grams = items.select("item", "len", "w", starts.alias("s")).select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("gram"))
    return grams.groupBy("len", F.xxhash64("gram").alias("h"), "gram").agg(F.collect_set("item").alias("items"))


#: Least and most longs of 64 bits in the bit set; beyond what these hold well, more windows are verified by the join.
SLOT_BITS, MOST_SLOT_BITS = 14, 17
LEAD = 3


def slot_bits(n_windows: int) -> int:
    """Size of the bit set, as a power of two: 16 bits or more for each window, within the bounds."""
    return min(MOST_SLOT_BITS, max(SLOT_BITS, (n_windows // 4).bit_length()))


def _probes(words_: list[Column], bits: int) -> list[tuple[Column, Column]]:
    """(slot, bit) of two independent probes for a window that begins with these words."""
    h = F.xxhash64(*words_)
    return [(F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1).cast("int"), F.shiftrightunsigned(h, shift + bits).bitwiseAND(63).cast("int")) for shift in (0, bits + 6)]


def _bit_set(grams: DataFrame, size: int) -> Column:
    """The bit set of 2 to the ``size`` longs as a constant column; at most as many rows reach the driver."""
    lead = F.transform(F.slice("gram", 1, LEAD), lambda w: w)
    one = grams.withColumn("lead", lead)
    parts = []
    for length in range(1, LEAD + 1):
        own = one.filter(F.size("lead") == length)
        parts += [own.select(slot.alias("slot"), F.expr("1L").alias("unit"), bit.alias("bit")) for slot, bit in _probes([F.get("lead", F.lit(i)) for i in range(length)], size)]
    bits = reduce(DataFrame.unionByName, parts).select("slot", F.expr("shiftleft(unit, bit)").alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    filled = {r["slot"]: r["mask"] for r in bits.collect()}
    return F.split(F.lit(",".join(str(filled.get(i, 0)) for i in range(1 << size))), ",").cast("array<bigint>")


def scan(documents: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, candidates): one pass; candidates are (start, gram)."""
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n rows
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    docs = docs.withColumn("size", F.size("w"))
    size = slot_bits(grams.count())
    bits = _bit_set(grams, size)

    def kept(length: int) -> Column:
        def set_at(i: Column) -> Column:
            tests = [F.get(bits, slot).bitwiseAND(F.call_function("shiftleft", F.expr("1L"), bit)) != 0 for slot, bit in _probes([F.get("w", i + k) for k in range(min(LEAD, length))], size)]
            return tests[0] & tests[1]

        starts = F.when(F.col("size") >= length, F.sequence(F.lit(0), F.col("size") - length))
        return F.transform(F.filter(starts, set_at), lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, length).alias("gram")))

    none = F.array().cast("array<struct<start:int,gram:array<string>>>")
    found = F.concat(none, *[F.coalesce(kept(x), none) for x in lengths])
    return docs.select("doc_id", "text_key", F.col("size").cast("long").alias("n_words"), found.alias("candidates"))


def hits(scanned: DataFrame, grams: DataFrame, max_broadcast_windows: int = 500_000) -> DataFrame:
    """(hit_id, hit_key, start, len, items): each place where a benchmark window occurs."""
    rows = scanned.filter(F.size("candidates") > 0).select("doc_id", "text_key", F.explode("candidates").alias("c"))
    rows = rows.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "c.start", F.col("c.gram").alias("own"), F.xxhash64("c.gram").alias("h"))
    grams = F.broadcast(grams) if grams.count() <= max_broadcast_windows else grams
    return rows.join(grams, "h").filter(F.col("own") == F.col("gram")).select("hit_id", "hit_key", "start", "len", "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) for every row of documents.

    spans: array of (start, len) in words, null without a hit; items: sorted ids.
    """
    grams = stage(benchmark_windows(benchmark, n), "windows")
    scanned = stage(scan(documents, grams, id_col, text_col), "scan")
    own = hits(scanned, grams).groupBy("hit_id", "hit_key").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    docs = scanned.drop("candidates")
    return docs.join(own, docs.doc_id.eqNullSafe(own.hit_id) & (docs.text_key == own.hit_key), "left").drop("hit_id", "hit_key")


def contamination_report(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: words, words inside a hit window, items found and their digest."""
    found = decontaminate(documents, benchmark, n)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    n_hit = F.when(F.col("spans").isNull(), 0).otherwise(F.size(covered)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of documents, all their columns, in which no benchmark window occurs."""
    grams = stage(benchmark_windows(benchmark, n), "windows")
    dirty = hits(stage(scan(documents, grams), "scan"), grams).select("hit_id", "hit_key").distinct()
    return documents.join(dirty, documents["doc_id"].eqNullSafe(dirty["hit_id"]) & (F.xxhash64(documents["text"]) == dirty["hit_key"]), "left_anti")
