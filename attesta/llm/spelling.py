"""Spelling variants of a vocabulary by Bloom-guided neighbourhoods.

Words are counted in the JVM with partial sums. For every word the deletions of
one letter and the replacements by a later letter are generated in numpy and
probed against broadcast Bloom filters of the vocabulary, one for each word
length, in blocks of 64 bits. Only edits that a filter lets through are shuffled
to an exact join with the vocabulary, which removes the false positives. An
insertion is a deletion seen from the longer word and a replacement is found
from the word of the smaller letter, so every pair is generated once.

The filters of one round hold at most ``round_words`` words (about 16 bits
each), whatever the vocabulary: lengths are dealt into rounds, and a length of
more words is cut by hash into as many slices as it takes.

Letters are ``a`` to ``z`` and U+00C0 to U+00FF; A-Z is lower-cased, nothing
else. Forms are followed to their root by doubling; each step multiplies the
count, so there are no cycles.

Defined cases: null or empty text has no words; a null ``doc_id`` is written as
an empty string in front of the colon; repeated rows count each; words of any
length are taken; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import shared_dir, stage
from attesta.llm._text import BASE, INVERSE, U, mix, powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: One run of a document in so many, by checksum, loses a letter.
SLIPS = 199
BITS_PER_WORD, PROBES = 16, 5
#: Cells (words times positions times letters) of one numpy step.
CELLS = 1 << 20


def runs(text: Column) -> Column:
    """Array of the runs of letters of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))


def slipped(doc_id: Column, run: Column, slips: int = SLIPS) -> Column:
    """The run, less one letter where ``slips`` divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % slips == 0, shorter).otherwise(run)


def vocabulary(documents: DataFrame, least_length: int = 6, least_count: int = 5, slips: int = SLIPS) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences over all documents."""
    each = documents.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    words = each.select(slipped(F.col("doc_id"), F.col("run"), slips).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Letters:
    """Words of one length as a matrix of Latin-1 codes, with the hash of each and of its edits."""

    def __init__(self, words: list[str], length: int):
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
        self.powers = powers(length + 1)
        self.terms = (self.codes.astype(U) + U(1)) * self.powers[:length]
        self.ends = np.cumsum(self.terms, axis=1)
        self.hash = self.ends[:, -1]

    def deletions(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it is the first of equal ones) of words less the letter at lo to hi."""
        before = self.ends[:, lo:hi] - self.terms[:, lo:hi]
        h = before + (self.hash[:, None] - self.ends[:, lo:hi]) * U(INVERSE)
        first = np.ones(h.shape, bool)
        inner = np.arange(max(lo, 1), hi)
        first[:, inner - lo] = self.codes[:, inner] != self.codes[:, inner - 1]
        return h, first

    def replacements(self, lo: int, hi: int, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether the new letter is a later one) of words with the letter at lo to hi replaced."""
        old = self.codes[:, lo:hi, None].astype(U)
        new = alphabet[None, None, :]
        return self.hash[:, None, None] + (new - old) * self.powers[lo:hi][None, :, None], new > old


def _marks(h: np.ndarray) -> np.ndarray:
    """The bits of each hash in its block of 64."""
    mask = np.zeros_like(h)
    for k in range(PROBES):
        mask |= U(1) << ((h >> U(6 * k)) & U(63))
    return mask


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(h ^ U(BASE)) >> U(32)) * U(blocks)) >> U(32)


class Filter:
    """Blocked Bloom filter of one slice of the words of one length."""

    def __init__(self, n_words: int, slices: int = 1, nth: int = 0):
        self.slices, self.nth = slices, nth
        self.bits = np.zeros(max(1, -(-n_words * BITS_PER_WORD // 64)), U)

    def places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the word belongs to this slice, block, bits) of raw hashes."""
        h = mix(raw)
        own = (h >> U(40)) % U(self.slices) == U(self.nth) if self.slices > 1 else np.ones(h.shape, bool)
        return own, _block(h, len(self.bits)), _marks(h)

    def may_hold(self, raw: np.ndarray) -> np.ndarray:
        own, block, mask = self.places(raw)
        return own & ((self.bits[block] & mask) == mask)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes):
        yield int(length), np.flatnonzero(sizes == length)


def rounds(lengths: dict[int, int], round_words: int) -> list[dict[int, tuple[int, int, int]]]:
    """Filters that travel together: {length: (words, slices, nth slice)}, at most ``round_words`` words each."""
    out: list[dict[int, tuple[int, int, int]]] = []
    room = 0
    for length, n in sorted(lengths.items()):
        slices = -(-n // round_words)
        share = -(-n // slices)
        for nth in range(slices):
            if share > room or nth:
                out.append({})
                room = round_words
            out[-1][length] = (share, slices, nth)
            room -= share
    return out


def filters_of(vocab: DataFrame, plan: dict[int, tuple[int, int, int]]) -> dict[int, Filter]:
    """The filters of one round; their blocks, of a bounded number, reach the driver."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {length: Filter(*x) for length, x in plan.items()}
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, rows in _by_length(words):
                if length in own:
                    part = max(1, CELLS // length)
                    for s in range(0, len(rows), part):
                        mine, block, mask = own[length].places(Letters([words[i] for i in rows[s : s + part]], length).hash)
                        np.bitwise_or.at(own[length].bits, block[mine], mask[mine])
        for length, f in own.items():
            at = np.flatnonzero(f.bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length, np.int64)), pa.array(at), pa.array(f.bits[at].view(np.int64))], ["length", "block", "mask"])

    rows = vocab.select("word").filter(F.length("word").isin(list(plan))).mapInArrow(marked, "length long, block long, mask long")
    merged = rows.groupBy("length", "block").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = {length: Filter(*x) for length, x in plan.items()}
    for length, own in merged.groupby("length"):
        out[length].bits[own["block"].to_numpy()] = own["mask"].to_numpy().view(U)
    return out


def guided(vocab: DataFrame, shared: Broadcast, alphabet: str) -> DataFrame:
    """(edit, word, n): the edits of words that the filters let through."""
    letters = np.frombuffer(alphabet.encode("latin-1"), np.uint8).astype(U)

    def edits(words: list[str], length: int, filters: dict[int, Filter]) -> Iterator[tuple[np.ndarray, list[str]]]:
        own = Letters(words, length)
        step = max(1, CELLS // (len(words) * max(1, len(letters))))
        for lo in range(0, length, step):
            hi = min(length, lo + step)
            if length - 1 in filters:
                h, first = own.deletions(lo, hi)
                row, at = np.nonzero(first & filters[length - 1].may_hold(h))
                yield row, [words[r][: lo + i] + words[r][lo + i + 1 :] for r, i in zip(row.tolist(), at.tolist(), strict=True)]
            if length in filters:
                h, later = own.replacements(lo, hi, letters)
                row, at, to = np.nonzero(later & filters[length].may_hold(h))
                yield row, [words[r][: lo + i] + alphabet[c] + words[r][lo + i + 1 :] for r, i, c in zip(row.tolist(), at.tolist(), to.tolist(), strict=True)]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, rows in _by_length(words):
                if length not in filters and length - 1 not in filters:
                    continue
                part = max(1, CELLS // (length * max(1, len(letters))))
                for s in range(0, len(rows), part):
                    some = rows[s : s + part]
                    for row, found in edits([words[i] for i in some], length, filters):
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([words[i] for i in some[row]], pa.string()), pa.array(n[some[row]])], ["edit", "word", "n"])

    return vocab.select("word", "n").mapInArrow(probed, "edit string, word string, n long")


def near_words(vocab: DataFrame, folder: str, round_words: int = 1 << 22) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that differ by one edit; vocab (word, n) holds each once."""
    spark = vocab.sparkSession
    lengths = {r["length"]: r["n"] for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    found = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()  # 90 letters at most
    alphabet = "".join(sorted(r["c"] for r in found))
    wide = spark.sparkContext.defaultParallelism
    spread = vocab.repartition(wide, "word") if vocab.rdd.getNumPartitions() < wide else vocab
    for i, plan in enumerate(rounds(lengths, round_words)):
        shared = spark.sparkContext.broadcast(filters_of(vocab, plan))
        guided(spread, shared, alphabet).write.parquet(f"{folder}/edits/{i}")
    if not lengths:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    edits = spark.read.schema("edit string, word string, n long").parquet(*[f"{folder}/edits/{i}" for i in range(i + 1)])
    pairs = edits.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("edit") == F.col("near")).select("word", "n", "near", "near_n")
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back)


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words with a form (word, form): its form's form and so on, in doubling steps."""
    at, turn = forms.select("word", F.col("form").alias("root")), 0
    while True:
        over = at.select(F.col("word").alias("via"), F.col("root").alias("end"))
        moved = at.join(over, at.root == over.via, "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        moved, turn = stage(moved, f"roots-{turn}", folder), turn + 1
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_groups(documents: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, slips: int = SLIPS, round_words: int = 1 << 22) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    form is the near word of the largest count, of equal ones the smallest, if that is at least ``ratio`` times the word's.
    """
    folder = shared_dir(documents.sparkSession)
    vocab = stage(vocabulary(documents, least_length, least_count, slips), "vocabulary", folder)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocab, folder, round_words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best)
    fits = -F.col("best.minus") >= ratio * F.col("n")
    near = stage(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "near", folder)
    ends = roots(near.filter("form is not null").select("word", "form"), folder)
    whole = vocab.join(near, "word", "left").join(ends, "word", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
