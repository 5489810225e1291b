"""Removal of long repeated byte strings, by a logarithmic family of sparse suffix arrays.

Every ``length`` consecutive bytes of a text form a string, and the string's
suffixes of at least ``ANCHOR`` bytes compete: the one whose first ``ANCHOR``
bytes have the least hash is its anchor. Equal strings have equal anchors at
equal places, so the suffix array of a batch of documents needs the anchors
only (about 1.5 % of all places). An entry stands for a run of neighbouring
strings with one anchor; the array is sorted by the hash of the anchor, then by
that of the run's bytes.

An arriving batch gets its array, is merge-scanned against the existing levels
(equal entries are repeats), and levels of equal size are merged into the next
one before the next arrival. Levels are bucketed by anchor, so that scans and
merges move no data. Entries with equal anchors but different runs may still
share some of their strings: those are compared string by string.

What is ordered by hash instead of by bytes, and why, is in the README.

Defined cases: null text is empty; texts shorter than ``length`` are never
touched; matches never cross documents; repeated rows are repeats of each other
and both lose what they share; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm._shared import release, shared_dir, stage
from attesta.llm._text import INVERSE, U, Bytes, mix, powers, slices

LENGTH, ANCHOR = 200, 64
_PLACE = U((1 << 28) - 1)
KEYS = ["anchor", "run"]


class Hashes:
    """Hash of any range of bytes of a buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum((buf.astype(U) + U(1)) * powers(max(n, 1))[:n], out=self.total[1:])
        self.inverse = powers(n + 1, INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x) - w + 1
    padded = np.concatenate((x, np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def entries(own: Bytes, length: int = LENGTH, most: int = 1 << 26) -> tuple[np.ndarray, ...]:
    """(text, anchor, run, lo, n): runs of n strings from byte lo of a text that have one anchor.

    A text of more than ``most`` bytes comes alone and is read in pieces that share length - 1 bytes: a string
    is in one piece, and a run that a piece cuts is one of several runs of its anchor.
    """
    if len(own.at) == 2 and len(own.buf) > most:
        parts = []
        for start in range(0, len(own.buf) - length + 1, most):
            piece = Bytes.__new__(Bytes)
            piece.buf = own.buf[start : start + most + length - 1]
            piece.at = np.array([0, len(piece.buf)])
            text, anchor, run, lo, n = entries(piece, length, len(piece.buf))
            parts.append((text, anchor, run, lo + start, n))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    none = tuple(np.zeros(0, t) for t in (np.int64, U, U, np.int64, np.int64))
    count = np.maximum(np.diff(own.at) - length + 1, 0)
    if not count.sum():
        return none
    h = Hashes(own.buf)
    place = np.arange(len(own.buf) - ANCHOR + 1)
    keys = h.of(place, place + ANCHOR)
    least = sliding_min((keys & ~_PLACE) | place.astype(U), length - ANCHOR + 1)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + own.at[:-1][text]
    owner = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    n = np.diff(np.concatenate((first, [len(owner)])))
    lo, anchor = at[first], owner[first]
    run = mix(h.of(lo, lo + n - 1 + length) + (anchor - lo).astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U) * U(0xD1342543DE82EF95))
    return text[first], keys[anchor], run, lo - own.at[:-1][text[first]], n


def _rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    anchor, run, n, doc, lo, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    arrays = [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "run", "n", "doc", "lo", "size"])


ENTRY = "anchor long, run long, n long, doc long, lo int, size int"


def _emit(combine: bool, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of a task's texts; combined, equal entries of the task become one with their number."""

    def combined(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        own = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((own[1], own[0]))
        own = [x[order] for x in own]
        first = np.flatnonzero(np.concatenate(([True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))))
        n = np.add.reduceat(own[2], first)
        return [(own[0][first], own[1][first], n, *(x[first] for x in own[3:]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for b in slices(batch, "text", 1 << 19):
                doc = b.column("doc").to_numpy()
                text, anchor, key, lo, n = entries(Bytes(b.column("text")), length)
                if not len(text):
                    continue
                own = (anchor, key, np.ones(len(n), np.int64), doc[text], lo, n)
                if not combine:
                    yield _rows([own])
                    continue
                parts.append(own)
                held += len(n)
                if held > 1_000_000:
                    yield _rows(combined(parts))
                    parts, held = [], 0
        if parts:
            yield _rows(combined(parts))

    return run


class IndexFamily:
    """Levels of sparse suffix arrays, each a table bucketed and sorted by anchor."""

    def __init__(self, spark: SparkSession, length: int = LENGTH):
        self.spark, self.length, self.folder = spark, length, shared_dir(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (size in batches, table)

    def _write(self, rows: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "anchor").sortBy(*KEYS).option("compression", "zstd")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc", "lo", "size")])

    def union(self) -> DataFrame:
        rows = self.spark.table(self.levels[0][1])
        for _, name in self.levels[1:]:
            rows = rows.union(self.spark.table(name))
        return rows

    def append(self, texts: DataFrame) -> None:
        """Index an arriving batch (doc, text), after merging levels of equal size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = self._write(self._summed(self.spark.table(a).union(self.spark.table(b))))
            self.levels.append((2 * size, merged))
            for name in (a, b):
                self.spark.sql(f"DROP TABLE {name}")
                release(self.spark, f"{self.folder}/{name}")
        rows = texts.mapInArrow(_emit(True, self.length), ENTRY).repartition(self.buckets, "anchor")
        self.levels.append((1, self._write(self._summed(rows))))

    def repeated(self) -> DataFrame:
        """(anchor, run) of the newest batch that occur twice in it, or in it and an older level."""
        new = self.spark.table(self.levels[-1][1]).select(*KEYS, "n", F.lit(1).alias("new"))
        for _, name in self.levels[:-1]:
            new = new.union(self.spark.table(name).select(*KEYS, "n", F.lit(0).alias("new")))
        return new.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("new").alias("new")).filter("n > 1 and new = 1").select(*KEYS)

    def partial(self) -> DataFrame:
        """One entry of each run whose anchor has several different runs."""
        rows = self._summed(self.union())
        many = rows.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("n").alias("least")).filter("runs > 1 and least = 1")
        return rows.join(many.select("anchor", "runs"), "anchor")

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            release(self.spark, f"{self.folder}/{name}")


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by ranges."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[first], reach[np.concatenate((first[1:] - 1, [len(start) - 1]))]


def cut(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, kept bytes)."""
    if not len(start):
        return 0, 0, raw
    lo, hi = _merged(start, end)
    kept, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return int((hi - lo).sum()), len(lo), b"".join(kept)


PART = "anchor long, runs long, open boolean, doc long, lo int, piece binary"
#: Runs of an anchor that one task compares at once; more are compared by shuffled rows.
GROUP = 4096


def _pieces(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of each partial entry of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 19):
                own = Bytes(b.column("text"))
                parts = b.column("parts").flatten()
                text = np.repeat(np.arange(b.num_rows), np.diff(b.column("parts").offsets.to_numpy()))
                lo, n = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "size"))
                start = own.at[:-1][text] + lo
                raw = own.buf.tobytes()
                pieces = [raw[s:e] for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                one = pa.array(parts.field("n").to_numpy(zero_copy_only=False) == 1)
                doc = pa.array(b.column("doc").to_numpy()[text])
                yield pa.RecordBatch.from_arrays([parts.field("anchor"), parts.field("runs"), one, doc, parts.field("lo"), pa.array(pieces, pa.binary())], ["anchor", "runs", "open", "doc", "lo", "piece"])

    return run


def _strings(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in its piece, hash) of each string of the pieces."""
    at = np.frombuffer(b.column("piece").cast(pa.large_binary()).buffers()[1], np.int64)
    piece = b.column("piece").cast(pa.large_binary())
    at = at[piece.offset : piece.offset + len(piece) + 1]
    buf = np.frombuffer(piece.buffers()[2], np.uint8)[at[0] : at[-1]]
    n = np.diff(at) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (at[:-1] - at[0])[row] + place
    return row, place, Hashes(buf).of(start, start + length)


def _compared(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranges of the open entries' strings that another run of the anchor has; rows come by anchor."""

    def marks(b: pa.RecordBatch) -> pa.RecordBatch:
        row, place, key = _strings(b, length)
        anchor = b.column("anchor").to_numpy()[row]
        order = np.lexsort((key, anchor))
        a, k = anchor[order], key[order]
        equal = (a[1:] == a[:-1]) & (k[1:] == k[:-1])
        shared = np.zeros(len(order), dtype=bool)
        shared[order[1:]] |= equal
        shared[order[:-1]] |= equal
        hit = np.flatnonzero(shared & b.column("open").to_numpy(zero_copy_only=False)[row])
        first = hit[np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])))] if len(hit) else hit
        last = hit[np.concatenate(((hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]), [True]))] if len(hit) else hit
        lo = b.column("lo").to_numpy()[row[first]]
        arrays = [pa.array(b.column("doc").to_numpy()[row[first]]), pa.array((lo + place[first]).astype(np.int32)), pa.array((lo + place[last] + length).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            held = rows.slice(cut)
            for start in _whole_groups(anchor[:cut]):
                yield marks(rows.slice(*start))
        if held is not None:
            yield marks(held)

    return run


def _whole_groups(anchor: np.ndarray, most: int = 2048) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of whole anchors, of about ``most`` rows."""
    start = 0
    while start < len(anchor):
        stop = min(start + most, len(anchor))
        stop = int(np.searchsorted(anchor, anchor[stop - 1], "right"))
        yield start, stop - start
        start = stop


def _exploded(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each string of the entries as a row (anchor, key, doc, at, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                b = batch.slice(start, 2048)
                row, place, key = _strings(b, length)
                lo = b.column("lo").to_numpy()[row]
                arrays = [pa.array(b.column("anchor").to_numpy()[row]), pa.array(key.view(np.int64)), pa.array(b.column("doc").to_numpy()[row]), pa.array((lo + place).astype(np.int32)), pa.array(b.column("open").to_numpy(zero_copy_only=False)[row])]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "key", "doc", "at", "open"])

    return run


def repeats(documents: DataFrame, length: int = LENGTH, batches: int = 4, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): texts (doc_id, doc, text); marks (doc, start, end) of repeated bytes.

    ``doc`` is a hash of id and text, so repeated rows share it. The documents
    arrive in ``batches`` batches dealt by that hash.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("string").alias(c) for c in carry])
    only = texts.select("doc", "text")
    family, found = IndexFamily(spark, length), None
    for i in range(batches):
        family.append(only.filter(F.pmod(F.shiftright("doc", 9), F.lit(batches)) == i))
        own = stage(family.repeated(), f"repeated-{i}", folder)
        found = own if found is None else found.unionByName(own)
        release(spark)
    partial = stage(family.partial(), "partial", folder)
    family.drop()
    release(spark)
    whole = only.mapInArrow(_emit(False, length), ENTRY).select(*KEYS, "doc", "lo", "size").join(found, KEYS, "left_semi")
    marks = stage(whole.select("doc", F.col("lo").alias("start"), (F.col("lo") + F.col("size") + length - 1).alias("end")), "whole", folder)
    release(spark)
    per_doc = partial.distinct().groupBy("doc").agg(F.collect_list(F.struct("anchor", "runs", "lo", "size", "n")).alias("parts"))
    pieces = stage(only.join(per_doc, "doc").mapInArrow(_pieces(length), PART), "pieces", folder)
    release(spark)
    by_anchor = pieces.filter(F.col("runs") <= GROUP).repartition("anchor").sortWithinPartitions("anchor")
    some = stage(by_anchor.mapInArrow(_compared(length), "doc long, start int, end int"), "some", folder)
    strings = pieces.filter(F.col("runs") > GROUP).mapInArrow(_exploded(length), "anchor long, key long, doc long, at int, open boolean")
    shared = strings.groupBy("anchor", "key").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", "key")
    rest = strings.filter("open").join(shared, ["anchor", "key"], "left_semi").select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    rest = stage(rest, "rest", folder)
    release(spark, f"{folder}/pieces", f"{folder}/partial")
    return texts, marks.unionByName(some).unionByName(rest)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def without_repeats(documents: DataFrame, length: int = LENGTH, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every document.

    kept_text lacks code points of which a byte was removed; ``carry`` names text columns to keep.
    """
    texts, marks = repeats(documents, length, carry=carry)
    spans = marks.distinct().groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc_id, text, start, end in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends")), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    removed, n, kept = cut(raw, np.array(start or [], np.int64), np.array(end or [], np.int64))
                    shown = kept.decode("utf-8", "ignore") if keep_text else None
                    for to, value in zip(out, (doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), shown), strict=True):
                        to.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *(b.column(c) for c in carry)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *carry])

    kind = RESULT + "".join(f", {c} string" for c in carry)
    return texts.join(spans, "doc", "left").select("doc_id", "text", "starts", "ends", *carry).mapInArrow(run, kind)
