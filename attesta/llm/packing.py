"""Conflict-constrained best-fit packing of token lengths into bins.

Documents are dealt by their row into parts of about ``part_rows`` rows, however
hot a source or cluster is and however often a row is repeated, and each part is
packed by best-fit decreasing: open bins are kept in order of residual space,
and the successor search walks up from the item's length to the first bin that
has room under both bitmaps. Where an item follows another of the same length,
source and cluster, the search goes on where that one's ended: what it passed is
closed to both. A bin carries one bitmap of the duplicate clusters it holds (a
second member conflicts) and ``max_per_source`` bitmaps of sources (a source
conflicts when its bit is set in all of them).

Defined cases: documents longer than ``capacity`` are cut into full bins and a
remainder that is packed; documents without tokens get one row with a null bin;
a null source or cluster never conflicts; repeated rows and rows without id are
packed each, in bins of their own rows; ties go by length, cluster, source, then
row; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import stage
from attesta.llm.decontaminate import word_count, words

RESULT = "doc_id long, piece int, n_tokens long, bin_id string, offset long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, taken in the given order; -1 is no source or cluster."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    planes: list[list[int]] = []  # of each bin: bitmaps of sources
    held: list[int] = []  # of each bin: bitmap of clusters
    bins, offsets = [], []
    before, passed = None, (0, -1)  # the item before, and the least bin that may be open to its like
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_bins, max((length, -1), passed) if before == (length, source, cluster) else (length, -1))
        while at < len(open_bins) and (planes[open_bins[at][1]][-1] & s or held[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held)
            planes.append([0] * max_per_source)
            held.append(0)
        held[b] |= c
        for i in range(max_per_source if s else 0):
            if not planes[b][i] & s:
                planes[b][i] |= s
                break
        bins.append(b)
        offsets.append(capacity - residual)
        left = (residual - length, b)
        before, passed = (length, source, cluster), min((residual, b), left) if not c else (residual, b)
        if left[0]:
            insort(open_bins, left)
    return bins, offsets


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers for the values, -1 for null."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)


def _packer(capacity: int, max_per_source: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("uid")
        n, sources, clusters = rows["n_tokens"].to_numpy(), _codes(rows["source"]), _codes(rows["cluster"])
        alone = np.bincount(clusters + 1, minlength=1)[clusters + 1] == 1
        order = np.lexsort((sources, clusters, -n))  # stable: then by row
        bins, offsets = best_fit(n[order].tolist(), sources[order].tolist(), np.where(alone, -1, clusters)[order].tolist(), capacity, max_per_source)
        part = rows["part"][0].as_py()
        out = rows.take(pa.array(order)).select(["doc_id", "piece", "n_tokens"])
        return out.append_column("bin_id", pa.array([f"{part}-{b}" for b in bins], pa.string())).append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def pack(lengths: DataFrame, capacity: int = 2048, max_per_source: int = 4, part_rows: int = 4096) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, offset) of rows (doc_id, n_tokens, source, cluster)."""
    uid = F.monotonically_increasing_id()
    lengths = stage(lengths.select("doc_id", "n_tokens", F.col("source").cast("string").alias("source"), "cluster", uid.alias("uid")), "lengths")  # texts are read once, rows are named
    parts = max(1, -(-lengths.count() // part_rows))
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).alias("n_tokens")
    rows = lengths.select("doc_id", whole.alias("piece"), rest, "source", "cluster", "uid", F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"))
    packed = rows.filter("n_tokens > 0").groupBy("part").applyInArrow(_packer(capacity, max_per_source), RESULT)
    full = lengths.filter(F.col("n_tokens") >= capacity).select("doc_id", "uid", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    name = F.concat_ws("-", F.lit("full"), F.col("uid"), F.col("piece"))
    full = full.select("doc_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), name.alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    none = lengths.filter("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), "n_tokens", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(full).unionByName(none)


def document_lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, source, cluster): words, and the hash of their sequence."""
    content = F.xxhash64(words(F.col("text")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n_tokens"), F.col("source").cast("string").alias("source"), content.alias("cluster"))
