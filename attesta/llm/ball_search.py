"""Exact ranked lexical search over a forest of sparse ball trees.

Documents are vectors of integers, one coordinate for each term: what an
occurrence count adds to the score, ``(1e9 * tf) div (1000 * tf + 12 * m)``. A
query is the vector of its terms' weights, and the score is the inner product.

One pass over the texts stages the counts of each document, a second over these
builds ball trees of up to ``tree_docs`` documents, one row for each tree. A
node has its centroid, its radius and the greatest value of each coordinate; no
document below it scores more than the lesser of ``q . c + |q| r`` (over the
query's coordinates) and ``q . top``. Bounds are floats widened by more than
their rounding. A query walks a tree best-first by these bounds, stops where the
best bound is less than its k-th score so far, and scores leaves in 64-bit
integers; that k-th score is carried through all trees of a partition. Each
partition passes on k documents for each query, and two ranked steps, the first
one salted, leave the best k of all.

Queries come in blocks of ``block_items`` items or ``block_bytes`` of text, and
the vectors hold the terms of the block alone: what is broadcast and collected
is bounded by the block, and other terms add nothing to a score. Terms are told
apart by a 64-bit hash.

Defined cases: null or empty texts have no terms and are not counted; items
without terms, or whose terms no document holds, get no rows; items of one id
are ranked each; repeated rows and rows without id are documents of their own,
null after all ids among equal scores; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from attesta.llm._shared import shared_dir, stage
from attesta.llm._text import U, Bytes, Words, slices

LEAF = 32
#: Relative and absolute margin of the bounds: far more than the rounding of sums of 64-bit floats, far less than a score.
MARGIN, LEAST = 1e-9, 1.0


def term_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the terms of each text, with repeats."""
    words = Words(Bytes(pa.array(texts, pa.large_string())))
    return [words.hash[s:e] for s, e in zip(words.at[:-1], words.at[1:], strict=True)]


def counted(documents: DataFrame, terms: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: all their terms, and the counts of those in ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        for batch in batches:
            for b in slices(batch, "text"):
                words = Words(Bytes(b.column("text")))
                n = np.diff(words.at)
                place = np.minimum(np.searchsorted(wanted, words.hash), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[place] == words.hash) if len(wanted) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(doc * len(wanted) + place[hit], return_counts=True)
                at = np.searchsorted(key, np.arange(len(n) + 1) * max(1, len(wanted)))
                term = pa.array((key % max(1, len(wanted))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), v) for v in (term, pa.array(tf.astype(np.int32)))]
                out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def values_of(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What tf occurrences add in a document of n terms, before the term's weight."""
    m = 75 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """A ball tree over sparse rows; arrays only, so that it is one row of a table.

    Documents stand in the order of the leaves. Nodes are in depth-first order: a
    node's documents are ``lo`` to ``hi``, its second child is ``right`` (0: a leaf),
    its coordinates are ``at[i]`` to ``at[i + 1]`` of ``coord``, ``centre``, ``top``.
    """

    ARRAYS = {"ids": "<i8", "known": "<i1", "rows": "<i4", "terms": "<i4", "values": "<i4", "lo": "<i4", "hi": "<i4", "right": "<i4", "radius": "<f8", "at": "<i4", "coord": "<i4", "centre": "<f8", "top": "<i4"}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, known: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> Tree:
        """Nodes are cut at the median between two far documents until ``LEAF`` are left, or equal ones."""
        order = np.arange(len(ids))
        square = np.add.reduceat(values.astype(float) ** 2, rows[:-1])
        nodes: list[list] = []

        def part(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            size = rows[docs + 1] - rows[docs]
            at = np.concatenate(([0], np.cumsum(size)))
            i = np.repeat(rows[docs] - at[:-1], size) + np.arange(at[-1])
            return at[:-1], terms[i], values[i].astype(float)

        def far(docs: np.ndarray, at: np.ndarray, t: np.ndarray, v: np.ndarray, one: int) -> np.ndarray:
            """Squared distance of each document to the given one."""
            dense = np.zeros(n_terms)
            dense[terms[rows[one] : rows[one + 1]]] = values[rows[one] : rows[one + 1]]
            return square[docs] + square[one] - 2 * np.add.reduceat(v * dense[t], at)

        stack = [(0, len(ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            if parent >= 0:
                nodes[parent][2] = len(nodes)
            docs = order[lo:hi]
            at, t, v = part(docs)
            coord = np.unique(t)
            place = np.searchsorted(coord, t)
            centre = np.bincount(place, v) / len(docs)
            top = np.zeros(len(coord))
            np.maximum.at(top, place, v)
            own = float(centre @ centre)
            apart = square[docs] + own - 2 * np.add.reduceat(v * centre[place], at)
            radius = math.sqrt(max(0.0, float(apart.max())) + 1e-12 * (float(square[docs].max()) + own))
            nodes.append([lo, hi, 0, radius, coord, centre, top])
            if len(docs) <= LEAF:
                continue
            a = docs[int(np.argmax(apart))]
            to_a = far(docs, at, t, v, a)
            to_b = far(docs, at, t, v, docs[int(np.argmax(to_a))])
            side = to_a - to_b
            if to_a.max() <= 1e-9 * square[a]:
                continue  # equal documents
            order[lo:hi] = docs[np.argsort(side, kind="stable")]
            mid = (lo + hi) // 2
            stack += [(mid, hi, len(nodes) - 1), (lo, mid, -1)]
        first, t, v = part(order)
        lo, hi, right, radius = (np.array([n[i] for n in nodes]) for i in range(4))
        at = np.concatenate(([0], np.cumsum([len(n[4]) for n in nodes])))
        coord, centre, top = (np.concatenate([n[i] for n in nodes]) for i in (4, 5, 6))
        made = {"ids": ids[order], "known": known[order], "rows": np.concatenate((first, [len(t)])), "terms": t, "values": v, "lo": lo, "hi": hi, "right": right, "radius": radius, "at": at, "coord": coord, "centre": centre, "top": top}
        return cls(**{k: made[k].astype(kind) for k, kind in cls.ARRAYS.items()})

    def by_coordinate(self, n_terms: int) -> None:
        """Order the nodes' coordinates so that those of a term stand together."""
        order = np.argsort(self.coord, kind="stable")
        node = np.repeat(np.arange(len(self.lo)), np.diff(self.at))[order]
        self.of_term, self.node = np.searchsorted(self.coord[order], np.arange(n_terms + 1)), node
        self.node_centre, self.node_top = self.centre[order], self.top[order].astype(float)

    def bounds(self, q_terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """No document of a node scores more against the query."""
        start, size = self.of_term[q_terms], self.of_term[q_terms + 1] - self.of_term[q_terms]
        i = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        w = np.repeat(q.astype(float), size)
        near = np.bincount(self.node[i], w * self.node_centre[i], len(self.lo)) + math.sqrt(float((q.astype(float) ** 2).sum())) * self.radius
        top = np.bincount(self.node[i], w * self.node_top[i], len(self.lo))
        return np.minimum(near, top) * (1 + MARGIN) + LEAST

    def search(self, q_terms: np.ndarray, q: np.ndarray, dense: np.ndarray, best: list, k: int) -> int:
        """Push the tree's documents into ``best``, a heap of the k best (score, known, -id); the leaves scored."""
        bounds, scored = self.bounds(q_terms, q).tolist(), 0
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                break
            if self.right[node]:
                heapq.heappush(heap, (max(bound, -bounds[node + 1]), node + 1))
                heapq.heappush(heap, (max(bound, -bounds[self.right[node]]), int(self.right[node])))
                continue
            scored += 1
            lo, hi = int(self.lo[node]), int(self.hi[node])
            a, z = int(self.rows[lo]), int(self.rows[hi])
            scores = np.add.reduceat(self.values[a:z] * dense[self.terms[a:z]], self.rows[lo:hi] - a)
            for j in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                found = (int(scores[j]), int(self.known[lo + j]), -int(self.ids[lo + j]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return scored


TREE = ", ".join(f"{name} binary" for name in Tree.ARRAYS)


def forest(counts: DataFrame, n_docs: int, n_terms: int, n_coords: int, tree_docs: int = 4096) -> DataFrame:
    """One row for each tree over the rows of ``counted``."""

    def built(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
        at = terms.offsets.to_numpy().astype(np.int64)
        tf = tfs.values.to_numpy().astype(np.int64)[at[0] : at[-1]]
        n = np.repeat(t.column("n").to_numpy(), np.diff(at))
        ids = t.column("doc_id")
        tree = Tree.build(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), at - at[0], terms.values.to_numpy()[at[0] : at[-1]].astype(np.int64), values_of(n, tf, n_docs, n_terms), n_coords)
        return pa.RecordBatch.from_arrays([pa.array([getattr(tree, k).tobytes()], pa.binary()) for k in Tree.ARRAYS], list(Tree.ARRAYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for s in range(0, batch.num_rows, tree_docs):
                held.append(batch.slice(s, tree_docs))
                if sum(b.num_rows for b in held) >= tree_docs:
                    yield built(held)
                    held = []
        if held:
            yield built(held)

    return counts.filter(F.size("terms") > 0).mapInArrow(run, TREE)


def searched(trees: DataFrame, queries: Broadcast, n_coords: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents of each partition for each query (item, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {item: [] for item, _, _ in queries.value}
        dense = np.zeros(n_coords, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                tree = Tree(**{name: np.frombuffer(batch.column(name)[r].as_buffer(), kind) for name, kind in Tree.ARRAYS.items()})
                tree.by_coordinate(n_coords)
                for item, terms, weights in queries.value:
                    dense[terms] = weights
                    tree.search(terms, weights, dense, best[item], k)
                    dense[terms] = 0
        rows = [(item, -minus if known else None, score) for item, found in best.items() for score, known, minus in found]
        item, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return trees.mapInArrow(run, "item int, doc_id long, score long")


def best_of(rows: DataFrame, k: int, salts: int) -> DataFrame:
    """The k best rows of each item with their rank: within salts first, so no task has all rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k) if salts > 1 else salted
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("salt")


def blocks_of(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[Row]]:
    """Items (item_id, text) a block at a time; no more reaches the driver at once than a partition and a block."""
    block, size = [], 0
    for row in items.toLocalIterator():
        length = 4 * len(row["text"] or "")
        if block and (len(block) == block_items or size + length > block_bytes):
            yield block
            block, size = [], 0
        block.append(row)
        size += length
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, k: int = 20, block_items: int = 1024, block_bytes: int = 4 << 20, tree_docs: int = 4096) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, ties by doc_id."""
    spark, folder = documents.sparkSession, shared_dir(documents.sparkSession)
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    name = items.schema["item_id"].dataType.simpleString()
    kind = f"item_id {name}, rank int, doc_id long, score long"
    parts = 0
    for block in blocks_of(items, block_items, block_bytes):
        own = [np.unique(h, return_counts=True) for h in term_hashes([r["text"] or "" for r in block])]
        terms = np.unique(np.concatenate([h for h, _ in own]).astype(U))
        counts = stage(counted(documents, spark.sparkContext.broadcast(terms)), f"counts-{parts}", folder)
        total = counts.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
        df = np.zeros(len(terms), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # the block's terms at most
            df[r["t"]] = r["df"]
        n_docs, n_terms = total["n_docs"], max(1, total["n_terms"] or 0)
        weights = weights_of(df, n_docs)
        queries = []
        for i, (hashes, times) in enumerate(own):
            at = np.searchsorted(terms, hashes)
            held = df[at] > 0
            if held.any():
                queries.append((i, at[held], weights[at[held]] * times[held]))
        trees = stage(forest(counts, n_docs, n_terms, len(terms), tree_docs), f"trees-{parts}", folder)
        found = searched(trees, spark.sparkContext.broadcast(queries), len(terms), k)
        salts = math.ceil(math.sqrt(trees.rdd.getNumPartitions()))
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {name}"))
        best_of(found, k, salts).join(names, "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/found/{parts}")
        parts += 1
    return spark.read.schema(kind).parquet(*[f"{folder}/found/{i}" for i in range(parts)]) if parts else spark.createDataFrame([], kind)
