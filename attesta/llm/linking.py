"""Classes of alike texts from sketched bands: every link between members of a band, without all pairs.

Equal texts (in words) are one node. Nodes that share a band are compared in two
steps, both verified on the shingles of the texts themselves:

1. Every member of a band meets the band's best-connected node. That joins most
   of a group of copies, with one pair for each member.
2. In bands that still hold several components, each pair of different
   components that may be alike shares one of its rarest shingles (prefix
   filter: texts of weights v and w and similarity t share t / (1 + t) * (v + w)).
   Those shingles are joined and what the filter leaves is verified, so that no
   link between members of a band is given up, however large the band.

Pairs of one component are never looked at again, so a group costs about one
pair for each member; the rest are texts that only resemble each other, whose
rare shingles tell them apart.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import release, stage
from attesta.llm._text import U, Bytes, Words, shingles, slices
from attesta.llm.graph import connected_components

WORDS, FEATURE_BITS, SLOT_BITS = 5, 44, 18
SLOTS = 1 << SLOT_BITS
#: Shingles of fewer than one in so many documents weigh the same.
RAREST = 1024


class Bags:
    """Distinct shingles of texts with their counts: sorted ``feature``, ``tf``, bounds ``at``."""

    def __init__(self, texts: pa.Array):
        self.words = Words(Bytes(texts))
        h, at = shingles(self.words, WORDS)
        doc = np.repeat(np.arange(len(at) - 1, dtype=U), np.diff(at))
        key = np.sort((doc << U(FEATURE_BITS)) | (h >> U(64 - FEATURE_BITS)))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.tf = np.diff(np.concatenate((first, [len(key)])))
        self.feature = key[first] & U((1 << FEATURE_BITS) - 1)
        self.doc = (key[first] >> U(FEATURE_BITS)).astype(np.int64)
        self.at = np.searchsorted(self.doc, np.arange(len(at)))

    def slot(self) -> np.ndarray:
        return (self.feature >> U(FEATURE_BITS - SLOT_BITS)).astype(np.int64)

    def nodes(self) -> list[bytes | None]:
        """A digest of each text's words; None without words."""
        h, at = self.words.hash, self.words.at
        return [hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(at[:-1], at[1:], strict=True)]


class Weights:
    """TF-IDF of hashed shingles: TF times 1 + ln(N / df), where df is at least N / RAREST.

    Document frequencies are counted over all documents in a table of SLOTS hashed
    shingles. What an average slot holds of other shingles is taken off, and grows
    with N as N / RAREST does, so weights mean the same at every size.
    """

    def __init__(self, n_docs: int, df: np.ndarray):
        n = max(1, n_docs)
        share = np.maximum(df - np.median(df), 1) / n
        self.idf = (1 - np.log(np.clip(share, 1 / RAREST, 1))).astype(np.float32)
        self.log_idf, self.log_tf = np.log(self.idf), np.log(np.arange(1, 1 << 16, dtype=np.float32))

    def of(self, bags: Bags) -> np.ndarray:
        return self.idf[bags.slot()].astype(np.float64) * bags.tf

    def logs(self, bags: Bags) -> np.ndarray:
        return self.log_idf[bags.slot()] + self.log_tf[np.minimum(bags.tf, len(self.log_tf)) - 1]


class Flat(Weights):
    """Shingles as a set; the IDF only says which are rare."""

    def of(self, bags: Bags) -> np.ndarray:
        return np.ones(len(bags.feature))


def document_frequencies(documents: DataFrame, kind: type[Weights] = Weights) -> Weights:
    """Counts of documents for SLOTS hashed shingles: a table of fixed size reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for b in slices(batch, "text"):
                df[:SLOTS] += np.bincount(Bags(b.column("text")).slot(), minlength=SLOTS)
                n += b.num_rows
        df[SLOTS] = n
        slot = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(df[slot])], ["slot", "n"])

    rows = documents.select("text").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS + 1)
    df[rows["slot"]] = rows["n"]
    return kind(int(df[SLOTS]), df[:SLOTS])


def weighted_jaccard(weights: Weights, left: pa.Array, right: pa.Array) -> np.ndarray:
    """Sum of least over sum of greatest weights, of each pair of texts."""
    a, b = Bags(left), Bags(right)
    key = np.concatenate([(x.doc.astype(U) << U(FEATURE_BITS)) | x.feature for x in (a, b)])
    weight = np.concatenate((weights.of(a), weights.of(b)))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    pair = (key >> U(FEATURE_BITS)).astype(np.int64)
    both = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), minlength=len(left))
    total = np.bincount(pair, weight, minlength=len(left))
    return both / np.maximum(total - both, 1e-12)


class Texts:
    """Texts of nodes, one of each, written once in buckets by node: joins on the node do not move them."""

    def __init__(self, rows: DataFrame, folder: str):
        self.spark, self.name, self.path = rows.sparkSession, f"texts_{uuid.uuid4().hex}", f"{folder}/texts"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = rows.repartition(buckets, "node").dropDuplicates(["node"]).write.bucketBy(buckets, "node").sortBy("node")
        writer.option("compression", "zstd").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        release(self.spark, self.path)


#: The longs of the bit set that keeps texts at home which no node wants: 2 MB, whatever the size of the corpus.
BIT_SET = 1 << 18


def _wanted_bits(keys: DataFrame) -> np.ndarray:
    """Bit set of the text_keys; at most BIT_SET rows reach the driver."""
    slot, bit = F.shiftrightunsigned("text_key", 46), F.shiftrightunsigned("text_key", 40).bitwiseAND(63).cast("int")
    rows = keys.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(BIT_SET, np.int64)
    bits[rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return bits.view(U)


def _texts_of(wanted: DataFrame, nodes: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """(node, text) of the wanted nodes, from the first row of each; repeated rows bring a text several times.

    Texts whose key is not in the bit set of the wanted ones are dropped before the join, so they are not moved.
    """
    spark = documents.sparkSession
    named = stage(nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "named", folder)
    shared = spark.sparkContext.broadcast(_wanted_bits(named.select(F.col("first_key").alias("text_key"))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("text_key").to_numpy().view(U)
            yield b.filter(pa.array(((shared.value[key >> U(46)] >> ((key >> U(40)) & U(63))) & U(1)).astype(bool)))

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(near, "doc_id long, text_key long, text string")
    return docs.join(named, docs.doc_id.eqNullSafe(F.col("first_id")) & (docs.text_key == F.col("first_key"))).select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, salt_rows: int = 256) -> DataFrame:
    """pairs (x, y) of nodes with their weighted Jaccard similarity ``sim``.

    A node y that meets more than ``salt_rows`` is repeated under as many salts as it takes.
    """
    hot = pairs.groupBy("y").agg(F.count("*").alias("n")).filter(F.col("n") > salt_rows).select("y", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(hot, "y", "left").select("x", "y", F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt"))
    ys = texts.join(hot, texts.node == hot.y, "left").select(F.col("node").alias("y"), F.col("text").alias("ty"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = salted.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").join(ys, ["y", "salt"]).select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "tx"):
                for start in range(0, b.num_rows, 512):
                    c = b.slice(start, 512)
                    yield pa.RecordBatch.from_arrays([c.column("x"), c.column("y"), pa.array(weighted_jaccard(shared.value, c.column("tx"), c.column("ty")))], ["x", "y", "sim"])

    return both.mapInArrow(run, "x binary, y binary, sim double")


def prefixes(open_texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """(x, label, weight, feature, rest) of (x, label, text): the shingles that may be the rarest one that x
    shares with a similar text. Shingles stand in one order for all texts, rare ones first; rest is the weight
    from there to the end, which must be at least what two similar texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for b in slices(batch, "text"):
                bags = Bags(b.column("text"))
                order = np.lexsort((bags.feature, -weights.idf[bags.slot()], bags.doc))
                doc, feature, w = bags.doc[order], bags.feature[order], weights.of(bags)[order]
                total = np.bincount(doc, w, minlength=b.num_rows)
                done = np.cumsum(w)
                before = np.concatenate(([0.0], done))[bags.at[:-1]]
                rest = total[doc] - (done - w - before[doc])
                i = np.flatnonzero(rest >= threshold * total[doc] * (1 - 1e-6))
                d = pa.array(doc[i])
                arrays = [b.column("x").take(d), b.column("label").take(d), pa.array(total[doc[i]]), pa.array(feature[i].astype(np.int64)), pa.array(rest[i])]
                yield pa.RecordBatch.from_arrays(arrays, ["x", "label", "weight", "feature", "rest"])

    return open_texts.mapInArrow(run, "x binary, label binary, weight double, feature long, rest double")


def _close(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of different labels among rows of ``prefixes`` that may be similar."""
    one = rows.select("feature", *[F.col(c).alias(f"p_{c}") for c in ("x", "label", "weight", "rest")])
    two = rows.select("feature", *[F.col(c).alias(f"q_{c}") for c in ("x", "label", "weight", "rest")])
    share = F.lit(threshold / (1 + threshold) * (1 - 1e-6)) * (F.col("p_weight") + F.col("q_weight"))
    near = F.least("p_weight", "q_weight") >= threshold * (1 - 1e-6) * F.greatest("p_weight", "q_weight")
    may = (F.col("p_x") < F.col("q_x")) & (F.col("p_label") != F.col("q_label")) & near & (F.least("p_rest", "q_rest") >= share)
    return one.join(two, "feature").filter(may).select(F.col("p_x").alias("x"), F.col("q_x").alias("y")).distinct()


def first_rows(rows: DataFrame) -> DataFrame:
    """(node, first, n_rows, bands) of each node of rows (uid, doc_id, text_key, node, bands)."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), "uid", "doc_id", "text_key")).alias("first")
    return rows.filter("node is not null").groupBy("node").agg(first, F.count("*").alias("n_rows"), F.first("bands").alias("bands"))


def links(nodes: DataFrame, documents: DataFrame, shared: Broadcast, threshold: float, folder: str) -> DataFrame:
    """(x, y) that connect every two nodes which share a band and are similar, through others at least."""
    spark = documents.sparkSession
    each = nodes.select("node", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(each.join(sizes, "band"), "members", folder)
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("y"))
    met = stage(members.join(leaders, "band").select("band", F.col("node").alias("x"), "y"), "met", folder)
    release(spark)
    texts = Texts(_texts_of(members.select("node").distinct(), nodes, documents, folder), folder)
    release(spark, f"{folder}/members")
    star = stage(verified(met.filter("x <> y").select("x", "y").distinct(), texts.table(), shared).filter(F.col("sim") >= threshold).select("x", "y"), "star", folder)
    release(spark)
    labels = connected_components(star.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = met.join(labels.withColumnRenamed("node", "x"), "x", "left").select("band", "x", F.coalesce("label", "x").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    undecided = stage(placed.join(mixed, "band").select("x", "label").distinct(), "undecided", folder)
    found = texts.table()
    rows = prefixes(found.join(undecided, found.node == undecided.x).select("x", "label", "text"), shared, threshold)
    close = stage(_close(rows, threshold), "close", folder)
    release(spark, f"{folder}/met")
    rest = stage(verified(close, texts.table(), shared).filter(F.col("sim") >= threshold).select("x", "y"), "rest", folder)
    texts.drop()
    return star.unionByName(rest)


def node_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, class_id, class_uid) of nodes with several rows or a link: the row of the least id of their class."""
    labels = connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = nodes.select("node", "first", "n_rows").join(labels, "node", "left").filter("label is not null or n_rows > 1").withColumn("label", F.coalesce("label", "node"))
    kept = named.groupBy("label").agg(F.min("first").alias("kept"))
    return named.join(kept, "label").select("node", F.col("kept.doc_id").alias("class_id"), F.col("kept.uid").alias("class_uid"))
