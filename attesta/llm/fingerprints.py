"""MinHash fingerprints of documents, of their edited texts, and classes of alike documents.

A signature holds the least value of each of ``PERMUTATIONS`` multiply-shift
universal hashes over the five-word shingles of a text, computed in numpy for
many texts at once. A text of fewer words, but not none, is one shingle; a text
without words has an empty signature, which is like empty signatures only.
Signatures are cut into bands, which are joined in Spark; links are verified by
the Jaccard similarity of the shingle sets (module ``linking``).

Documents are dealt to partitions by ranges of their order, so ids may be sparse,
repeated or null; the last document of a partition meets the first of the next
in a second step over one row for each partition.

Defined cases: null text is empty text; documents are ordered by descending
doc_id, then text, null ids last; repeated rows are documents of their own;
other columns are ignored; a single document is its own next document; a text
without words is alike to none, and its alike_id is its own id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import release, shared_dir, stage
from attesta.llm._text import U, mix, segment_min, slices
from attesta.llm.linking import Bags, Flat, document_frequencies, first_rows, links, node_classes

PERMUTATIONS, BANDS = 64, 16
_seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
A, B = _seeds[:PERMUTATIONS] | U(1), _seeds[PERMUTATIONS:]
EMPTY = 0xFFFFFFFF


def signatures(texts: pa.Array, bags: Bags | None = None) -> np.ndarray:
    """(texts, PERMUTATIONS) of 32-bit minima; EMPTY throughout for texts without words."""
    bags = bags or Bags(texts)
    x = bags.feature >> U(12)
    out = np.empty((len(texts), PERMUTATIONS), dtype=np.uint32)
    for k in range(PERMUTATIONS):
        out[:, k] = segment_min((x * A[k] + B[k]) >> U(32), bags.at, EMPTY)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal permutations: the estimate of the Jaccard similarity."""
    return (a == b).mean(axis=-1)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def bands(fingerprint: Column) -> Column:
    """Array of hashes of the bands of a signature's text."""
    width = 8 * PERMUTATIONS // BANDS
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fingerprint, i * width + 1, width)) for i in range(BANDS)])


def edited(text: str, following: str) -> str:
    """text whose last third of code points is replaced by the first ones of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PRINTED = f"{RESULT}, uid long, text_key long, node binary, part int, kind string, text string"
NAMES = [c.split()[0] for c in PRINTED.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.string()]


def _results(ids: list, keys: list, texts: list[str], following: str, uid: int, part: int) -> pa.RecordBatch:
    """Rows of consecutive documents; ``following`` is the text after the last."""
    bags = Bags(pa.array([*texts, following], pa.large_string()))
    sig = signatures(bags.at[:-1], bags)
    changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
    own, new, n = sig[:-1], signatures(pa.array(changed, pa.large_string())), len(texts)
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        [as_text(s) for s in own], [as_text(s) for s in new], likeness(own, new), likeness(own, sig[1:]),
        np.arange(uid, uid + n), keys, bags.nodes()[:-1], [part] * n, ["row"] * n, [None] * n,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def _mark(kind: str, part: int, doc_id: int | None, key: int | None, text: str, uid: int) -> pa.RecordBatch:
    """The first or last document of a partition, with its text."""
    told = {"doc_id": doc_id, "text_key": key, "text": text, "uid": uid, "part": part, "kind": kind}
    return pa.RecordBatch.from_arrays([pa.array([told.get(c)], k) for c, k in zip(NAMES, KINDS, strict=True)], NAMES)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a partition's documents, in order, but the last, and marks of the first and the last."""
    part, held = TaskContext.get().partitionId(), None
    uid = part << 40
    for batch in batches:
        for b in slices(batch, "text", 1 << 20):
            ids, keys, texts = (b.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            if held is None:
                yield _mark("head", part, ids[0], keys[0], texts[0], uid)
            else:
                ids, keys, texts = [held[0], *ids], [held[1], *keys], [held[2], *texts]
            held = ids[-1], keys[-1], texts[-1]
            if len(ids) > 1:
                yield _results(ids[:-1], keys[:-1], texts[:-1], texts[-1], uid, part)
                uid += len(ids) - 1
    if held is not None:
        yield _mark("tail", part, *held, uid)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield _results([r["doc_id"]], [r["text_key"]], [r["text"]], r["following"], r["uid"], r["part"])


def printed(documents: DataFrame, folder: str) -> DataFrame:
    """The columns of RESULT, and uid, text_key and node, of every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.desc_nulls_last("doc_id"), F.asc("text"))
    # ranges are told by the start of a text: equal starts stay together, and whole texts do not reach the driver
    ranged = docs.repartitionByRange(order[0], F.substring("text", 1, 16)).sortWithinPartitions(*order)
    rows = stage(ranged.mapInArrow(_printed, PRINTED), "printed", folder)
    release(spark)
    parts = [r["part"] for r in rows.filter("kind = 'head'").select("part").orderBy("part").collect()]  # numbers of partitions
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    heads = rows.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = rows.filter("kind = 'tail'").select("part", "doc_id", "text_key", "uid", "text").join(following, "part").join(heads, "next").drop("next")
    ends = stage(tails.mapInArrow(_ended, PRINTED), "ends", folder)
    return rows.filter("kind = 'row'").unionByName(ends).drop("part", "kind", "text")


def fingerprint_report(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and alike_id: the least doc_id of the
    documents that links of Jaccard similarity ``threshold`` or more connect with it."""
    spark, folder = documents.sparkSession, shared_dir(documents.sparkSession)
    rows = printed(documents, folder)
    shared = spark.sparkContext.broadcast(document_frequencies(documents, Flat))
    nodes = stage(first_rows(rows.select("uid", "doc_id", "text_key", "node", bands(F.col("fingerprint")).alias("bands"))), "nodes", folder)
    classes = node_classes(nodes, links(nodes, documents, shared, threshold, folder)).select("node", "class_id", F.lit(True).alias("known"))
    out = rows.join(classes, "node", "left")
    return out.select(*[c.split()[0] for c in RESULT.split(", ")], F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("alike_id"))
