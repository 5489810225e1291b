"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Texts are bags of five-word shingles weighted by TF times IDF (``linking.Weights``;
document frequencies are counted over all documents, for hashed shingles). Each
text gets ``SAMPLES`` consistent weighted samples; the least value of a sample's
scale, with the hash of its shingle, stands for the sampled shingle and its level.
Bands of ``ROWS`` samples are joined, and links between members of a band are
verified by the weighted Jaccard similarity of the texts (module ``linking``).
A class is a connected component of links.

Defined cases: null and empty texts, and texts without words, are classes of
their own rows and always kept; texts of one to four words are one shingle;
repeated rows fall in one class, of which one row is kept; other columns are
ignored; a null doc_id is a row like any other, but never names a class unless
no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import release, shared_dir, stage
from attesta.llm._text import U, mix, slices
from attesta.llm.linking import Bags, document_frequencies, first_rows, links, node_classes

THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
TABLE = 1 << 15
f4 = np.float32


@lru_cache(maxsize=1)
def _randoms() -> np.ndarray:
    """(TABLE, 3, SAMPLES): r and ln c are Gamma(2, 1) draws, b is uniform; a shingle's row is its hash."""

    def uniform(salt: int) -> np.ndarray:
        h = mix(np.arange(TABLE * SAMPLES, dtype=U) + U(salt << 40))
        return ((h >> U(11)).astype(np.float64) + 0.5) / 2**53

    gamma = [-np.log(uniform(s)) - np.log(uniform(s + 1)) for s in (1, 3)]
    out = np.empty((TABLE, 3, SAMPLES), f4)
    out[:, 0], out[:, 1] = gamma[0].reshape(TABLE, SAMPLES), uniform(5).reshape(TABLE, SAMPLES)
    out[:, 2] = np.log(gamma[1]).reshape(TABLE, SAMPLES) - out[:, 0]
    return out


def samples(bags: Bags, log_weight: np.ndarray, block: int = 1024) -> np.ndarray:
    """(texts, SAMPLES) of each sample: least ln a, in the upper half as ordered bits, and its shingle's hash.

    Shingles that share a row of the table differ in the hash, which also decides
    between them; all ones for texts without words.
    """
    table = _randoms()
    out = np.full((len(bags.at) - 1, SAMPLES), ~U(0), U)
    mixed = mix(bags.feature)
    row, own_hash = (mixed >> U(40)).astype(np.int64) % TABLE, mixed & U(0xFFFFFFFF)
    for start in range(0, len(row), block):
        own = table[row[start : start + block]]
        r = own[:, 0]
        t = log_weight[start : start + block, None] / r
        t += own[:, 1]
        np.floor(t, out=t)
        t -= own[:, 1]
        t *= r
        np.subtract(own[:, 2], t, out=t)
        doc = bags.doc[start : start + block]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        sign = t.view(np.int32) >> 31
        order = t.view(np.uint32) ^ (sign.view(np.uint32) | np.uint32(1 << 31))
        value = (order.astype(U) << U(32)) | own_hash[start : start + block, None]
        least = np.minimum.reduceat(value, first, axis=0)
        out[doc[first]] = np.minimum(out[doc[first]], least)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands of samples."""
    bits = values.reshape(len(values), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0x632BE59BD9B4E019), (len(values), BANDS)).copy()
    for k in range(ROWS):
        h = mix(h + mix(bits[:, :, k] * U(0x9E3779B97F4A7C15)))
    return h.view(np.int64)


def sketched(documents: DataFrame, shared) -> DataFrame:
    """(uid, doc_id, text_key, node, bands) of each row; node is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for b in slices(batch, "text"):
                bags = Bags(b.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands(samples(bags, weights.logs(bags))).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("text_key"), pa.array(bags.nodes(), pa.binary()), lists], ["uid", "doc_id", "text_key", "node", "bands"])

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, text_key long, node binary, bands array<long>")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, kept, repeat) of each row: its class and whether it stays.

    repeat: another row has the same id and text, so that these do not tell the rows apart.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    shared = spark.sparkContext.broadcast(document_frequencies(documents))
    rows = stage(sketched(documents, shared), "rows", folder)
    nodes = stage(first_rows(rows), "nodes", folder)
    classes = node_classes(nodes, links(nodes, documents, shared, threshold, folder))
    release(spark)
    out = rows.select("uid", "doc_id", "text_key", "node").join(classes, "node", "left")
    again = rows.filter("node is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"))
    out = out.join(again, out.doc_id.eqNullSafe(again.again_id) & (out.text_key == again.again_key), "left")
    alone = F.col("class_uid").isNull()
    kept = alone | (F.col("uid") == F.col("class_uid"))
    return out.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"), F.col("again_key").isNotNull().alias("repeat"))
