"""Quality scores learned from preference pairs (Bradley-Terry).

Each labelled good document is preferred to labelled bad ones. The model is a
linear score of text features: hashed character trigrams and hashed words, as
roots of their shares, and a few ratios of form. It is fitted by the logistic
loss on the feature differences of the pairs; the cut is a quantile of the
training scores, at the share of bad documents among the labelled ones. Scores
are mapped so that the cut is ``CUT`` in (0, 1).

The fit uses at most ``max_labelled`` labelled ids (those of the least hash),
one text of each, in one task; scoring covers all documents.

Defined cases: null text is scored as empty text; repeated rows are scored
each; of several texts of a labelled id the least is learned from; documents
without label are only scored; labels, lang, source and doc_id are no features;
with labels of one class only every score is above the cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._text import U, Bytes, Words, mix, slices

CUT = 0.7
GRAMS, WORDS = 512, 512
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_OTHER = (np.arange(256) < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP)
FORM = 9
N_FEATURES = GRAMS + WORDS + FORM


def _shares(doc: np.ndarray, slot: np.ndarray, n: int, size: int) -> np.ndarray:
    """Roots of the shares of slots within each document."""
    counts = np.bincount(doc * size + slot, minlength=n * size).reshape(n, size).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def features(texts: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) of whole texts."""
    own, n = Bytes(texts), len(texts)
    words, size = Words(own), np.diff(own.at)
    doc = np.repeat(np.arange(n), size)
    buf = own.buf.astype(U)
    gram = mix((buf[:-2] << U(16)) | (buf[1:-1] << U(8)) | buf[2:]) if len(buf) > 2 else np.zeros(0, U)
    inside = np.flatnonzero(doc[: len(gram)] == doc[2:])
    grams = _shares(doc[inside], (gram[inside] >> U(40)).astype(np.int64) % GRAMS, n, GRAMS)
    count = np.diff(words.at)
    word_doc = np.repeat(np.arange(n), count)
    hashed = _shares(word_doc, (words.hash >> U(40)).astype(np.int64) % WORDS, n, WORDS)
    key = np.unique(np.stack((word_doc.astype(U), words.hash), axis=1), axis=0)[:, 0].astype(np.int64) if len(word_doc) else word_doc
    again = (words.hash[1:] == words.hash[:-1]) & (word_doc[1:] == word_doc[:-1]) if len(word_doc) else np.zeros(0, bool)
    letters, k = np.maximum(size, 1), np.maximum(count, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.bincount(doc, kind[own.buf], minlength=n) / letters

    form = [share(kind) for kind in (_UPPER, _LOWER, _DIGIT, _STOP, _OTHER)]
    form += [np.log1p(count) / 10, np.minimum(size / k, 30) / 30, np.bincount(key, minlength=n) / k, np.bincount(word_doc[1:][again], minlength=n) / k]
    return np.concatenate((grams, hashed, np.stack(form, axis=1)), axis=1).astype(np.float32)


def fit_pairs(x: np.ndarray, label: np.ndarray, partners: int = 8, rounds: int = 25, decay: float = 3e-3, seed: int = 7, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, mean, scale, cut): Bradley-Terry over good-bad pairs by Newton steps; cut by score quantile."""
    mean, scale = x.mean(0), x.std(0) + 1e-4
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), mean, scale, 0.0
    draw = np.random.default_rng(seed)
    small, large = (bad, good) if len(bad) <= len(good) else (good, bad)
    own, other = np.repeat(small, partners), draw.choice(large, len(small) * partners)
    own, other = np.concatenate((own, draw.choice(small, len(large)))), np.concatenate((other, large))
    better, worse = (other, own) if small is bad else (own, other)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        grad, hess = decay * w, decay * np.eye(len(w))
        for start in range(0, len(better), block):
            diff = z[better[start : start + block]] - z[worse[start : start + block]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
            grad -= diff.T @ p / len(better)
            hess += (diff * (p * (1 - p))[:, None]).T @ diff / len(better)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = z @ w
    low, high = np.quantile(scores, [max(0, len(bad) / len(label) - 1 / len(label)), min(1, len(bad) / len(label) + 1 / len(label))])
    return w, mean, scale, float((low + high) / 2)


def fitted(documents: DataFrame, labels: DataFrame, max_labelled: int) -> tuple:
    """The model, fitted in one task on the bounded sample of labelled documents that are not held out."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (part != 2))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the bound of what is broadcast
    learn = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for b in slices(batch, "text"):
                parts.append((b.column("doc_id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(), features(b.column("text"))))
        if parts:
            ids, label, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_pairs(x[order], label[order]))], pa.binary())], ["model"])

    found = learn.repartition(1).mapInArrow(run, "model binary").collect()
    zero = np.zeros(N_FEATURES)
    return pickle.loads(bytes(found[0]["model"])) if found else (zero, zero, np.ones(N_FEATURES), 0.0)


def scores_of(model: tuple, texts: pa.Array) -> np.ndarray:
    w, mean, scale, cut = model
    raw = np.clip((features(texts) - mean) / scale, -8, 8) @ w - cut
    return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)) + 1e-9, -40, 40)))


def quality_scores(documents: DataFrame, labels: DataFrame, max_labelled: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, max_labelled))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores_of(shared.value, b.column("text")))], ["doc_id", "score"])

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
