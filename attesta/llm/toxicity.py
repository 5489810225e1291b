"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word embedding and the mean of hashed
embeddings of its character trigrams; a forward and a backward GRU read windows
of ``SPAN`` words, one every ``STEP`` words, attention pools their states and a
logistic unit scores the window. All windows of the whole text are scored; the
document has the highest window score. The network is trained in numpy on at
most ``max_labelled`` labelled documents of each class (those of the least
hash); in each epoch a document is represented by its highest window.

Defined cases: null text is empty text, which is one window of padding;
repeated rows are scored each; of several texts of a labelled id the least is learned from; labels, lang, source and doc_id are no inputs;
without labels of both classes every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm._text import U, Bytes, Words, mix, slices

SPAN, STEP = 32, 24
#: Steps of an epoch of training.
STEPS = 6
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 1 << 15, 1 << 13, 8, 8
f4 = np.float32


def _scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values by row number."""
    return np.stack([np.bincount(at, values[:, j], minlength=rows) for j in range(values.shape[1])], axis=1).astype(f4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class _Joined:
    """Words of many texts, found in parts of about a megabyte: what numpy holds at once stays small."""

    def __init__(self, texts: pa.Array, part: int = 256):
        parts = [Words(Bytes(texts.slice(i, part))) for i in range(0, max(len(texts), 1), part)]
        shift = np.cumsum([0, *(len(w.low) for w in parts)])
        count = np.cumsum([0, *(len(w.hash) for w in parts)])
        self.hash, self.low = np.concatenate([w.hash for w in parts]), np.concatenate([w.low for w in parts])
        self.start = np.concatenate([w.start + s for w, s in zip(parts, shift[:-1], strict=True)])
        self.end = np.concatenate([w.end + s for w, s in zip(parts, shift[:-1], strict=True)])
        self.at = np.concatenate([*(w.at[:-1] + n for w, n in zip(parts, count[:-1], strict=True)), count[-1:]])


class Tokens:
    """Distinct words of texts and the windows over them, as rows of word numbers (0 is padding)."""

    def __init__(self, texts: pa.Array):
        words = _Joined(texts)
        distinct, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.word = (distinct >> U(20)).astype(np.int64) % WORD_ROWS
        start, size = words.start[first], (words.end - words.start)[first]
        # trigrams of "^word$"; a word of one letter has one
        place = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        low = np.concatenate((np.array([1], np.uint8), words.low, np.array([2], np.uint8))).astype(U)
        head, tail = np.repeat(start, size), np.repeat(start + size - 1, size)
        left = np.where(place == head, U(1), low[place])
        right = np.where(place == tail, U(2), low[np.minimum(place + 2, len(low) - 1)])
        self.gram = (mix((left << U(16)) | (low[place + 1] << U(8)) | right) >> U(40)).astype(np.int64) % CHAR_ROWS
        self.size, self.owner = np.maximum(size, 1), np.repeat(np.arange(len(size)), size)
        count = np.diff(words.at)
        self.windows_of = np.maximum(1, -(-(count - (SPAN - STEP)) // STEP))
        doc = np.repeat(np.arange(len(count)), self.windows_of)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(self.windows_of) - self.windows_of, self.windows_of)
        at = (words.at[:-1][doc] + nth * STEP)[:, None] + np.arange(SPAN)
        inside = at < words.at[1:][doc][:, None]
        number = np.concatenate((number + 1, [0]))
        self.windows = np.where(inside, number[np.minimum(at, len(number) - 1)], 0)
        self.bounds = np.concatenate(([0], np.cumsum(self.windows_of)))


class Part:
    """Some windows of Tokens, with their words alone."""

    def __init__(self, t: Tokens, chosen: np.ndarray):
        used, number = np.unique(t.windows[chosen], return_inverse=True)
        used = used[used > 0] - 1
        number = number.reshape(-1, SPAN)
        self.windows = number if 0 in t.windows[chosen] else number + 1
        self.word, self.size = t.word[used], t.size[used]
        start = (np.cumsum(t.size) - t.size)[used]
        self.owner = np.repeat(np.arange(len(used)), self.size)
        self.gram = t.gram[np.repeat(start - np.cumsum(self.size) + self.size, self.size) + np.arange(self.size.sum())]


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        h, d = HIDDEN, WIDTH

        def normal(*shape: int, scale: float) -> np.ndarray:
            return draw.normal(0, scale, shape).astype(f4)

        self.p = {"word": np.zeros((WORD_ROWS, d), f4), "char": np.zeros((CHAR_ROWS, d), f4), "att": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, f4)}
        for side in "fb":
            self.p |= {f"in_{side}": normal(d, 3 * h, scale=0.5), f"rec_{side}": normal(h, 3 * h, scale=0.3), f"b_{side}": np.zeros(3 * h, f4)}

    def embed(self, t: Tokens | Part) -> np.ndarray:
        chars = np.zeros((len(t.word) + 1, WIDTH), f4)
        if len(t.word):
            ends = np.cumsum(t.size)
            chars[1:] = np.add.reduceat(self.p["char"][t.gram], ends - t.size, axis=0) / t.size[:, None]
            chars[1:] += self.p["word"][t.word]
        return chars

    def _run(self, table: np.ndarray, windows: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (SPAN, windows, HIDDEN) of one direction; padding leaves the state as it is."""
        h, p = HIDDEN, self.p
        inputs = table @ p[f"in_{side}"] + p[f"b_{side}"]
        state, out = np.zeros((len(windows), h), f4), np.empty((SPAN, len(windows), h), f4)
        for t in range(SPAN) if side == "f" else range(SPAN - 1, -1, -1):
            ids = windows[:, t]
            x = inputs[ids]
            r = state @ p[f"rec_{side}"]
            gates = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            z, g = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + g * r[:, 2 * h :])
            live = (ids > 0)[:, None]
            following = np.where(live, state + z * (new - state), state)
            if keep is not None:
                keep.append((t, ids, state, z, g, new, r[:, 2 * h :], live))
            state = out[t] = following
        return out

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        steps = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self._run(table, windows, s, steps[s]) for s in "fb"], axis=2)
        energy = states @ self.p["att"]
        energy = np.where(windows.T > 0, energy, f4(-1e4))
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep.update(steps=steps, states=states, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, t: Part, target: np.ndarray, importance: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted logistic loss, and the loss."""
        table, windows, kept, h, p = self.embed(t), t.windows, {}, HIDDEN, self.p
        logit = self.forward(table, windows, kept)
        share = importance / importance.sum()
        loss = float((share * (np.logaddexp(0, logit) - target * logit)).sum())
        d = (share * (_sigmoid(logit) - target)).astype(f4)
        grad = {"out": kept["pooled"].T @ d, "bias": np.array([d.sum()], f4)}
        d_pooled = d[:, None] * p["out"]
        states, weight = kept["states"], kept["weight"]
        d_weight = (states * d_pooled).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        d_energy = np.where(windows.T > 0, d_energy, 0).astype(f4)
        grad["att"] = np.einsum("tnk,tn->k", states, d_energy)
        d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * p["att"]
        d_table = np.zeros_like(table)
        for side, lo in (("f", 0), ("b", h)):
            rec, w_in = p[f"rec_{side}"], p[f"in_{side}"]
            d_rec, d_b, seen = np.zeros_like(rec), np.zeros(3 * h, f4), []
            carry = np.zeros((len(windows), h), f4)
            for step, ids, state, z, g, new, r, live in reversed(kept["steps"][side]):
                total = carry + d_states[step, :, lo : lo + h]
                own = np.where(live, total, 0)
                d_new = own * z * (1 - new * new)
                d_z = own * (new - state) * z * (1 - z)
                d_g = d_new * r * g * (1 - g)
                d_x = np.concatenate((d_z, d_g, d_new), axis=1)
                d_r = np.concatenate((d_z, d_g, d_new * g), axis=1)
                carry = np.where(live, total * (1 - z), total) + d_r @ rec.T
                d_rec += state.T @ d_r
                d_b += d_x.sum(0)
                seen.append((ids, d_x))
            d_in = _scatter(np.concatenate([i for i, _ in seen]), np.concatenate([x for _, x in seen]), len(table))
            d_table += d_in @ w_in.T
            grad |= {f"in_{side}": table.T @ d_in, f"rec_{side}": d_rec, f"b_{side}": d_b}
        grad["word"] = _scatter(t.word, d_table[1:], WORD_ROWS)
        grad["char"] = _scatter(t.gram, (d_table[1:] / t.size[:, None])[t.owner], CHAR_ROWS)
        return grad, loss

    def logits(self, table: np.ndarray, windows: np.ndarray, block: int = 2048) -> np.ndarray:
        """Logit of each window: as ``forward``, in place, block by block, for scoring."""
        h, p = HIDDEN, self.p
        tables = {}
        for side in "fb":
            x = table @ p[f"in_{side}"] + p[f"b_{side}"]
            x[0, :h] = -80  # padding: the update gate is shut
            tables[side] = np.ascontiguousarray(x[:, : 2 * h]), np.ascontiguousarray(2 * x[:, 2 * h :])
        out = np.empty(len(windows), f4)
        for start in range(0, len(windows), block):
            ids = np.ascontiguousarray(windows[start : start + block].T)
            energy, value = np.zeros(ids.shape, f4), np.zeros(ids.shape, f4)
            for side, lo in (("f", 0), ("b", h)):
                gate_in, new_in = tables[side]
                rec = p[f"rec_{side}"]
                gate_rec, new_rec = np.ascontiguousarray(rec[:, : 2 * h]), np.ascontiguousarray(2 * rec[:, 2 * h :])
                read = np.stack((p["att"][lo : lo + h], p["out"][lo : lo + h]), axis=1)
                state = np.zeros((ids.shape[1], h), f4)
                for t in range(SPAN) if side == "f" else range(SPAN - 1, -1, -1):
                    g = gate_in.take(ids[t], axis=0)
                    g += state @ gate_rec
                    np.negative(g, out=g)
                    np.exp(g, out=g)
                    g += 1
                    np.reciprocal(g, out=g)
                    n = state @ new_rec
                    n *= g[:, h:]
                    n += new_in.take(ids[t], axis=0)
                    np.negative(n, out=n)
                    np.exp(n, out=n)
                    n += 1
                    np.reciprocal(n, out=n)
                    n *= 2
                    n -= 1  # the hyperbolic tangent of half the argument
                    n -= state
                    n *= g[:, :h]
                    state += n
                    told = state @ read
                    energy[t] += told[:, 0]
                    value[t] += told[:, 1]
            energy[ids == 0] = -1e4
            weight = np.exp(energy - energy.max(0))
            out[start : start + block] = (weight * value).sum(0) / weight.sum(0) + p["bias"][0]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text: that of its highest window."""
        t = Tokens(texts)
        table = self.embed(t)
        logit = self.logits(table, t.windows)
        return _sigmoid(np.maximum.reduceat(logit, t.bounds[:-1]).astype(np.float64))


def train(texts: pa.Array, label: np.ndarray, epochs: int = 24, rate: float = 0.03, seed: int = 11) -> Network:
    """Adam over the highest window of each document; at first that of the most telling words."""
    net, t = Network(seed), Tokens(texts)
    doc = np.repeat(np.arange(len(label)), t.windows_of)
    many = len(t.word) + 1
    seen = np.unique(np.repeat(doc, SPAN) * many + t.windows.ravel())
    held = np.stack([np.bincount(seen[label[seen // many] == k] % many, minlength=many) for k in (0, 1)]).astype(float)
    del seen
    telling = np.log((held[1] + 0.5) / (label.sum() + 1)) - np.log((held[0] + 0.5) / ((1 - label).sum() + 1))
    telling[(held.sum(0) < 3)] = 0  # too rare to tell
    telling[0] = 0
    net.p["word"][t.word, 0] = np.clip(telling[1:], 0, 4) / 2  # the start of the word embeddings
    logit = np.clip(telling, 0, None)[t.windows].max(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    best = max(1.0, (len(label) - label.sum()) / max(1, label.sum()))
    importance = np.where(label == 1, best, 1.0)
    draw, n = np.random.default_rng(seed), 0
    for epoch in range(1, epochs + 1):
        order = np.lexsort((logit, doc))
        top = order[t.bounds[1:] - 1]
        other = t.bounds[:-1] + draw.integers(0, t.windows_of)  # any window of a clean document is clean
        clean = np.flatnonzero(label == 0)
        chosen = np.concatenate((top, other[clean]))
        target, weight = np.concatenate((label, label[clean])), np.concatenate((importance, importance[clean]))
        for part in np.array_split(draw.permutation(len(chosen)), STEPS):
            grad, _ = net.gradient(Part(t, chosen[part]), target[part], weight[part])
            n += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)).astype(f4)
        if epoch % 4 == 1:
            table = net.embed(t)
            logit = net.logits(table, t.windows)
    return net


def fitted(documents: DataFrame, labels: DataFrame, max_labelled: int = 1500) -> Network | None:
    """The network, fitted on the labelled documents that are not held out."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (part != 0))
    order = (F.xxhash64("doc_id"), "doc_id")
    known = known.filter("label = 1").orderBy(*order).limit(max_labelled).unionByName(known.filter("label = 0").orderBy(*order).limit(max_labelled))
    learn = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.to_pandas() for b in batches if b.num_rows]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["doc_id", "label", "text"], kind="stable")
        label = rows["label"].to_numpy().astype(np.int64)
        if label.min() != label.max():
            net = train(pa.array(rows["text"], pa.large_string()), label)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["net"])

    found = learn.repartition(1).mapInArrow(run, "net binary").collect()  # the sample is bounded: one task trains on it
    if not found:
        return None
    net = Network()
    net.p = pickle.loads(bytes(found[0]["net"]))
    return net


def toxicity_scores(documents: DataFrame, labels: DataFrame, max_labelled: int = 1500, carry_key: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; with text_key if carry_key."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(fitted(documents, labels, max_labelled))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                own = net.scores(b.column("text")) if net else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(own)], ["doc_id", "text_key", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    out = rows.mapInArrow(scored, "doc_id long, text_key long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    keys = ["text_key"] if carry_key else []
    return out.select("doc_id", *keys, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
