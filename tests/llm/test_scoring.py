import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attesta.llm import quality, toxicity
from tests.llm.common import empty, odd

BAD = ["idiot", "moron", "scum"]


def labelled(spark, n=240):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["ta", "ri", "mo", "len", "su"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scores, labels, name):
    rows = scores.join(labels, "doc_id").filter("held_out").select("predicted", name).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    scores = quality.quality_scores(docs, labels)
    assert accuracy(scores, labels, "quality") >= 0.95
    held = scores.filter("held_out").select("doc_id").collect()
    assert all(spark.range(1).select(F.crc32(F.lit(str(r[0])).cast("binary")) % 4).first()[0] == 2 for r in held[:3])


def test_quality_odd_rows(spark):
    _, labels = labelled(spark, 8)
    assert quality.quality_scores(odd(spark), labels).count() == 9
    assert quality.quality_scores(empty(spark), labels).count() == 0


def test_scores_are_those_of_each_text_alone(spark):
    docs, labels = labelled(spark, 60)
    docs = docs.unionByName(odd(spark).select("doc_id", "text"))
    model = quality.fitted(docs, labels, 8000)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.quality_scores(docs, labels).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, float(quality.scores_of(model, pa.array([r.text], pa.string()))[0])) for r in docs.collect())
    assert np.allclose([g[2] for g in got], [w[2] for w in want]) and [g[:2] for g in got] == [w[:2] for w in want]
    x = quality.features(pa.array(["Ab ab 1!", None], pa.string()))
    assert np.allclose(x[0, -9:-4], [1 / 8, 3 / 8, 1 / 8, 0, 1 / 8]) and np.isclose(x[0, -1], 1 / 3) and np.isclose(x[0, -2], 2 / 3) and not x[1].any()


def test_repeated_labelled_ids_are_learned_once(spark):
    docs, labels = labelled(spark, 40)
    again = docs
    for _ in range(3):
        again = again.unionByName(docs)
    a, b = quality.fitted(docs, labels, 20), quality.fitted(again, labels.unionByName(labels), 20)
    assert np.allclose(a[0], b[0]) and a[3] == b[3]


def test_pairs_prefer_the_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    label = (x[:, 0] > 0.3).astype(int)
    w, mean, scale, cut = quality.fit_pairs(x, label)
    assert (((x - mean) / scale @ w > cut) == label).mean() > 0.95


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    assert accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic") >= 0.9


def test_toxicity_odd_rows(spark):
    _, labels = labelled(spark, 8)
    rows = toxicity.toxicity_scores(odd(spark), labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0


def test_gradient_is_that_of_the_loss():
    texts = pa.array(["alpha idiot beta gamma", "one two three", "a"], pa.large_string())
    net, t = toxicity.Network(), toxicity.Tokens(texts)
    rng = np.random.default_rng(1)
    net.p = {k: rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    part = toxicity.Part(t, np.arange(3))
    target, weight = np.array([1, 0, 0]), np.ones(3)
    grad, _ = net.gradient(part, target, weight)
    for name, at in (("out", 3), ("att", 2), ("rec_f", (1, 5)), ("in_b", (2, 9)), ("b_f", 4), ("char", (int(part.gram[0]), 1)), ("word", (int(part.word[0]), 2))):
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        up = net.gradient(part, target, weight)[1]
        net.p[name][at] = old - step
        down = net.gradient(part, target, weight)[1]
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3, name


def test_scoring_path_equals_forward_path():
    net, t = toxicity.Network(3), toxicity.Tokens(pa.array(["x y z " * 50, "", "q"], pa.large_string()))
    net.p["char"] += np.random.default_rng(2).normal(0, 1, net.p["char"].shape).astype(np.float32)
    table = net.embed(t)
    assert np.abs(net.forward(table, t.windows) - net.logits(table, t.windows)).max() < 1e-4
