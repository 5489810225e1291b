import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from attesta.llm import linking as L
from attesta.llm import near_dedup as N
from attesta.llm.graph import connected_components
from tests.llm.common import empty, odd


def brute(texts, weights):
    bags = N.Bags(pa.array(texts, pa.large_string()))
    w, inverted = weights.of(bags), defaultdict(list)
    total = Counter()
    for d, f, x in zip(bags.doc.tolist(), bags.feature.tolist(), w.tolist(), strict=True):
        inverted[f].append((d, x))
        total[d] += x
    both = Counter()
    for rows in inverted.values():
        for i, (a, x) in enumerate(rows):
            for b, y in rows[i + 1 :]:
                both[a, b] += min(x, y)
    return {p for p, m in both.items() if m / (total[p[0]] + total[p[1]] - m) >= N.THRESHOLD}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(60, 160))
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            docs.append(" ".join(new).upper() if rng.random() < 0.3 else " ".join(new))
    return docs


def test_classes_are_those_of_all_pairs(spark):
    docs = corpus()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    links = brute(docs, N.document_frequencies(d))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in N.near_duplicates(d).collect()}
    wrong = [i for i in got if got[i].class_id != find(i)]
    assert len(wrong) <= len(docs) // 100, wrong  # banding may miss a link in ten thousand
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})


def test_odd_rows(spark):
    rows = N.near_duplicates(odd(spark)).collect()
    assert len(rows) == 9
    kept = sorted((r.doc_id or 0) for r in rows if r.kept)
    assert kept == [0, 1, 2, 4, 6, 7, 8]
    assert {r.class_id for r in rows if r.doc_id == 5} == {4}
    assert N.near_duplicates(empty(spark)).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (200, 201)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    e = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in connected_components(e).collect()} == {x: find(x) for x in parent}
    assert connected_components(e.filter(F.lit(False))).count() == 0


def test_large_bands_lose_no_link(spark, monkeypatch):
    # two hundred families around one template: copies of a family are alike, families are not
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    template, docs = rng.choices(words, k=150), []
    for _ in range(200):
        base = list(template)
        for at in rng.sample(range(150), 6):
            base[at] = rng.choice(words)
        for _ in range(2):
            new = list(base)
            new[rng.randrange(150)] = rng.choice(words)
            docs.append(" ".join(new))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    links = brute(docs, N.document_frequencies(d))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    # one band for all: only the treatment of large bands decides
    monkeypatch.setattr(N, "bands", lambda values: N.np.zeros((len(values), N.BANDS), N.np.int64))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(d).collect()}
    assert len(set(got.values())) > 50 and got == {i: find(i) for i in got}


def test_long_texts_without_common_shingles_share_no_band():
    rng = random.Random(3)
    texts = [" ".join(f"{side}{rng.randrange(10**9)}" for _ in range(60_000)) for side in "ab"]
    weights = L.Weights(2, N.np.ones(L.SLOTS))
    bags = N.Bags(pa.array([*texts, texts[0] + " more"]))
    a, b, c = N.bands(N.samples(bags, weights.logs(bags)))
    assert not set(a.tolist()) & set(b.tolist())
    assert len(set(a.tolist()) & set(c.tolist())) > N.BANDS // 2


def test_repeated_rows_bring_one_text(spark):
    docs = corpus(6)[:30]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs) for _ in range(5)], "doc_id long, text string")
    once = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    got = N.near_duplicates(d).collect()
    assert len(got) == 150 and {r.doc_id: r.class_id for r in got} == once and sum(r.kept for r in got) == len(set(once.values()))


def test_weights_are_inverse_document_frequencies():
    df = N.np.zeros(L.SLOTS)
    df[:3] = 1, 10, 1000
    assert N.np.allclose(L.Weights(1000, df).idf[:4], [1 + N.np.log(1000), 1 + N.np.log(100), 1, 1 + N.np.log(1000)])
    crowded = df + 50  # every slot holds as many others
    assert N.np.allclose(L.Weights(1000, crowded).idf[:3], L.Weights(1000, df).idf[:3])
