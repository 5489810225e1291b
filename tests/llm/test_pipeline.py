import random

import pytest

import corpus_pipeline as P
from attesta.llm import near_dedup, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import brute as links
from tests.llm.test_suffix_dedup import brute as repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(9), str(tmp_path_factory.mktemp("sf"))

    def text(k):
        return " ".join("".join(rng.choices(["ta", "ri", "mo", "len", "su", "qu"], k=rng.randint(1, 4))) for _ in range(k))

    bench = [(i, text(14)) for i in range(5)]
    passage, docs, labels = text(60), [], []
    for i in range(90):
        t = text(rng.randint(5, 120))
        if i % 6 == 0:
            t = f"idiot {t} moron scum"
        elif i % 10 == 1:
            t = docs[i - 1][1] if i % 20 == 1 else docs[i - 1][1] + " " + text(1)
        elif i % 10 == 3:
            t = f"{t} {passage}"
        elif i % 10 == 5:
            t = f"{t} {bench[i % 5][1]}"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(90, None, None, None, None), (91, "", "en", "s", 0), (None, text(30), "en", "s", 1), (92, passage + " end", "en", "s", 1), (92, passage + " end", "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows(df):
    return sorted([tuple(r) for r in df.select(*P.COLUMNS).collect()], key=repr)


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = rows(docs)

    scores = {(r.doc_id): r.predicted for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = P.stage(P.drop_toxic(spark, docs, folder), "t")
    assert rows(kept) == [r for r in given if not scores[r[0]]] and len(rows(kept)) < len(given)

    given = rows(kept)
    texts = [r[1] or "" for r in given]
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links(texts, near_dedup.document_frequencies(kept))):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(given):
        groups.setdefault(find(i), []).append(r)
    want = sorted([min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()], key=repr)
    kept = P.stage(P.drop_near_duplicates(spark, kept, folder), "n")
    assert rows(kept) == want and len(want) < len(given)

    given = rows(kept)
    cut = {(r[0], r[1]): r[2] for r in repeats([(r[0], r[1]) for r in given], 200)}
    kept = P.stage(P.cut_repeats(spark, kept, folder), "s")
    got = rows(kept)
    assert {r[0] for r in got} <= {r[0] for r in given} and any(v for v in cut.values())
    for r in got:
        old = next(g for g in given if g[0] == r[0])
        removed = cut[old[0], len((old[1] or "").encode())]
        assert len((r[1] or "").encode()) == len((old[1] or "").encode()) - removed and r[4] == len(r[1] or "")

    given = rows(kept)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {r[0] for r in contaminated([(g[0], g[1]) for g in given], items) if r[5]}
    kept = P.stage(P.drop_contaminated(spark, kept, folder), "d")
    assert rows(kept) == [g for g in given if g[0] not in dirty] and dirty

    packed = P.pack(spark, kept, folder).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows(kept)}


def test_run_gives_the_last_stage(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "piece", "n_tokens", "bin_id", "offset"]


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
