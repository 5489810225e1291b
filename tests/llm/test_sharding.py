import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import _shared, sharding
from tests.llm.common import empty, odd


def texts(spark, start, n, length=400):
    rng = random.Random(start)
    return spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, length)))) for i in range(start, start + n)], "doc_id long, text string")


def bag(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_runs_against_the_rules_of_the_plan():
    rng = random.Random(2)
    for _ in range(200):
        target, fan = rng.choice([100, 1000]), rng.choice([2, 3, 4])
        sizes = [int(rng.paretovariate(0.6)) % (2 * target) for _ in range(rng.randint(0, 60))]
        runs = sharding.tiered_runs(sizes, target, fan)
        used = [i for r in runs for i in r]
        assert len(used) == len(set(used)) and all(2 * sizes[i] < target and len(r) > 1 for r in runs for i in r)
        totals = [sum(sizes[i] for i in r) for r in runs]
        assert all(t <= target for t in totals)
        # what is below half the target is fewer than fan files of any tier: no run of similar files is left
        left = [s for i, s in enumerate(sizes) if i not in set(used) and 2 * s < target] + [t for t in totals if 2 * t < target]
        tiers = [next(t for t in range(64) if fan ** (t + 1) > s) for s in left]
        assert all(tiers.count(t) < fan for t in tiers)


def test_three_appends_and_compactions(spark):
    store = sharding.ShardStore(spark, target_bytes=30_000, scope_files=40)
    rows, before = None, {}
    for turn, (start, n, files) in enumerate(((0, 2000, 60), (2000, 300, 5), (2300, 2500, 33)), 1):
        new = texts(spark, start, n).repartition(files)
        assert store.append(new) == turn and store.compact() == turn
        rows = new if rows is None else rows.unionByName(new)
        assert bag(store.read()) == bag(rows)
        live = {r["file"]: r for r in store.files().collect()}
        assert sum(r["n_rows"] for r in live.values()) == rows.count()
        assert all(r["n_bytes"] <= 45_000 for r in live.values())
        small = [r for r in live.values() if r["n_bytes"] < 10_000]
        assert len(live) < files + len(before) and len(small) <= 3 * 3 * 4  # below fan of a tier and scope
        # files of half the target or more are final: every later version names them
        assert {f for f, r in before.items() if 2 * r["n_bytes"] >= 30_000 and r["n_bytes"] <= 45_000} <= set(live)
        # a run is one file
        folders = {}
        for f in live:
            if "run=" in f:
                folders.setdefault(f.rsplit("/", 1)[0], []).append(f)
        assert all(len(x) == 1 for x in folders.values())
        before = live
    assert bag(store.read(1)) == bag(texts(spark, 0, 2000))
    store.vacuum(keep=1, hours=0)
    assert bag(store.read()) == bag(rows)


def test_a_large_file_is_split(spark):
    store = sharding.ShardStore(spark, target_bytes=20_000)
    docs = texts(spark, 0, 1000)
    store.append(docs.coalesce(1))
    store.compact()
    sizes = [r["n_bytes"] for r in store.files().collect()]
    assert len(sizes) > 3 and max(sizes) < 30_000 and bag(store.read()) == bag(docs)


def test_the_loser_of_a_race_plans_again(spark, monkeypatch):
    store = sharding.ShardStore(spark, target_bytes=50_000)
    store.append(texts(spark, 0, 200).repartition(8))
    other, raced = sharding.ShardStore(spark, store.folder, target_bytes=50_000), []

    def late(session, path, text):
        if not raced and "/manifests/" in path:
            raced.append(path)
            other.append(texts(spark, 200, 100).repartition(5))
            assert other.compact() == 1
        return _shared.commit_once(session, path, text)

    monkeypatch.setattr(sharding, "commit_once", late)
    assert store.compact() == 2 and raced
    assert bag(store.read()) == bag(texts(spark, 0, 200).unionByName(texts(spark, 200, 100)))


def test_commits_are_exclusive_and_whole(spark):
    folder = _shared.shared_dir(spark)
    assert _shared.commit_once(spark, f"{folder}/c/1", "é") and not _shared.commit_once(spark, f"{folder}/c/1", "b")
    assert _shared.names(spark, f"{folder}/c") == ["1"] and _shared.content(spark, f"{folder}/c/1") == "é"
    assert _shared.sweep(spark, hours=1) == 0


def test_odd_rows_and_clashing_names(spark):
    docs = odd(spark).withColumns({"run": F.lit("r"), "shard": F.lit("s"), "file": F.lit("f"), "place": F.lit(3), "_metadata": F.lit("m"), "version": F.lit(9)})
    store = sharding.ShardStore(spark, target_bytes=100_000)
    for _ in range(2):
        store.append(docs.repartition(6))
        store.compact()
    got = store.read()
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.unionAll(docs).collect()))
    with pytest.raises(ValueError, match="shard"):
        store.read(shard="shard")
    store.append(odd(spark).withColumn("extra", F.lit(1)))
    store.compact()
    assert store.read().filter("extra = 1").count() == 9 and store.read().count() == 27
    store.append(odd(spark).withColumn("lang", F.lit(5)))
    with pytest.raises(ValueError, match="lang"):
        store.compact()


def test_empty_store_and_query(spark):
    store = sharding.ShardStore(spark)
    assert store.read().count() == 0 and store.compact() == 1 and store.read().count() == 0
    store.append(empty(spark))
    assert store.compact() == 2 and store.read().count() == 0 and store.read().columns == empty(spark).columns
    assert sharding.sharded(odd(spark)).count() == 9
    assert sharding.sharded(empty(spark)).count() == 0
