import pytest
from pyspark.sql import functions as F

from attesta.operators import telemetry
from attesta.sources.staging import shared_folder
from attesta.sources.versions import LostRace, Responses, Versions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_published_once(spark):
    table = Versions(spark, shared_folder(spark))
    assert table.latest() == 0
    table.publish(spark.createDataFrame([(1, "a")], "id int, v string"), 0)
    with pytest.raises(LostRace):
        table.publish(spark.createDataFrame([(2, "b")], "id int, v string"), 0)
    assert table.latest() == 1 and rows(table.read()) == [(1, "a")]
    assert table.change(lambda df: df.union(df)) == 2 and rows(table.read(1)) == [(1, "a")] and rows(table.read()) == [(1, "a"), (1, "a")]


def test_a_lost_race_is_taken_anew(spark):
    table, seen = Versions(spark, shared_folder(spark)), []
    table.publish(spark.createDataFrame([(1,)], "n int"), 0)

    def step(df):
        if not seen:  # another writer is faster once
            Versions(spark, table.folder).change(lambda other: other.withColumn("n", F.col("n") + 10))
        seen.append(df.first().n)
        return df.withColumn("n", F.col("n") + 1)

    assert table.change(step) == 3 and seen == [1, 11] and rows(table.read()) == [(12,)]
    with pytest.raises(LostRace):
        table.change(lambda df: Versions(spark, table.folder).change(lambda other: other) and df, tries=2)


def test_verdicts_are_published_or_only_counted(spark):
    table = Versions(spark, shared_folder(spark))
    table.publish(spark.createDataFrame([(1, "ok", None), (2, None, 0.5)], "id int, v string, s double"), 0)
    new = spark.createDataFrame([(1, "reject", None), (9, "ok", 1.0)], "id int, v string, s double")
    assert tuple(telemetry.publish_verdicts(table, new, "id", ["v", "s"], dry_run=True).first()) == (2, 1, 1, 0) and table.latest() == 1
    assert rows(telemetry.publish_verdicts(table, new, "id", ["v", "s"])) == [(1, "reject", None), (2, None, 0.5)] and table.latest() == 2


def test_responses_are_appended_once(spark):
    store = Responses(spark, shared_folder(spark))
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "row int, claim string")
    hits, misses = store.lookup(claims, ["claim"])
    assert hits.count() == 0 and misses.count() == 4
    asked = misses.filter("row < 4").select("input_hash", F.concat(F.lit("r"), F.col("row").cast("string")).alias("response"), F.col("row").alias("ts"))
    assert store.append("one", asked) and not store.append("one", asked)
    assert store.append("two", asked.withColumn("response", F.lit("later")))  # these keys have a response
    hits, misses = store.lookup(claims, ["claim"])
    assert sorted((r.row, r.response) for r in hits.collect()) == [(1, "r1"), (2, "r2"), (3, "r1")] and [r.row for r in misses.collect()] == [4]
    plan = store.known(claims.limit(1).withColumn("input_hash", F.sha2(F.lit("x"), 256)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan


def _shuffles(spark, rows) -> int:
    """Shuffles of a plan of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return rows.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keyed_claims_meet_the_store_without_another_shuffle(spark):
    store = Responses(spark, shared_folder(spark), 4)
    claims = store.keyed(spark.range(400).selectExpr("id", "unhex(sha2(cast(id % 300 as string), 256)) AS input_hash"))
    assert store.append("seen", claims.filter("id < 100").selectExpr("input_hash", "concat('seen ', id) AS response", "1 AS ts"))
    hits, misses = store.lookup(claims)
    assert (hits.count(), misses.count()) == (200, 200)
    assert store.append("asked", misses.selectExpr("input_hash", "'asked' AS response", "9 AS ts"))
    answered = store.answered(claims)
    assert not any(_shuffles(spark, rows) for rows in (hits, misses, answered))
    told = {i: f"seen {i % 300}" if i % 300 < 100 else "asked" for i in range(400)}
    assert {r.id: r.response for r in answered.collect()} == told
    for (table,) in spark.sql("SHOW TABLES LIKE 'responses_*'").select("tableName").collect():
        spark.sql(f"DROP TABLE {table}")  # as in another session, which knows the folder alone
    rows = spark.range(400).selectExpr("id", "unhex(sha2(cast(id % 300 as string), 256)) AS input_hash")
    assert {r.id: r.response for r in Responses(spark, store.folder).answered(rows).collect()} == told


def test_a_cached_lookup_shuffles_no_claim_after_its_key_is_made(spark):
    from attesta.plans.registry import queries

    assert not _shuffles(spark, queries()["s11_cached_lookup"](spark, "/root/testdata/sf0.001"))


def test_buckets_grow_with_the_rows():
    assert [Responses.buckets_for(n) for n in (0, 60_000, 600_000, 6_000_000, 216_000_000)] == [1, 1, 8, 8, 108]
