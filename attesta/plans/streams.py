"""Batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.sources.adapters import CALLS, view
from attesta.streaming.admission import admissions
from attesta.streaming.call_log import cost_rollup


@query("x01_cost_rollup", f"SELECT time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS window_start, coalesce(stage, 'unknown') AS stage, model, count(*) AS n_calls, CAST(sum(cost_microusd) AS BIGINT) AS cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM ({CALLS}) GROUP BY ALL")
def _(spark, d):
    out = cost_rollup(view(spark, d, CALLS))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("x02_admission", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT key, n, event_id, tm, [tm] AS kept, true AS admitted, CAST(0 AS BIGINT) AS retry_after FROM e WHERE n = 1
 UNION ALL SELECT key, n, event_id, tm, CASE WHEN len(k) < 5 THEN list_append(k, tm) ELSE k END, len(k) < 5, CASE WHEN len(k) < 5 THEN 0 ELSE greatest(1, CAST(ceil((k[1] + 3600000 - tm) / 1000) AS BIGINT)) END
 FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.tm - 3600000) AS k FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, event_id, tm AS at, admitted, retry_after FROM r""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return admissions(events.select(F.col("user_id").alias("key"), "event_id", at.cast("long").alias("at")))
