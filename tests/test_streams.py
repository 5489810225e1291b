import inspect
import json
import os
import random
from collections import deque

from pyspark.sql import functions as F

from attesta.operators import ingest
from attesta.sources import files
from attesta.streaming.admission import admission_stream, admissions, admit, chunked
from attesta.streaming.call_log import cost_rollup


def test_sliding_log():
    assert [a for a, _ in admit([0, 1, 2, 3], deque(), 3, 60_000)] == [True, True, True, False]
    assert list(admit([0, 500, 1001], deque(), 1, 1000)) == [(True, 0), (False, 1), (True, 0)]


def test_admissions_by_key(spark):
    events = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("b", 3, 5), ("a", 4, 2000), (None, 5, 1)], "key string, event_id long, at long")
    got = {r.event_id: r.admitted for r in admissions(events, limit=1, window_ms=1000).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert admissions(events.filter(F.lit(False))).count() == 0


def test_chunks_change_no_decision(spark):
    rng = random.Random(41)
    rows, at = [], {k: 0 for k in ("a", "b", None)}
    for i in range(600):
        k = rng.choice(list(at))
        at[k] += rng.choice([0, 1, 5, 40, 99, 100, 101, 111, 112, 113, 125, 300, 5000])
        rows.append((k, i, at[k]))
    events = spark.createDataFrame(rows, "key string, event_id long, at long").repartition(3)
    want = {}
    for key in at:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        want |= {r[1]: d for r, d in zip(own, admit([r[2] for r in own], deque(), 2, 100), strict=True)}
    assert {r.event_id: (r.admitted, r.retry_after) for r in admissions(events, limit=2, window_ms=100).collect()} == want
    chunks = {(r.key, r.chunk) for r in chunked(events, 100).collect()}
    assert len(chunks) > 100
    for key in at:  # a gap of more than the window lies between chunks
        own = sorted((r.at, r.chunk) for r in chunked(events, 100).collect() if r.key == key)
        assert all(b[0] - a[0] > 100 for a, b in zip(own, own[1:], strict=False) if a[1] != b[1])


def test_admission_stream_decides_in_event_time(spark, tmp_path):
    start = 1_700_000_000_000
    rows = [(["a", "b", None][i % 3], i, start + (i * 37 % 90) * 1000) for i in range(90)]
    want = {r.event_id: (r.admitted, r.retry_after) for r in admissions(spark.createDataFrame(rows, "key string, event_id long, at long"), limit=3, window_ms=20_000).collect()}
    (tmp_path / "in").mkdir()
    batches = [rows[:40], rows[40:], [("z", 1000, start + 10_000_000)], [("z", 1001, start + 20_000_000)]]  # out of order within the first two
    for i, b in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "event_id": e, "at": t}) for k, e, t in b))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))  # files are read by age
    stream = spark.readStream.schema("key string, event_id long, at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = admission_stream(stream.withColumn("ts", F.timestamp_millis("at")), limit=3, window_ms=20_000, late="2 minutes")
    q = out.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: (r.admitted, r.retry_after) for r in spark.table("admitted").filter("event_id < 1000").collect()}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    lines = [{"call_id": str(i), "ts": 1_700_000_000 + i * 600, "stage": ["a", None, ""][i % 3], "model": "m", "tokens_in": i, "tokens_out": 1, "cost_usd": 0.5} for i in range(60)]
    lines.append({"call_id": "last", "ts": 1_700_900_000, "stage": "a", "model": "m", "tokens_in": 0, "tokens_out": 0, "cost_usd": 0})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    calls = files.read_call_log(spark, str(tmp_path / "log")).withColumn("cost_microusd", F.col("cost_usd") * 1e6)
    batch = {tuple(r) for r in cost_rollup(calls).collect()}
    stream = spark.readStream.schema(files.CALL).json(str(tmp_path / "log")).withColumns({"ts": F.timestamp_seconds("ts"), "cost_microusd": F.col("cost_usd") * 1e6})
    q = cost_rollup(stream).writeStream.format("memory").queryName("rollup").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("rollup").collect()}
    assert got == {b for b in batch if b[0].year == 2023 and b[0].day < 24} and len(got) > 5


def test_documents_and_gold(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text(json.dumps({"title": "T", "full_text": "abc", "offsets": [{"start": 0, "end": 3, "page": 1}]}))
    (tmp_path / "docs" / "bad.json").write_text("{nope")
    rows = files.read_parsed_documents(spark, str(tmp_path / "docs")).collect()
    assert [(r.doc, r.title, r.offsets[0].end) for r in rows] == [("one", "T", 3)]
    (tmp_path / "g.csv").write_text('﻿Cohort ID,Effect Size\n"a, b","x ""q"""\n ,y\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_gold(spark, str(tmp_path / "g.csv"), {"Cohort ID": "id", "Effect Size": "effect"}).collect()] == [("a, b", 'x "q"')]


def test_responses_and_csv(spark, tmp_path):
    raw = spark.createDataFrame([("x {\"k\": 1, \"score\": 3, \"verdict\": \"ok\"} y",), ("none",), ("{\"k\": 1, \"verdict\": \"maybe\"}",), (None,)], "response string")
    got = ingest.ingest_responses(raw).collect()
    assert [r.reason for r in got] == [None, "no JSON object", "verdict not allowed", "no JSON object"] and got[0].score == 1.0
    rows = spark.createDataFrame([(1, "a\"b", [1], 2.0)], "z int, name string, nested array<int>, _hidden double")
    assert ingest.csv_columns(rows, ["name"]) == ["name", "z"]
    ingest.write_csv(rows, str(tmp_path / "csv"), ["name"])
    assert '"a""b","1"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_a_batch_of_many_chunks_is_not_grouped(spark):
    from attesta.streaming import admission

    assert "groupby" not in inspect.getsource(admission.admissions)
    rows = [(k, i, i * 7_200_000 + j) for k in ("a", None) for i in range(50) for j in range(2)]
    out = admission.admissions(spark.createDataFrame(rows, "key string, event_id long, at long"), limit=1, window_ms=3_600_000).collect()
    assert len(out) == 200 and sum(r.admitted for r in out) == 100 and all(r.admitted == (r.at % 7_200_000 == 0) for r in out)
