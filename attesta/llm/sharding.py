"""Size-tiered compaction of arriving documents into target-sized files.

Every ``append`` writes its documents as small immutable Parquet files and
becomes visible by one exclusive commit of the next arrival number. ``compact``
takes the live files of the newest manifest and the arrivals since, plans runs
over their sizes, rewrites each run as one file and commits the next manifest
version, which lists every live file. Files that no run takes are carried over
as they are. A writer that loses the race for a version plans again from the
version that won.

The plan is size-tiered: files of half the target or more are final. The others
fall into tiers by the power ``fan`` of their size; files of a tier are put
together until the next would pass the target, and what is left over, if at
least ``fan`` files, moves on as one to the tier of its size. So every run is
at most the target, and all but the last of a tier are above half of it. A file
of more than one and a half targets is split into equal parts.

Plans work within scopes of about ``scope_files`` files, dealt by hash, and each
scope is rewritten by its own job: neither a plan nor a broadcast table of files
grows with the corpus. Only names and sizes of files reach the driver, as in any
scan of the same files.

Defined cases: null text and null ids are carried like any value; a document
above the target is in a file alone or last in one; repeated rows are kept
each; all columns are carried along, whatever their names; arrivals may bring
further columns (null in older rows), but not another type of a known one; an
append without rows adds no file; reading an empty store gives no rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm._shared import commit_once, content, filesystem, names, release, shared_dir, stage

FILES = "file string, n_bytes long, n_rows long"
RUNS = "file string, run string, parts int"


def tiered_runs(sizes: list[int], target: int, fan: int = 4) -> list[list[int]]:
    """Numbers of the files to put together, one list per run, from the sizes of all files."""

    def tier(size: int) -> int:
        t = 0
        while fan ** (t + 1) <= size:
            t += 1
        return t

    waiting: dict[int, list[tuple[int, list[int]]]] = {}
    for i, size in enumerate(sizes):
        if 2 * size < target:
            waiting.setdefault(tier(size), []).append((size, [i]))
    runs = []
    for t in range(tier(target) + 1):
        total, taken = 0, []
        for size, own in sorted(waiting.get(t, [])):
            if total + size > target:
                runs.append([i for _, x in taken for i in x])
                total, taken = 0, []
            total += size
            taken.append((size, own))
        if len(taken) >= fan and 2 * total < target:
            waiting.setdefault(tier(total), []).append((total, [i for _, x in taken for i in x]))
        elif 2 * total >= target:
            runs.append([i for _, x in taken for i in x])
        else:
            runs += [own for _, own in taken]
    return [r for r in runs if len(r) > 1]


def plan(files: DataFrame, target: int, fan: int, scopes: int) -> DataFrame:
    """(scope, file, run, parts) of the files to rewrite, from all live files (file, n_bytes)."""

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("file").reset_index(drop=True)
        scope, out = rows["scope"].iloc[0], []
        for k, run in enumerate(tiered_runs(rows["n_bytes"].tolist(), target, fan)):
            out += [(scope, rows["file"][i], f"{scope}-{k}", 1) for i in run]
        for i in rows.index[rows["n_bytes"] > 1.5 * target]:
            out.append((scope, rows["file"][i], f"{scope}-s{i}", math.ceil(rows["n_bytes"][i] / target)))
        return pd.DataFrame(out, columns=["scope", "file", "run", "parts"])

    open_files = files.filter((2 * F.col("n_bytes") < target) | (F.col("n_bytes") > 1.5 * target))
    scoped = open_files.select(F.pmod(F.xxhash64("file"), F.lit(scopes)).cast("int").alias("scope"), "file", "n_bytes")
    return scoped.groupBy("scope").applyInPandas(planned, f"scope int, {RUNS}")


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both; those of one name must be of one type. Columns that one lacks are null there."""
    known = {f.name: f.dataType for f in old}
    for f in new:
        if known.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} is {known[f.name].simpleString()} in the store, {f.dataType.simpleString()} in the arrival")
    fields = [*old, *(f for f in new if f.name not in known)]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


class ShardStore:
    """Arrivals, data files and versioned manifests in one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, target_bytes: int = 128 << 20, fan: int = 4, scope_files: int = 4096):
        self.spark, self.folder, self.target = spark, folder or shared_dir(spark), target_bytes
        self.fan, self.scope_files = fan, scope_files

    def append(self, documents: DataFrame) -> int:
        """Write documents as immutable files, one per task; the number of this arrival."""
        data = uuid.uuid4().hex
        documents.write.option("compression", "zstd").parquet(f"{self.folder}/data/{data}")
        return self._commit("arrivals", json.dumps({"data": data, "schema": documents.schema.jsonValue()}))

    def compact(self) -> int:
        """Merge the live files and the arrivals since; the committed manifest version."""
        while True:
            version = self.version()
            before = self._manifest(version)
            arrivals = [json.loads(content(self.spark, f"{self.folder}/arrivals/{n}")) for n in self._numbers("arrivals") if n > before["arrivals"]]
            schema = T.StructType.fromJson(before["schema"])
            files = self._entries(before)
            for a in arrivals:
                schema = merged_schema(schema, T.StructType.fromJson(a["schema"]))
                files = files.unionByName(self._files(a["data"]))
            work = f"{self.folder}/work/{uuid.uuid4().hex}"
            files = stage(files, "files", work)
            scopes = max(1, -(-files.count() // self.scope_files))
            runs = stage(plan(files, self.target, self.fan, scopes), "runs", work)
            written = self._rewritten(runs, scopes, schema)
            entries = files.join(runs.select("file"), "file", "left_anti")
            for data in written:
                entries = entries.unionByName(self._files(data))
            name = uuid.uuid4().hex
            stage(entries, name, f"{self.folder}/entries")
            manifest = {"entries": name, "arrivals": before["arrivals"] + len(arrivals), "schema": schema.jsonValue()}
            won = commit_once(self.spark, f"{self.folder}/manifests/{version + 1}", json.dumps(manifest))
            release(self.spark, work)
            if won:
                return version + 1

    def version(self) -> int:
        """The newest manifest version, 0 before the first."""
        return max(self._numbers("manifests"), default=0)

    def files(self, version: int | None = None) -> DataFrame:
        """(file, n_bytes, n_rows) of the live files of a manifest version, the newest by default."""
        return self._entries(self._manifest(self.version() if version is None else version))

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The documents of a manifest version; ``shard`` names a further column for the file of each."""
        manifest = self._manifest(self.version() if version is None else version)
        schema = T.StructType.fromJson(manifest["schema"])
        if shard in schema.names:
            raise ValueError(f"the documents have a column {shard}")
        paths = [f"{self.folder}/data/{r['file']}" for r in self._entries(manifest).select("file").collect()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if not shard:
            return rows
        return rows.withColumn(shard, self._name(rows) if paths else F.lit(None).cast("string"))

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> None:
        """Delete files that none of the newest ``keep`` versions nor a waiting arrival names, if older than ``hours``."""
        newest, live, waiting = self.version(), set(), set()
        for v in range(max(0, newest - keep + 1), newest + 1):
            live |= {r["file"] for r in self.files(v).select("file").collect()}
        for n in self._numbers("arrivals"):
            if n > self._manifest(newest)["arrivals"]:
                waiting.add(json.loads(content(self.spark, f"{self.folder}/arrivals/{n}"))["data"])
        fs, Path = filesystem(self.spark, self.folder)
        before = (time.time() - 3600 * hours) * 1000
        for data in names(self.spark, f"{self.folder}/data"):
            if data in waiting:
                continue
            found = fs.listFiles(Path(f"{self.folder}/data/{data}"), True)
            while found.hasNext():
                f = found.next()
                path = f.getPath().toUri().getPath()
                if path[path.index(f"/data/{data}/") + 6 :] not in live and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), False)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.folder}/{kind}"))

    def _commit(self, kind: str, text: str) -> int:
        while True:
            n = 1 + max(self._numbers(kind), default=0)
            if commit_once(self.spark, f"{self.folder}/{kind}/{n}", text):
                return n

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"entries": None, "arrivals": 0, "schema": T.StructType().jsonValue()}
        return json.loads(content(self.spark, f"{self.folder}/manifests/{version}"))

    def _entries(self, manifest: dict) -> DataFrame:
        if not manifest["entries"]:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/entries/{manifest['entries']}")

    def _name(self, rows: DataFrame) -> Column:
        """The file of each row, below the data folder."""
        return F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], r"/data/([^/]+/.*)$", 1)

    def _files(self, data: str) -> DataFrame:
        """(file, n_bytes, n_rows) of a data folder, from the footers of its files."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/data/{data}")
        told = rows.select(self._name(rows).alias("file"), rows.metadataColumn("_metadata")["file_size"].alias("n_bytes"))
        return told.groupBy("file").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))

    def _rewritten(self, runs: DataFrame, scopes: int, schema: T.StructType) -> Iterator[str]:
        """Data folders with one file for each run, scope by scope."""
        for scope in range(scopes):
            members = runs.filter(F.col("scope") == scope).select("file", "run", "parts").collect()
            if not members:
                continue
            rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{m['file']}" for m in members])
            place, run, file = (_free(schema, n) for n in ("place", "run", "file"))
            where = F.broadcast(self.spark.createDataFrame([tuple(m) for m in members], RUNS).select(F.col("file").alias(file), F.struct("run", "parts").alias(place)))
            part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"{place}.parts"))
            named = rows.withColumn(file, self._name(rows)).join(where, file).withColumn(run, F.concat_ws("-", F.col(f"{place}.run"), part))
            tasks = sum({m["run"]: m["parts"] for m in members}.values())
            data = uuid.uuid4().hex
            named.drop(file, place).repartition(tasks, run).write.option("compression", "zstd").partitionBy(run).parquet(f"{self.folder}/data/{data}")
            yield data


def _free(schema: T.StructType, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {n.lower() for n in schema.names}
    while name in taken:
        name += "_"
    return name


def sharded(documents: DataFrame, arrivals: int = 4, **options) -> DataFrame:
    """(doc_id, n_bytes, shard, version) of every document, after ``arrivals`` appends with a compaction each."""
    spark = documents.sparkSession
    store, version = ShardStore(spark, **options), 0
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(documents.filter(turn == i))
        version = store.compact()
        store.vacuum(keep=1, hours=0)  # the store is new and has one writer
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return store.read(version, "shard_file").select("doc_id", size.alias("n_bytes"), F.col("shard_file").alias("shard"), F.lit(version).alias("version"))
