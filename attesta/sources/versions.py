"""Tables with versions, and an append-only store of responses, in a folder that the cluster shares.

Data is written under names of its own and becomes visible by a small file that
appears whole and never replaces another: a lost writer leaves data that nothing
names. Other columns, nulls and repeated rows are kept as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.ingest import cache_key


class LostRace(RuntimeError):
    """Another writer published first."""


class Marks:
    """Small files of a folder, each written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self.path(self.folder).getFileSystem(self.conf)

    def names(self) -> list[str]:
        at = self.path(self.folder)
        found = self._fs().listStatus(at) if self._fs().exists(at) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if n[0] not in "_.")

    def text(self, name: str) -> str:
        opened = self._fs().open(self.path(f"{self.folder}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()

    def put(self, name: str, text: str) -> bool:
        """False, and nothing is changed, if the name is taken: the draft is renamed without overwriting."""
        from py4j.protocol import Py4JJavaError

        fs, draft = self._fs(), self.path(f"{self.folder}/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self.path(f"{self.folder}/{name}"), none)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


class Versions:
    """A table of which every version can be read: version n is published once, after version n - 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.marks = spark, folder, Marks(spark, f"{folder}/versions")

    def latest(self) -> int:
        """Number of the newest version; 0 if there is none."""
        return max((int(n) for n in self.marks.names()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data/{self.marks.text(f'{version or self.latest():012d}')}")

    def publish(self, rows: DataFrame, after: int) -> int:
        """Write rows as the version that follows ``after``; LostRace if there is one already."""
        data = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/data/{data}")
        if not self.marks.put(f"{after + 1:012d}", data):
            raise LostRace(f"version {after + 1} of {self.folder} was published by another writer")
        return after + 1

    def change(self, step: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Publish ``step`` of the newest version; after a lost race it is taken anew from the version that won."""
        for left in reversed(range(tries)):
            at = self.latest()
            try:
                return self.publish(step(self.read(at)), at)
            except LostRace:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")


class Responses:
    """Responses by the content key of what was asked, in folders by the key's first two digits and in buckets of the key.

    A key keeps its first response. A batch is appended once, whoever sends it again. Keys are texts or bytes, of one
    kind in a store. Rows that ``keyed`` wrote are shuffled once, then they meet the store bucket by bucket; buckets
    should be as many as ``buckets_for`` says, and the same for all writers of a store.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 1):
        self.spark, self.folder, self.buckets, self.marks = spark, folder, buckets, Marks(spark, f"{folder}/batches")

    @staticmethod
    def buckets_for(rows: int) -> int:
        """At most 2 million rows a bucket, and up to 8 buckets of 65,536 rows."""
        return max(1, min(8, rows >> 16), -(-rows // 2_000_000))

    def _write(self, rows: DataFrame, data: str, *folders: str) -> DataFrame:
        writer = rows.write.bucketBy(self.buckets, "input_hash").option("compression", "zstd")
        (writer.partitionBy(*folders) if folders else writer).option("path", f"{self.folder}/data/{data}").saveAsTable(self._table(data))
        return self.spark.table(self._table(data))

    @staticmethod
    def _table(data: str) -> str:
        return f"responses_{data[-32:]}"

    def _batch(self, data: str, kind: str) -> DataFrame:
        """The table of a batch; one that another session wrote is read from its folder, without its buckets."""
        if self.spark.catalog.tableExists(self._table(data)):
            return self.spark.table(self._table(data))
        return self.spark.read.schema(f"input_hash {kind}, response string, ts long, prefix string").parquet(f"{self.folder}/data/{data}")

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``input_hash``, written in the buckets of the store and read back."""
        return self._write(rows.repartition(self.buckets, "input_hash"), f"keyed-{uuid.uuid4().hex}")

    def known(self, keys: DataFrame) -> DataFrame:
        """(input_hash, response) of the keys' folders alone; these are 256 at most."""
        kind, batches = keys.schema["input_hash"].dataType.simpleString(), self.marks.names()
        asked = [r["p"] for r in keys.select(_prefix(keys).alias("p")).distinct().collect() if r["p"]] if batches else []
        if not asked:
            return self.spark.createDataFrame([], f"input_hash {kind}, response string")
        parts = [self._batch(self.marks.text(b), kind).filter(F.col("prefix").isin(asked)) for b in batches]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy("input_hash").agg(F.min_by("response", "ts").alias("response"))

    def append(self, batch: str, responses: DataFrame) -> bool:
        """Add (input_hash, response, ts) of keys without one; False if the batch was added before."""
        taken = self.marks.names()
        if batch in taken:
            return False
        new = responses.filter("input_hash is not null").groupBy("input_hash").agg(F.min(F.struct("ts", "response")).alias("r")).select("input_hash", "r.response", F.col("r.ts").cast("long").alias("ts"))
        if taken:
            new = new.join(self.known(responses), "input_hash", "left_anti")
        data = f"{batch}-{uuid.uuid4().hex}"
        self._write(new.withColumn("prefix", _prefix(new)), data, "prefix")
        return self.marks.put(batch, data)

    def lookup(self, claims: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(claims with their response, claims without one), both with ``input_hash``: that of the columns, or their own."""
        claims = claims.withColumn("input_hash", cache_key(claims, columns)) if columns else claims
        known = self.known(claims)
        return claims.join(known, "input_hash"), claims.join(known, "input_hash", "left_anti")

    def answered(self, claims: DataFrame) -> DataFrame:
        """All claims with ``response``, NULL for those without one: both sides of ``lookup`` in one pass."""
        return claims.join(self.known(claims), "input_hash", "left")


def _prefix(rows: DataFrame) -> Column:
    """First two digits of the key."""
    kind = rows.schema["input_hash"].dataType.simpleString()
    return F.lower(F.hex(F.substring("input_hash", 1, 1))) if kind == "binary" else F.substring("input_hash", 1, 2)
