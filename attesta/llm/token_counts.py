"""Token totals by source, language and tokenizer version, kept by signed deltas.

A change is an insert (+1 document, +n tokens), a delete (-1, -n) or a revised
count (0, new - old). A batch of changes is summed per group, written once and
becomes visible by one exclusive commit under its name: a batch that is sent
again changes nothing. Totals are the newest snapshot plus the batches committed
since; ``fold`` sums these into the next snapshot, so that totals stay a read of
few files however many batches there were.

Defined cases: null or empty text has 0 tokens and counts as a document; null
source or language is a group of its own, other types are read as text; rows are
told apart by position, so repeated rows count each; other columns are ignored;
an empty table gives no groups. Corpora that are added to one folder at the same
time keep their order of recording, which decides whose copy stays.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm._shared import commit_once, content, filesystem, names, shared_dir, stage
from attesta.llm.decontaminate import word_count

GROUP = ["source", "lang", "tokenizer"]
SPACES = "\t\n\x0b\f\r"


def space_count(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


#: Tokenizer version and its count.
TOKENIZERS = {"spaces-1": space_count, "words-1": word_count}


def signed(changes: DataFrame) -> DataFrame:
    """(group, d_docs, d_tokens) of changes with op, n_tokens and old_tokens."""
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", F.col("n_tokens")).when(op == "delete", -F.col("n_tokens")).otherwise(F.col("n_tokens") - F.col("old_tokens"))
    return changes.select(*[F.col(c).cast("string").alias(c) for c in GROUP], docs.cast("long").alias("d_docs"), tokens.cast("long").alias("d_tokens"))


SUMS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


class Rollup:
    """Additive totals in a folder: data of batches, their commits, and snapshots of their sums."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fold_every: int = 64):
        self.spark, self.folder, self.fold_every = spark, folder or shared_dir(spark), fold_every

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if the batch was applied before."""
        if self.committed(batch):
            return False
        data = f"{batch}-{uuid.uuid4().hex}"
        signed(changes).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.folder}/data/{data}")
        done = commit_once(self.spark, f"{self.folder}/commits/{batch}", data)
        if len(self._state()[1]) > self.fold_every:
            self.fold()
        return done

    def committed(self, batch: str) -> bool:
        fs, Path = filesystem(self.spark, self.folder)
        return fs.exists(Path(f"{self.folder}/commits/{batch}"))

    def _state(self) -> tuple[dict, list[str]]:
        """The newest snapshot and the names of the batches that it lacks."""
        number = max((int(n) for n in names(self.spark, f"{self.folder}/snapshots")), default=0)
        snapshot = json.loads(content(self.spark, f"{self.folder}/snapshots/{number}")) if number else {"data": None, "batches": None}
        folded = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/data/{snapshot['batches']}").collect()} if number else set()
        return {"number": number, **snapshot}, [n for n in names(self.spark, f"{self.folder}/commits") if n not in folded]

    def _sums(self, snapshot: dict, batches: list[str]) -> DataFrame:
        named = [content(self.spark, f"{self.folder}/commits/{b}") for b in batches] + ([snapshot["data"]] if snapshot["data"] else [])
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.folder}/data/{d}" for d in named]) if named else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def totals(self) -> DataFrame:
        """(group, n_docs, n_tokens) over the committed batches."""
        return self._sums(*self._state()).select(*GROUP, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))

    def fold(self) -> bool:
        """Sum the snapshot and the batches since into the next snapshot; False if another writer was first."""
        snapshot, batches = self._state()
        data, listed = f"snapshot-{uuid.uuid4().hex}", f"batches-{uuid.uuid4().hex}"
        self._sums(snapshot, batches).write.parquet(f"{self.folder}/data/{data}")
        rows = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        if snapshot["batches"]:
            rows = rows.unionByName(self.spark.read.schema("batch string").parquet(f"{self.folder}/data/{snapshot['batches']}"))
        rows.write.parquet(f"{self.folder}/data/{listed}")
        return commit_once(self.spark, f"{self.folder}/snapshots/{snapshot['number'] + 1}", json.dumps({"data": data, "batches": listed}))

    def vacuum(self, hours: float = 24.0) -> None:
        """Remove data folders that neither the snapshot nor a later batch names, if older than ``hours``."""
        fs, Path = filesystem(self.spark, self.folder)
        snapshot, batches = self._state()
        live = {content(self.spark, f"{self.folder}/commits/{b}") for b in batches} | {snapshot["data"], snapshot["batches"]}
        before = (time.time() - 3600 * hours) * 1000
        for f in fs.listStatus(Path(f"{self.folder}/data")):
            if f.getPath().getName() not in live and f.getModificationTime() <= before:
                fs.delete(f.getPath(), True)


def counted(documents: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """(uid, doc_id, source, lang, content, one count per tokenizer), staged: texts are read once."""
    counts = [count(F.col("text")).alias(f"n_{i}") for i, count in enumerate(tokenizers.values())]
    content = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return stage(documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "lang", content.alias("content"), *counts), "counts")


def by_tokenizer(rows: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """One row per document and tokenizer."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(f"n_{i}").alias("n_tokens")) for i, t in enumerate(tokenizers)]))
    return rows.select("source", "lang", each.alias("t")).select("source", "lang", "t.tokenizer", "t.n_tokens")


def _digest(rows: DataFrame) -> str:
    """Name of a corpus by its content: the order of its rows doesn't matter, how often a row comes does."""
    counts = [c for c in rows.columns if c.startswith("n_")]
    h = F.xxhash64("doc_id", "source", "lang", "content", *counts)
    parts = [F.sum(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(1 << 31))).alias(f"s{i}") for i in range(4)]
    r = rows.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(":".join(str(x) for x in r).encode()).hexdigest()[:32]


class Contents:
    """Contents of the corpora of a folder, in the order in which they were recorded: one numbered commit each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def recorded(self) -> list[dict]:
        return [json.loads(content(self.spark, f"{self.folder}/order/{n}")) for n in names(self.spark, f"{self.folder}/order")]

    def record(self, corpus: str, contents: DataFrame) -> list[str]:
        """Write the contents of a corpus once; the tables of the corpora recorded before it."""
        known = self.recorded()
        if corpus not in [k["corpus"] for k in known]:
            data = f"{corpus}-{uuid.uuid4().hex}"
            contents.write.parquet(f"{self.folder}/data/{data}")
            while not commit_once(self.spark, f"{self.folder}/order/{len(known):012d}", json.dumps({"corpus": corpus, "data": data})):
                known = self.recorded()
            known = self.recorded()
        return [f"{self.folder}/data/{k['data']}" for k in known[: [k["corpus"] for k in known].index(corpus)]]


def corpus_rollup(documents: DataFrame, folder: str | None = None, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """(group, n_docs, n_tokens, unique_docs, unique_tokens) over the corpora that were added to the folder.

    A corpus is named by its content: the same one again adds nothing, another one adds to what is there, and a call
    that broke off is finished by the next. Two rollups get its load, which counts every tokenizer by the first one,
    the cheapest, and then a batch that revises what the others count differently. A third batch deletes the exact
    copies from the second rollup: all but the row of the least doc_id of the first corpus that has the content.
    """
    spark, folder = documents.sparkSession, folder or shared_dir(documents.sparkSession)
    rows = counted(documents, tokenizers)
    corpus = _digest(rows)
    everything, unique = Rollup(spark, f"{folder}/all"), Rollup(spark, f"{folder}/unique")
    none = F.lit(0).cast("long").alias("old_tokens")
    load = by_tokenizer(rows.withColumns({f"n_{i}": F.col("n_0") for i in range(len(tokenizers))}), tokenizers).select(F.lit("insert").alias("op"), "*", none)
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(f"n_{i}").alias("n_tokens")) for i, t in enumerate(tokenizers)]))
    seen = rows.select("source", "lang", F.col("n_0").alias("old_tokens"), both.alias("t")).select(F.lit("revise").alias("op"), "source", "lang", "t.tokenizer", "t.n_tokens", "old_tokens")
    for rollup in (everything, unique):
        rollup.commit(f"{corpus}-1-load", load)
        rollup.commit(f"{corpus}-2-revise", seen.filter("n_tokens <> old_tokens"))
    if not unique.committed(f"{corpus}-3-copies"):
        earlier = Contents(spark, f"{folder}/contents").record(corpus, rows.select("content").distinct())
        firsts = rows.groupBy("content").agg(F.min_by("uid", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("uid"))).alias("uid"))
        if earlier:
            firsts = firsts.join(spark.read.schema("content string").parquet(*earlier), "content", "left_anti")
        copies = by_tokenizer(rows.join(firsts.select("uid"), "uid", "left_anti"), tokenizers).select(F.lit("delete").alias("op"), "*", none)
        unique.commit(f"{corpus}-3-copies", copies)
    least = unique.totals().select(*[F.col(c).alias(f"u_{c}") for c in GROUP], F.col("n_docs").alias("unique_docs"), F.col("n_tokens").alias("unique_tokens"))
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"u_{c}"))
    return everything.totals().join(least, same).select(*GROUP, "n_docs", "n_tokens", "unique_docs", "unique_tokens")
