"""Tables written between jobs, and files committed once, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
PREFIX = "attesta-"


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder under ``shared_base``."""
    return f"{shared_base(spark)}/{PREFIX}{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete these paths, and let Spark drop the shuffle files of frames that are no longer used."""
    for path in paths:
        fs, Path = filesystem(spark, path)
        fs.delete(Path(path), True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession, hours: float = 48.0) -> int:
    """Delete the staged folders of finished work that are older than ``hours``; their number.

    Results read their last staged tables when they are used, so an operator cannot delete these itself.
    """
    fs, Path = filesystem(spark, shared_base(spark))
    before, gone = (time.time() - 3600 * hours) * 1000, 0
    for f in fs.listStatus(Path(shared_base(spark))):
        if f.getPath().getName().startswith(PREFIX) and f.getModificationTime() <= before:
            gone += bool(fs.delete(f.getPath(), True))
    return gone


def filesystem(spark: SparkSession, path: str):
    """(FileSystem, Path class) of Hadoop for this path."""
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_once(spark: SparkSession, path: str, content: str) -> bool:
    """Make the file path appear whole with content; False, and nothing changed, if it already exists.

    The content is written beside it and renamed without overwriting, so a lost writer leaves no half commit.
    """
    from py4j.protocol import Py4JJavaError

    fs, Path = filesystem(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = Path(f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, Path(path), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "AlreadyExists" in str(error.java_exception):
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, without reading them; none if it does not exist."""
    fs, Path = filesystem(spark, folder)
    if not fs.exists(Path(folder)):
        return []
    found = (f.getPath().getName() for f in fs.listStatus(Path(folder)))
    return sorted(n for n in found if not n.startswith("_"))


def content(spark: SparkSession, path: str) -> str:
    """Text of a small file."""
    fs, Path = filesystem(spark, path)
    opened = fs.open(Path(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()
