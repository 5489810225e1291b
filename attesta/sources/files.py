"""Readers of parsed documents, gold tables and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string,page_no:int>"
DOCUMENT = f"""source_pdf string, title string, page_count int, full_text string,
 sections array<struct<heading:string,level:int,text:string,page:int,bbox:{BBOX}>>,
 tables array<struct<self_ref:string,page:int,bbox:{BBOX},caption:string,cells array<struct<row:int,col:int,text:string,column_header:boolean,row_header:boolean,bbox:{BBOX}>>>>,
 offsets array<struct<start:int,end:int,page:int,bbox:{BBOX},kind:string,label:string,section:string>>""".replace("cells array<", "cells:array<")
CALL = "call_id string, ts double, stage string, model string, run_id string, tokens_in long, tokens_out long, cost_usd double, error string"


def read_parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document; corrupt files are skipped. Adds doc (the file's stem)."""
    rows = spark.read.schema(DOCUMENT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.filter("_corrupt_record is null").drop("_corrupt_record")
    return rows.withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with epoch seconds in ts."""
    return spark.read.schema(CALL).json(path).withColumn("ts", F.timestamp_seconds("ts"))


def read_gold(spark: SparkSession, path: str, renames: dict[str, str], key: str = "Cohort ID") -> DataFrame:
    """A CSV with header; a byte-order mark and blanks around names are dropped, rows without key too."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    rows = rows.filter(F.trim(F.coalesce(F.col(f"`{key}`"), F.lit(""))) != "")
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in renames.items() if old in rows.columns])


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
