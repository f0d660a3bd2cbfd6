"""Immutable research snapshots: a screen's specification, its day and its result, written once and compared with a rerun."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import screener
from .tables import difference, version

COLUMNS = ["passed", "failed_rules"]


def create(frame: DataFrame, spec: dict, as_of: str, path: str) -> str:
    """Write the summary of a screen under an id made of day and specification; an id that exists is refused."""
    name = f"{as_of}-{version(spec)}"
    head = json.dumps({"spec": spec, "as_of": as_of}, sort_keys=True, ensure_ascii=False)
    # mode errorifexists makes the refusal atomic per snapshot
    screener.summary(frame, spec).withColumn("head", F.lit(head)).write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


def load(spark: SparkSession, path: str, name: str) -> tuple[dict, DataFrame]:
    rows = spark.read.parquet(f"{path}/{name}")
    head = rows.select("head").first()
    return (json.loads(head[0]) if head else {}), rows.drop("head")


def rerun(spark: SparkSession, path: str, name: str, frame: DataFrame) -> DataFrame:
    """What a rerun over today's frame would change; empty if nothing."""
    head, before = load(spark, path, name)
    return difference(before, screener.summary(frame, head["spec"]), ["ts_code"], COLUMNS)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """name, as_of, spec, rows of every snapshot under a path, the latest day first; snapshots of empty results have none."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name"), "head")
    return rows.groupBy("name").agg(F.max(F.get_json_object("head", "$.as_of")).alias("as_of"), F.max(F.get_json_object("head", "$.spec")).alias("spec"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("as_of"), "name")
