"""Reading inputs, and cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded(spark: SparkSession) -> None:
    """Hand texts to Python in batches of bounded size, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='finlattice-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*kept: DataFrame) -> None:
    """Delete tables made by keep() that no later step reads."""
    for df in kept:
        jvm = df.sparkSession._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch with its text column as UTF-8 bytes."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).cast(pa.large_binary()).to_pylist()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole key groups from a stream sorted by key (keys not null); a group is never cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        if held and held[-1].column(key)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        low, high = 0, batch.num_rows - 1  # first row of the last group
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if keys[mid] == last else (mid + 1, high)
        if low:
            held.append(batch.slice(0, low))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_bucket(column: str, n: int):
    """A spread-out bucket number from an id."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def without(docs: DataFrame, ids: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs whose doc_id is not in ids (a kept table of one column); null ids stay.

    The ids are broadcast only if they are few enough, else both sides are shuffled.
    """
    ids = ids.toDF("doc_id")
    few = ids.count() <= most_broadcast
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_anti")
