"""Writers: partitioned chunks, single-schema CSV and JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(df: DataFrame, path: str, by: str, chunk_rows: int) -> None:
    """Files of at most ``chunk_rows`` rows under one folder per value of ``by``. A large value
    is written by several tasks, each of some 64 files."""
    blocks = df.groupBy(by).agg(F.ceil(F.count("*") / (64 * chunk_rows)).cast("int").alias("_blocks"))
    spread = df.join(blocks, df[by].eqNullSafe(blocks[by]), "left").drop(blocks[by]).withColumn("_block", F.pmod(F.xxhash64(*df.columns), F.col("_blocks"))).drop("_blocks")
    spread.repartition(by, "_block").drop("_block").write.mode("errorifexists").option("maxRecordsPerFile", chunk_rows).partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def insert_absent(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` lacks; of repeated keys one."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def manifest(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, bytes, sha256) of the written files."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
