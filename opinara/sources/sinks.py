"""Writers: stage tables, JSON lines, CSV packs, reports; all by executors."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite through a new folder and a rename, so a failed run leaves the old table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    df.write.mode("overwrite").parquet(path + ".new")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pack(tables: dict[str, DataFrame], folder: str, stamped: bool = True, files: int | None = None) -> dict[str, str]:
    """One folder of CSV files a table (header, UTF-8 with a byte-order mark) in a dated folder, written by executors.

    ``files``: so many files a table (1 for small packs that a spreadsheet opens).
    """
    target = f"{folder.rstrip('/')}/{datetime.now(UTC).strftime('%Y%m%d_%H%M%S')}" if stamped else folder.rstrip("/")
    out = {}
    for name, df in tables.items():
        out[name] = path = f"{target}/{name}.csv"
        # the mark stands before the header, which starts every file
        marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
        (marked.coalesce(files) if files else marked).write.mode("overwrite").option("header", True).csv(path)
    return out


def preview(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """The first rows of a pack's table."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("\ufeff")).limit(most)


def stage_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``name, path, exists`` of the tables that a pack should hold."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in names:
        where = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.csv")
        rows.append((name, where.toString(), bool(where.getFileSystem(conf).exists(where))))
    return spark.createDataFrame(rows, "name string, path string, exists boolean")


def report(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as one JSON document."""
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
