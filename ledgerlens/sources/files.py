"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    """One or many files or folders; only the named columns are read."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(*paths)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Snappy files; an earlier result at the path is replaced."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def union_history(parts: Sequence[tuple[DataFrame, int]], session_type: str = "long") -> DataFrame:
    """UNION ALL of (transactions, is_train) with one schema: the session id in one type and is_train as given."""
    out = None
    for df, is_train in parts:
        df = df.withColumns({"session_id": F.col("session_id").cast(session_type), "is_train": F.lit(is_train).cast("int")})
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no tables to unite")
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def archive(spark: SparkSession, folder: str) -> str | None:
    """Rename an existing folder to <folder>_ver_<N>, N the first free number; returns the new name, or None if there is nothing."""
    files, old = _file_system(spark, folder)
    if not files.exists(old):
        return None
    n = 1
    while files.exists(_file_system(spark, f"{folder}_ver_{n}")[1]):
        n += 1
    files.rename(old, _file_system(spark, f"{folder}_ver_{n}")[1])
    return f"{folder}_ver_{n}"


def cached(spark: SparkSession, path: str, meta: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was built with the same meta text, else build() written there with it."""
    files, note = _file_system(spark, f"{path}/_META")
    if not (files.exists(note) and spark.read.text(f"{path}/_META").first()[0] == meta):
        write_parquet(build(), f"{path}/data")
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_META")
    return spark.read.parquet(f"{path}/data")
