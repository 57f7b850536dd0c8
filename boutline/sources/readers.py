"""File and table sources and sinks."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv_checked(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV (also gzip) whose header must match the schema; a bad value or header fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_first(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """The first location of a list that exists."""
    for path in paths:
        try:
            return read_csv_checked(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(", ".join(paths))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_table(spark: SparkSession, url: str, table: str, where: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """JDBC table; the predicate reaches the database.  ``partition`` is (column, low, high, parts)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition:
        column, low, high, parts = partition
        reader = (reader.option("partitionColumn", column).option("lowerBound", low)
                  .option("upperBound", high).option("numPartitions", parts))
    return reader.load().where(where)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot by name below a folder, with its name: a file, or a folder of part files."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(/part-[^/]*)?$", 1)
    named = df.select("*", name.alias("file_name"))
    newest = df.select(name.alias("file_name")).agg(F.max("file_name").alias("file_name"))
    return named.join(F.broadcast(newest), "file_name", "left_semi")


def with_provenance(df: DataFrame, source: str) -> DataFrame:
    """Source name, fetch time and file of each row; call it right after a file scan."""
    return df.select("*", F.lit(source).alias("source"), F.current_timestamp().alias("fetched_at"),
                     F.col("_metadata.file_path").alias("raw_path"))


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; absent ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace only the partitions the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
