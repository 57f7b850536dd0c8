"""Reads that are safe to use twice: results written to the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from boutline.session import scratch_path, ship, stored

__all__ = ["arrow_schema", "bounded_sample", "bucketed", "held_out", "hot_join", "map_arrow", "spread_join", "stored", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write a table in hash buckets below the shared folder and read it back: joins on ``key`` then shuffle the other side only.

    There are as many buckets as shuffle partitions. Nothing is shuffled to write them; the catalog's entry lasts no longer than
    this call, the files as long as the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = "boutline_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def map_arrow(df: DataFrame, task, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to record batches (or dicts of columns)."""
    kinds = arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for out in task(batch):
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in schema.split(","))])


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text falls into ``fold``; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, evenly by the key's hash; all of them if there are no more than that.

    A threshold from one count thins the rows first, so that the final order and limit see about ``most`` rows however
    large the input is.
    """
    count = rows.count()
    place = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    share = min(1.0, 1.1 * most / max(1, count))
    near = rows.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else rows
    return near.orderBy(place, key).limit(most)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """Inner or left join of ``many`` with ``one``, which has few rows per key: a frequent key's rows of ``many`` go to ``salts``
    partitions by their column ``by``, and each of them gets a copy of the key's rows. The result is the plain join's."""
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, [*keys, "__salt"], how).drop("__salt")


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, most: int = 4096) -> DataFrame:
    """`spread_join` for wide rows of ``one``: only the keys with over ``most`` rows of ``many`` get copies, one for each ``most`` of them.

    The list of these keys is at most one in ``most`` rows of ``many`` and goes to every task.
    """
    hot = F.broadcast(many.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).where("__parts > 1"))
    left = many.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
