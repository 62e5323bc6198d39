"""Sources and sinks: driver tables, nested quote payloads, and idempotent Parquet writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "struct<name:string,description:string,price:double,point:double,multiplier:double>"
PAYLOAD = f"id string, sport_key string, commence_time timestamp, home_team string, away_team string, bookmakers array<struct<key:string,title:string,last_update:timestamp,markets:array<struct<key:string,last_update:timestamp,outcomes:array<{OUTCOME}>>>>>"


class Tables:
    """Tables of a folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def quote_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of landed JSON payloads (S-01, S-03), one row for each outcome; a payload whose bookmakers isn't a
    list comes out once with drift true (D-02)."""
    raw = spark.read.text(path, wholetext=True).withColumn("p", F.from_json("value", PAYLOAD))
    shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.bookmakers", "variant"))
    rows = raw.withColumn("drift", ~F.coalesce(shape.startswith("ARRAY"), F.lit(False)))
    books = rows.select(F.col("p.id").alias("event_id"), F.col("p.commence_time").alias("commence_time"), "drift", F.explode_outer("p.bookmakers").alias("b"))
    markets = books.select("event_id", "commence_time", "drift", F.col("b.key").alias("book"), F.explode_outer("b.markets").alias("m"))
    outcomes = markets.select("event_id", "commence_time", "drift", "book", F.col("m.key").alias("market"), F.col("m.last_update").alias("provider_time"), F.explode_outer("m.outcomes").alias("o"))
    return outcomes.select("event_id", "commence_time", "drift", "book", "market", "provider_time", F.col("o.name").alias("side"), F.col("o.description").alias("player"), F.col("o.price").alias("price"), F.col("o.point").alias("point"), F.col("o.multiplier").alias("multiplier"))


def replace_scope(rows: DataFrame, path: str, by: list[str]) -> None:
    """Delete and replace (S-13, S-14): only partitions that rows has are overwritten, so a retry does no harm."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Append sink of a run (S-08, S-17, S-18): a partition by run id, written once however often it is tried."""
    replace_scope(rows.withColumn("run_id", F.lit(run_id)), path, ["run_id"])


def insert_missing(rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet (S-10)."""
    return rows.join(current.select(*keys), keys, "left_anti")
