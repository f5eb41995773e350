"""The history of finished documents, a Parquet table with one row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import accepted_leniently

SCHEMA = "id bigint, created_at timestamp, filename string, format string, source string, entity_count int, replacement_count int, session_json string, offset_map_json string"


def sessions(docs: DataFrame, spans: DataFrame, maps: DataFrame, created_at, *, id_col: str = "doc_id") -> DataFrame:
    """Rows to save: names with defaults, counts of accepted spans (leniently) and of map entries, the session as JSON."""
    have = set(docs.columns)
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    n = accepted_leniently(spans).groupBy(id_col).agg(F.count("*").cast("int").alias("entity_count"))
    rows = docs.withColumn("created_at", created_at).join(n, id_col, "left").join(maps.select(id_col, "entries"), id_col, "left")
    return rows.select(
        F.col(id_col).cast("long").alias("id"), "created_at", own("filename", "dokument").alias("filename"), own("format", "txt").alias("format"), own("doc_source", "parsed").alias("source"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce(F.size("entries"), F.lit(0)).cast("int").alias("replacement_count"), F.to_json(F.struct("entries")).alias("session_json"), F.lit("[]").alias("offset_map_json"))


def save(rows: DataFrame, path: str, *, enabled: bool = True) -> DataFrame | None:
    """Appends, if the user wants a history at all; returns what was saved."""
    if not enabled:
        return None
    rows.write.mode("append").parquet(path)
    return rows


def load(spark: SparkSession, path: str) -> DataFrame:
    """Older files lack the offset map: it reads as an empty list."""
    rows = spark.read.schema(SCHEMA).option("mergeSchema", "true").parquet(path)
    return rows.withColumn("offset_map_json", F.coalesce("offset_map_json", F.lit("[]")))


def listing(history: DataFrame) -> DataFrame:
    """Newest first; within one second the larger id first."""
    order = [F.date_trunc("second", F.col("created_at")).desc(), F.col("id").desc()]
    return history.select("id", "created_at", "filename", "format", "source", "entity_count", "replacement_count").orderBy(*order)


def latest(history: DataFrame, n: int = 1) -> DataFrame:
    return listing(history).limit(n)


def parsed(history: DataFrame, schema: str) -> DataFrame:
    return history.withColumn("session", F.from_json("session_json", schema))


def get(history: DataFrame, key: int, schema: str) -> DataFrame:
    """The parsed session of one row; no row if there is none."""
    return parsed(history.filter(F.col("id") == key), schema)


def delete(history: DataFrame, key: int | None = None) -> DataFrame:
    """What is left without that row; without a key nothing."""
    return history.filter(F.lit(False) if key is None else F.col("id") != key)


def usage(history: DataFrame) -> DataFrame:
    """Requests and documents by month (the period is our choice)."""
    return history.groupBy(F.date_trunc("month", F.col("created_at")).alias("period")).agg(F.count("*").alias("requests"), F.countDistinct("filename").alias("documents"))
