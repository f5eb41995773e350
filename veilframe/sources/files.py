"""Files of a folder as rows, and stores of maps, rules and prompts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.categories import ORDER, categories
from ..operators.maplink import parse_maps

MOST_BYTES = 50 << 20


def scan_folder(spark: SparkSession, folder: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, name, extension, mime, length, modified) of supported files below a folder, none above the size limit, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return list_files(files, most_bytes=most_bytes).orderBy("name", "path")


def list_files(files: DataFrame, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    name = N.file_of(F.col("path"))
    rows = files.withColumn("name", name).filter(N.is_supported(F.col("name")) & (F.col("length") <= most_bytes))
    return rows.withColumns({"extension": N.extension(F.col("name")), "mime": N.mime_of(F.col("name"))})


def read_texts(spark: SparkSession, folder: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Whole text files as documents: path, filename, format, source, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.filter((N.extension(F.col("path")) == "txt") & (F.col("length") <= most_bytes))
    return rows.select("path", N.file_of(F.col("path")).alias("filename"), F.lit("txt").alias("format"), F.lit("parsed").alias("source"), F.decode("content", "UTF-8").alias("text"))


def read_maps(spark: SparkSession, folder: str, *, strict: bool = True) -> DataFrame:
    """Maps of the JSON files below a folder; those that are none, or encrypted, are skipped."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder).select(F.col("value").alias("json"), N.file_of(F.col("_metadata.file_path")).alias("map_file_name"))
    return parse_maps(files, strict=strict).filter(F.col("entries").isNotNull()).drop("json")


def remember_map(rows: DataFrame, path: str, key: bytes, *, enabled: bool = True) -> DataFrame | None:
    """Appends maps that have entries, with their JSON encrypted, as ``<ms>-<8 hex digits>``; never in plain text."""
    if not enabled:
        return None
    own = rows.filter(F.size("entries") > 0)
    name = F.concat(F.unix_millis("saved_at").cast("string"), F.lit("-"), F.substr(F.sha2(F.to_json("entries"), 256), F.lit(1), F.lit(8)))
    sealed = F.aes_encrypt(F.to_json("entries").cast("binary"), F.lit(key), F.lit("GCM"))
    out = own.select("saved_at", "source_name", "output_name", name.alias("map_file_name"), sealed.alias("sealed"))
    out.write.mode("append").parquet(path)
    return out


def excluded_categories(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Known categories of JSON arrays of names, in display order; malformed rows and unknown names drop out."""
    names = rows.select(F.explode(F.from_json(json_col, "array<string>")).alias("category")).distinct()
    return F.broadcast(categories(rows.sparkSession).select("category", "ord")).join(names, "category", "left_semi").orderBy("ord")


def prompts(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Templates: (id, title, category, description, body, tags, version)."""
    return spark.createDataFrame(list(rows), "id string, title string, category string, description string, body string, tags array<string>, version string")


def spread(docs: DataFrame, *, key: str | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """Small inputs dealt to all cores, as a file of one row group is one task; large ones stay as their files are split."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores, *([key] if key else [])) if size < cores * task_bytes else docs


def nonblank(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.filter(F.trim(F.regexp_replace(text_col, r"\s+", " ")) != "")


def engine_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok", sorted(ORDER, key=ORDER.__getitem__))], "status string, categories array<string>")
