"""Reports that hold tokens and counts, never a value of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODE = "category tokens with a number, such as [OSOBA_1]"


def token_report(offsets: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(token, category, occurrences, pos): by label, or else token; category of the last occurrence, pos is the first one's order."""
    label = F.coalesce(F.col("label"), F.col("token")) if "label" in offsets.columns else F.col("token")
    return offsets.select(id_col, label.alias("token"), "category", "original_start").groupBy(id_col, "token").agg(F.max_by("category", "original_start").alias("category"), F.count("*").alias("occurrences"), F.min("original_start").alias("pos"))


def count_report(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(detected, rejected, manual): the first two among spans that were not added by hand."""
    proposed = F.col("source") != "manual"
    return spans.groupBy(id_col).agg(F.count_if(proposed).alias("detected"), F.count_if(proposed & (F.col("status") == "rejected")).alias("rejected"), F.count_if(~proposed).alias("manual"))


def report(docs: DataFrame, offsets: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", version: str = "", excluded: list[str] | None = None) -> DataFrame:
    """One row per document: fingerprint, version, mode, counts, excluded categories, and its tokens in order of first appearance."""
    tokens = token_report(offsets, id_col=id_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "category", "occurrences"))).alias("t"))
    tokens = tokens.select(id_col, F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["category"].alias("category"), x["occurrences"].alias("occurrences"))).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = docs.select(id_col, F.sha2(F.col(text_col), 256).alias("source_sha256")).join(count_report(spans, id_col=id_col), id_col, "left").join(tokens, id_col, "left")
    return rows.select(id_col, "source_sha256", F.lit(version or "unknown").alias("app_version"), F.lit(MODE).alias("mode"), zero("detected"), zero("rejected"), zero("manual"), F.array(*[F.lit(c) for c in excluded or []]).cast("array<string>").alias("excluded_categories"), "tokens")


def occurrence_count(docs: DataFrame, offsets: DataFrame, maps: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Replacements of a document, or else its map's entries."""
    n = offsets.groupBy(id_col).agg(F.count("*").alias("n"))
    rows = docs.select(id_col).join(n, id_col, "left").join(maps.select(id_col, F.size("entries").alias("e")), id_col, "left")
    return rows.select(id_col, F.coalesce(F.nullif(F.col("n"), F.lit(0)), "e", F.lit(0)).cast("long").alias("occurrences"))
