"""Spans: normalising, filtering, grouping, numbering, counting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import ORDER, categories, token_prefix


def group_id(category: Column, canonical: Column) -> Column:
    return F.concat(F.lit("value:"), category, F.lit(":"), canonical)


def normalize(spans: DataFrame, docs: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds idx (input order within a document), id, and defaults for whatever is missing.

    With ``docs`` the document's own slice wins over the span's text unless it is empty.
    """
    have = set(spans.columns)
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = spans if "idx" in have else spans.withColumn("idx", (F.row_number().over(Window.partitionBy(id_col).orderBy("start", "end", "category")) - 1).cast("int"))
    if docs is not None:
        texts = docs.select(F.col(id_col), F.col(text_col).alias("text__"))
        cut = F.expr("substring(text__, start + 1, end - start)")
        rows = rows.join(texts, id_col).withColumn("text", F.coalesce(F.nullif(cut, F.lit("")), F.col("text"))).drop("text__")
    canonical = F.coalesce(own("canonical_text"), F.col("text"))
    return rows.withColumns({
        "id": F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"), "category", F.col("idx").cast("string")),
        "source": F.coalesce(own("source"), F.lit("regex")),
        "status": F.coalesce(own("status"), F.lit("accepted")),
        "entity_group_id": F.coalesce(own("entity_group_id"), group_id(F.col("category"), canonical)),
        "canonical_text": canonical,
    })


def to_wire(spans: DataFrame) -> DataFrame:
    return spans.drop("id", "idx")


def reject_excluded(spans: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """Spans of excluded categories become rejected; others, a null status included, stay."""
    return spans.withColumn("status", F.when(F.col("category").isin(*excluded), "rejected").otherwise(F.col("status")))


def accepted(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("status") == "accepted")


def accepted_leniently(spans: DataFrame) -> DataFrame:
    """As the history counts: anything but a rejection in any case, a missing status included."""
    return spans.filter(F.lower(F.coalesce("status", F.lit("accepted"))) != "rejected")


def entity_groups(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document and group; label and category from the group's first input row."""
    return spans.groupBy(id_col, "entity_group_id").agg(
        F.min_by("category", "idx").alias("category"),
        F.min_by("canonical_text", "idx").alias("label"),
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "accepted").alias("n_accepted"),
        F.count_if(F.col("status") == "rejected").alias("n_rejected"),
        F.min_by("id", F.struct("start", "idx")).alias("first_id"),
        F.min("start").alias("first_start"),
        F.min("idx").alias("first_idx"),
    )


def numbered_groups(groups: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Adds prefix, number and token: counted by prefix in the order of first start, then label."""
    rows = groups.withColumn("prefix", token_prefix(F.col("category")))
    number = F.row_number().over(Window.partitionBy(id_col, "prefix").orderBy("first_start", "label", "first_idx"))
    return rows.withColumn("number", number).withColumn("token", F.concat(F.lit("["), "prefix", F.lit("_"), F.col("number").cast("string"), F.lit("]")))


def count_by_category(spans: DataFrame) -> DataFrame:
    return spans.groupBy("category").agg(F.count("*").alias("n"))


def category_legend(spans: DataFrame) -> DataFrame:
    """Categories present in display order, without public institutions: count, on (any accepted), total over all."""
    per = spans.groupBy("category").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "accepted").alias("is_on"))
    per = per.filter(F.col("category") != "PUBLIC_INSTITUTION").join(F.broadcast(categories(spans.sparkSession).select("category", "ord")), "category")
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy("ord")


def category_sections(groups: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Sections of a document's groups: category order, groups, those with an accepted span; public institutions apart."""
    dim = F.broadcast(categories(groups.sparkSession).select("category", "ord"))
    per = groups.groupBy(id_col, "category").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n_accepted") > 0).alias("n_marked"))
    return per.join(dim, "category").withColumn("apart", F.col("category") == "PUBLIC_INSTITUTION")


def uncertain_groups(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Groups with at least one failed check."""
    return spans.groupBy(id_col, "entity_group_id").agg(F.bool_or(F.col("validation") == "failed").alias("u")).filter("u").drop("u")


def category_order(names: Iterable[str]) -> list[str]:
    """Known categories among ``names``, once each, in display order."""
    return sorted({n for n in names if n in ORDER}, key=ORDER.__getitem__)


def case_numbering(spans: DataFrame, *, case_col: str, id_col: str = "doc_id", seed: DataFrame | None = None) -> DataFrame:
    """Tokens shared by all documents of a case: (case, entity_group_id, category, label, prefix, number, token).

    Documents are ordered by id.  A group's place is its first occurrence, so no document has to wait
    for the one before.  ``seed`` (case, token, category, canonical_text) keeps its tokens; new groups
    go on behind the largest number of their prefix.
    """
    first = spans.groupBy(case_col, "entity_group_id").agg(F.min(F.struct(id_col, "start", "idx")).alias("at"), F.min_by("category", F.struct(id_col, "start", "idx")).alias("category"), F.min_by("canonical_text", F.struct(id_col, "start", "idx")).alias("label"))
    first = first.withColumn("prefix", token_prefix(F.col("category")))
    named = lambda df: df.withColumn("token", F.concat(F.lit("["), "prefix", F.lit("_"), F.col("number").cast("string"), F.lit("]")))
    columns = [case_col, "entity_group_id", "category", "label", "prefix", "number", "token"]
    by_place = Window.partitionBy(case_col, "prefix").orderBy("at")
    if seed is None:
        return named(first.withColumn("number", F.row_number().over(by_place))).select(*columns)
    old = seed.select(case_col, "category", group_id(F.col("category"), F.col("canonical_text")).alias("entity_group_id"), F.col("canonical_text").alias("label"), token_prefix(F.col("category")).alias("prefix"), F.regexp_extract("token", r"_([0-9]+)\]$", 1).cast("int").alias("number"), "token")
    most = old.groupBy(case_col, "prefix").agg(F.max("number").alias("most"))
    new = first.join(old, [case_col, "entity_group_id"], "left_anti").join(most, [case_col, "prefix"], "left")
    new = named(new.withColumn("number", F.row_number().over(by_place) + F.coalesce("most", F.lit(0))))
    return new.select(*columns).unionByName(old.select(*columns))
