"""Review edits over the span table, one by one or replayed from a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import entity_groups, group_id


def _set(spans: DataFrame, on: Column, **values: Column) -> DataFrame:
    return spans.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in values.items()})


def set_category_status(spans: DataFrame, category: str, status: str) -> DataFrame:
    return _set(spans, F.col("category") == category, status=F.lit(status))


def set_entity_status(spans: DataFrame, on: Column, status: str) -> DataFrame:
    return _set(spans, on, status=F.lit(status))


def set_group_status(spans: DataFrame, group: str | Column, status: str) -> DataFrame:
    return _set(spans, F.col("entity_group_id") == group, status=F.lit(status))


def set_entity_category(spans: DataFrame, on: Column, category: str) -> DataFrame:
    """The span's own text becomes canonical, and its group the one of that value."""
    return _set(spans, on, category=F.lit(category), canonical_text=F.col("text"), entity_group_id=group_id(F.lit(category), F.col("text")))


def _adopt(spans: DataFrame, on: Column, group: Column, id_col: str) -> DataFrame:
    """Spans for which ``on`` holds take category and label of the group named by ``group``; unknown groups change nothing."""
    groups = entity_groups(spans, id_col=id_col).select(F.col(id_col).alias("d__"), F.col("entity_group_id").alias("g__"), F.col("category").alias("c__"), F.col("label").alias("l__"))
    rows = spans.withColumn("to__", F.when(on, group))
    rows = rows.join(groups, (F.col(id_col) == F.col("d__")) & (F.col("to__") == F.col("g__")), "left")
    return _set(rows, F.col("g__").isNotNull(), category=F.col("c__"), canonical_text=F.col("l__"), entity_group_id=F.col("g__")).drop("to__", "d__", "g__", "c__", "l__")


def assign_to_group(spans: DataFrame, on: Column, group: str | Column, *, id_col: str = "doc_id") -> DataFrame:
    return _adopt(spans, on, F.lit(group), id_col)


def create_group(spans: DataFrame, on: Column) -> DataFrame:
    return _set(spans, on, entity_group_id=F.concat(F.lit("manual-group-"), F.col("id")))


def merge_groups(spans: DataFrame, source: str | Column, target: str | Column, *, id_col: str = "doc_id") -> DataFrame:
    """All spans of the source group adopt the target; nothing happens if they are the same or the target is unknown."""
    source, target = F.lit(source), F.lit(target)
    return _adopt(spans, (F.col("entity_group_id") == source) & (source != target), target, id_col)


def add_manual(spans: DataFrame, docs: DataFrame, ranges: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of ``ranges`` (id, start, end, category, group or null) join the table; the id uses the range's category, the rest its group's."""
    groups = entity_groups(spans, id_col=id_col).select(F.col(id_col), F.col("entity_group_id").alias("group"), F.col("category").alias("c__"), F.col("label").alias("l__"))
    rows = ranges.join(docs.select(id_col, F.col(text_col).alias("t__")), id_col).join(groups, [id_col, "group"], "left")
    text = F.expr("substring(t__, start + 1, end - start)")
    key = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"), "category")
    most = spans.groupBy(id_col).agg(F.max("idx").alias("most"))
    new = rows.join(most, id_col, "left").select(
        id_col, "start", "end", text.alias("text"), F.coalesce("c__", "category").alias("category"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.lit("not_applicable").alias("validation"), F.lit("accepted").alias("status"),
        F.when(F.col("c__").isNotNull(), F.col("group")).otherwise(F.concat(F.lit("manual-group-"), key)).alias("entity_group_id"), F.coalesce("l__", text).alias("canonical_text"), F.concat(F.lit("manual-"), key).alias("id"), (F.coalesce("most", F.lit(-1)) + 1).cast("int").alias("idx"))
    return spans.unionByName(new, allowMissingColumns=True)


def replay(spans: DataFrame, edits: list[tuple], *, id_col: str = "doc_id") -> DataFrame:
    """Applies (operation, *arguments) in order; spans are named by their id."""
    named = lambda key: F.col("id") == key
    for op, *args in edits:
        if op == "category_status":
            spans = set_category_status(spans, *args)
        elif op == "entity_status":
            spans = set_entity_status(spans, named(args[0]), args[1])
        elif op == "group_status":
            spans = set_group_status(spans, *args)
        elif op == "entity_category":
            spans = set_entity_category(spans, named(args[0]), args[1])
        elif op == "assign":
            spans = assign_to_group(spans, named(args[0]), args[1], id_col=id_col)
        elif op == "new_group":
            spans = create_group(spans, named(args[0]))
        elif op == "merge":
            spans = merge_groups(spans, *args, id_col=id_col)
        else:
            raise ValueError(f"unknown edit {op!r}")
    return spans
