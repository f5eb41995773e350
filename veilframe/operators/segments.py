"""Blocks of text, and texts as sequences of plain and marked segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import ORDER

CHUNK, PAGE = 5000, 32


def split_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(idx, block_id, start, end, page, text): split behind each form feed or run of two or more line feeds, then every ``chunk`` characters.

    A form feed ends a page.  Empty and null texts have no blocks.
    """
    parts = F.split(F.col(text_col), r"(?<=\f)|(?<=\n\n)(?!\n)", -1)
    rows = docs.filter(F.length(text_col) > 0).select(id_col, F.posexplode(parts).alias("part", "piece")).filter("piece <> ''")
    order = Window.partitionBy(id_col).orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit("\f"), F.lit("")))
    rows = rows.withColumns({"at": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)), "page": (F.lit(1) + F.coalesce(F.sum(feeds).over(before), F.lit(0))).cast("int")})
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("piece") - 1) / chunk).cast("int")), lambda i: F.substr(F.col("piece"), i * chunk + 1, F.lit(chunk))))
    rows = rows.select(id_col, "part", "page", "at", cut.alias("k", "text"))
    start = (F.col("at") + F.col("k") * chunk).cast("int")
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy(id_col).orderBy("part", "k")) - 1).cast("int"))
    return rows.select(id_col, "idx", F.concat(F.lit("block-"), F.col("idx").cast("string")).alias("block_id"), start.alias("start"), (start + F.length("text")).alias("end"), "page", "text")


def blocks_for_export(blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    return blocks.select(id_col, "idx", "start", "end", F.lit("paragraph").alias("kind"), "page")


def spans_in_blocks(blocks: DataFrame, spans: DataFrame, *, visible: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Spans clipped to each block that they overlap: (idx, start, end, category, id)."""
    own = spans.filter(F.col("category").isin(*(visible if visible is not None else list(ORDER)))).select(id_col, F.col("start").alias("s"), F.col("end").alias("e"), "category", "id")
    hit = blocks.select(id_col, "idx", F.col("start").alias("bs"), F.col("end").alias("be")).join(own, id_col).filter("e > bs AND s < be")
    return hit.select(id_col, "idx", F.greatest("s", "bs").alias("start"), F.least("e", "be").alias("end"), "category", "id")


def segment_blocks(blocks: DataFrame, spans: DataFrame, *, visible: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(idx, pos, type text or entity, start, end, text, id) of each block; spans must not overlap each other."""
    marked = spans_in_blocks(blocks, spans, visible=visible, id_col=id_col)
    per = marked.groupBy(id_col, "idx").agg(F.sort_array(F.collect_list(F.struct("start", "end", "id"))).alias("marks"))
    return _interleave(blocks.join(per, [id_col, "idx"], "left"), [id_col, "idx"], F.col("start"), F.col("end"), "entity")


def _interleave(rows: DataFrame, keys: list[str], begin, end, kind: str) -> DataFrame:
    """Rows with text and sorted marks (start, end, id) to their segments in order."""
    none = F.lit(None).cast("string")
    seg = lambda type_, a, b, id_: F.struct(F.lit(type_).alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"), id_.alias("id"))
    marks = F.coalesce("marks", F.array().cast("array<struct<start:int,end:int,id:string>>"))
    rows = rows.withColumn("marks", marks).withColumns({"from_": begin, "to_": end})
    inner = F.flatten(F.transform("marks", lambda m, i: F.array(seg("text", F.when(i == 0, F.col("from_")).otherwise(F.get("marks", i - 1)["end"]), m["start"], none), seg(kind, m["start"], m["end"], m["id"]))))
    last = F.when(F.size("marks") == 0, F.col("from_")).otherwise(F.element_at("marks", -1)["end"])
    segments = F.filter(F.concat(inner, F.array(seg("text", last, F.col("to_"), none))), lambda s: s["end"] > s["start"])
    out = rows.select(*keys, "text", "from_", F.posexplode(segments).alias("pos", "s"))
    return out.select(*keys, "pos", "s.type", "s.start", "s.end", F.expr("substring(text, s.start - from_ + 1, s.end - s.start)").alias("text"), "s.id")


def comparison_segments(texts: DataFrame, offsets: DataFrame, side: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pos, type text or replacement, start, end, text, id) of one side, ``original`` or ``anonymized``; id is the token.

    Offsets that start before the last one's end, lie outside or are empty are skipped; ends are clipped.
    """
    own = offsets.select(id_col, F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"), F.col("token").alias("id"))
    per = own.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "id"))).alias("all"))
    rows = texts.select(id_col, F.col(text_col).alias("text")).join(per, id_col, "left").withColumn("n", F.length("text"))
    empty = F.array().cast("array<struct<start:int,end:int,id:string>>")
    fold = F.aggregate(
        F.coalesce("all", empty),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, m: F.when(
            (m["start"] < a["at"]) | (m["start"] < 0) | (m["end"] <= m["start"]) | (m["start"] >= F.col("n")), a
        ).otherwise(F.struct(F.least(m["end"], F.col("n")).alias("at"), F.concat(a["out"], F.array(F.struct(m["start"].alias("start"), F.least(m["end"], F.col("n")).alias("end"), m["id"].alias("id")))).alias("out"))),
        lambda a: a["out"],
    )
    return _interleave(rows.withColumn("marks", fold), [id_col], F.lit(0), F.col("n"), "replacement")


def focus_block(blocks: DataFrame, points: DataFrame, *, id_col: str = "doc_id", per_page: int = PAGE) -> DataFrame:
    """(point_id, idx, page_index): the first block that holds the point."""
    hit = points.select(id_col, "point_id", "point").join(blocks.select(id_col, "idx", "start", "end"), id_col).filter("point >= start AND point < end")
    first = hit.groupBy(id_col, "point_id").agg(F.min("idx").alias("idx"))
    return first.withColumn("page_index", F.floor(F.col("idx") / per_page).cast("int"))


def paginate(blocks: DataFrame, *, id_col: str = "doc_id", per_page: int = PAGE) -> DataFrame:
    """(pages) of each document, one at least, of ``per_page`` blocks."""
    return blocks.groupBy(id_col).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_page)).cast("int").alias("pages"))


def page_of(blocks: DataFrame, index: int, *, id_col: str = "doc_id", per_page: int = PAGE) -> DataFrame:
    """The blocks of a page; an index beyond the last page shows the last one."""
    last = blocks.groupBy(id_col).agg(F.floor(F.max("idx") / per_page).alias("last"))
    shown = F.least(F.lit(max(0, index)), F.col("last"))
    return blocks.join(last, id_col).filter(F.floor(F.col("idx") / per_page) == shown).drop("last")


def selection_range(anchor, focus):
    """(start, end) of a selection in text order; null if nothing is selected."""
    return F.when(anchor != focus, F.struct(F.least(anchor, focus).alias("start"), F.greatest(anchor, focus).alias("end")))
