"""Putting values back: one pass over the tokens of a text, never over what was put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M


def _parts(text: str):
    """Texts between tokens, one more than there are tokens."""
    return F.split(F.col(text), M.TOKEN, -1)


def _restored(rows: DataFrame, text: str) -> DataFrame:
    """Adds original_text and warnings to rows that hold a text and its map's ``entries``."""
    table = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["token"], e["canonical_text"])))
    rows = rows.withColumns({"gaps": _parts(text), "tokens": M.tokens_in(F.col(text)), "table": F.coalesce(table, F.create_map().cast("map<string,string>"))})
    back = F.transform("tokens", lambda t: F.coalesce(F.try_element_at(F.col("table"), t), t))
    joined = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("tokens")), back, lambda g, t: F.concat(g, t)), ""), F.element_at("gaps", -1))
    offset = lambda i: F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("tokens", 1, i), F.lit(0), lambda a, t: a + F.length(t))
    unknown = F.filter(F.transform("tokens", lambda t, i: F.when(~F.map_contains_key(F.col("table"), t), F.concat(F.lit("Unknown anonymization token "), t, F.lit(" at offset "), offset(i).cast("string"), F.lit(".")))), lambda w: w.isNotNull())
    return rows.withColumns({"original_text": joined, "warnings": unknown}).drop("gaps", "tokens", "table")


def deanonymize(texts: DataFrame, maps: DataFrame, *, id_col: str = "doc_id", text_col: str = "anonymized_text") -> DataFrame:
    """(id, original_text, warnings); ``maps`` has one row of (id, entries) per document at most.

    Known tokens become their canonical text; each unknown one stays and gives a warning with its offset.
    """
    rows = texts.select(id_col, text_col).join(maps.select(id_col, "entries"), id_col, "left")
    return _restored(rows, text_col).select(id_col, "original_text", "warnings")


def restored_segments(texts: DataFrame, entries: DataFrame, *, id_col: str = "doc_id", text_col: str = "anonymized_text") -> DataFrame:
    """Segments of the restored text in order: (pos, type text or restored, token, text, start, end)."""
    rows = texts.select(id_col, _parts(text_col).alias("gaps"), M.tokens_in(F.col(text_col)).alias("tokens"))
    pairs = rows.select(id_col, F.posexplode(F.arrays_zip("gaps", F.concat("tokens", F.array(F.lit(None).cast("string"))).alias("tokens"))).alias("k", "p")).select(id_col, "k", F.col("p.gaps").alias("gap"), F.col("p.tokens").alias("token"))
    known = pairs.join(entries.select(id_col, "token", "canonical_text"), [id_col, "token"], "left")
    piece = known.select(id_col, "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("token"), F.col("gap").alias("text")),
        F.struct(F.lit(1).alias("side"), F.when(F.col("canonical_text").isNull(), "text").otherwise("restored").alias("type"), F.when(F.col("canonical_text").isNotNull(), F.col("token")).alias("token"), F.coalesce("canonical_text", "token").alias("text")),
    )).alias("s")).select(id_col, "k", "s.*").filter("text <> ''")
    order = Window.partitionBy(id_col).orderBy("k", "side")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return piece.select(id_col, (F.row_number().over(order) - 1).alias("pos"), "type", "token", "text", before.alias("start"), (before + F.length("text")).alias("end"))


def _unknown(text: str, warnings: str | None) -> Column:
    """Tokens of rows with ``entries`` that stay unrestored, those that ``warnings`` names first."""
    known = F.coalesce(F.transform("entries", lambda e: e["token"]), F.array().cast("array<string>"))
    found = M.unrestorable(F.col(text), known)
    return F.array_union(M.warned_tokens(F.col(warnings)), found) if warnings else found


def restore_warnings(texts: DataFrame, maps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", warnings_col: str | None = None, subject: str = "file") -> DataFrame:
    """(id, tokens, message): tokens that stay unrestored, those that ``warnings_col`` names first."""
    rows = texts.join(maps.select(id_col, "entries"), id_col, "left")
    return rows.select(id_col, _unknown(text_col, warnings_col).alias("tokens")).withColumn("message", M.token_warning(F.col("tokens"), subject))


def restore_with_warnings(texts: DataFrame, maps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", subject: str = "file") -> DataFrame:
    """(id, original_text, message) of the documents that have a map: ``deanonymize`` and ``restore_warnings`` in one pass over the texts."""
    rows = _restored(texts.select(id_col, text_col).join(maps.select(id_col, "entries"), id_col), text_col)
    return rows.select(id_col, "original_text", _unknown(text_col, "warnings").alias("tokens")).select(id_col, "original_text", M.token_warning(F.col("tokens"), subject).alias("message"))
