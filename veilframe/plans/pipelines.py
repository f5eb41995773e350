"""Anonymising, restoring and sharing a case, from documents to results."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import anonymize as A
from ..operators import maplink, restore
from ..operators.detect import detect
from ..operators.filenames import anonymize_name
from ..operators.spans import accepted, case_numbering, normalize, reject_excluded
from ..scratch import Scratch


class Anonymized(NamedTuple):
    spans: DataFrame
    tokens: DataFrame
    texts: DataFrame
    offsets: DataFrame
    entries: DataFrame
    maps: DataFrame


def anonymize_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories: Iterable[str] | None = None, excluded: Iterable[str] = (), rules: Iterable[tuple[str, str]] = (), profile: str = "standard") -> Anonymized:
    spans = normalize(detect(docs, id_col=id_col, text_col=text_col, categories=categories, rules=rules, profile=profile), id_col=id_col)
    return from_spans(docs, reject_excluded(spans, excluded) if excluded else spans, id_col=id_col, text_col=text_col)


def from_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokens: DataFrame | None = None) -> Anonymized:
    tokens = A.with_tokens(spans, id_col=id_col) if tokens is None else tokens
    entries = A.map_entries(tokens, id_col=id_col)
    return Anonymized(spans, tokens, A.anonymize(docs, tokens, id_col=id_col, text_col=text_col), A.offset_map(tokens, id_col=id_col), entries, A.replacement_maps(entries, docs, id_col=id_col, text_col=text_col))


def anonymize_case(docs: DataFrame, spans: DataFrame, *, case_col: str, id_col: str = "doc_id", text_col: str = "text", seed: DataFrame | None = None) -> Anonymized:
    """All documents of a case share tokens; ``seed`` carries an earlier map of the case on."""
    own = accepted(spans).join(docs.select(id_col, case_col), id_col)
    numbers = case_numbering(own, case_col=case_col, id_col=id_col, seed=seed)
    tokens = own.join(numbers.select(case_col, "entity_group_id", "token"), [case_col, "entity_group_id"])
    return from_spans(docs, spans, id_col=id_col, text_col=text_col, tokens=tokens)


def restore_files(files: DataFrame, maps: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, outcome, restored_text, message): unsupported, no_map, ambiguous_map or ok with the restored text.

    The inputs are written once, as the choice reads them several times; texts move only where a map is found.
    """
    scratch = Scratch(files.sparkSession, "restore")
    files = scratch.keep(files.select("file_id", *by, "file_name", "text"), "files")
    maps = scratch.keep(maps.select("map_id", "recency_rank", "source_name", "output_name", "map_file_name"), "maps")
    entries = scratch.keep(entries.select("map_id", *by, "token", "category", "canonical_text", "fake_forms"), "entries")
    fits = F.coalesce(N.extension(F.col("file_name")).isin(*N.ACTIONS["restore"]), F.lit(True))
    chosen = files.select("file_id", fits.alias("fits")).join(maplink.decide_maps(files, maps, entries, by=by), "file_id")
    own = entries.groupBy("map_id").agg(F.collect_list(F.struct("token", "category", "canonical_text")).alias("entries"))
    found = chosen.filter("fits AND choice = 'found'").select("file_id", "map_id").join(own, "map_id").select("file_id", "entries")
    back = restore.restore_with_warnings(files, found, id_col="file_id")
    outcome = F.when(~F.col("fits"), "unsupported").when(F.col("choice") == "none", "no_map").when(F.col("choice") == "ambiguous", "ambiguous_map").otherwise("ok")
    return chosen.join(back, "file_id", "left").select("file_id", outcome.alias("outcome"), F.col("original_text").alias("restored_text"), "message")


def file_action(files: DataFrame, action: str, *, categories: Iterable[str] | None = None, excluded: Iterable[str] = (), rules: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(file_id, outcome, output, contents) of the actions on texts: anonymize, markdown (as .md) and ocr (the text as it is).

    Names lose the values that the map replaces; unsupported extensions give no output.  Restoring needs maps: ``restore_files``.
    """
    fits = N.action_applies(F.lit(action), F.array("file_name"))
    rows = files.withColumn("fits", fits)
    if action == "ocr":
        name = F.concat(N.base_of(F.col("file_name")), F.lit("_text.txt"))
        return rows.select("file_id", F.when(F.col("fits"), "ok").otherwise("unsupported").alias("outcome"), F.when(F.col("fits"), name).alias("output"), F.when(F.col("fits"), F.col("text")).alias("contents"))
    done = anonymize_documents(rows.filter("fits"), id_col="file_id", categories=categories, excluded=excluded, rules=rules)
    ext = F.lit("md") if action == "markdown" else N.extension(F.col("file_name"))
    rows = rows.join(done.texts.select("file_id", "anonymized_text"), "file_id", "left").join(done.maps.select("file_id", "entries"), "file_id", "left")
    name = N.result_name(anonymize_name(N.safe_base_name(F.col("file_name")), F.col("entries")), ext)
    return rows.select("file_id", F.when(F.col("fits"), "ok").otherwise("unsupported").alias("outcome"), F.when(F.col("fits"), name).alias("output"), F.when(F.col("fits"), F.col("anonymized_text")).alias("contents"))


def restore_clipboard(texts: DataFrame, maps: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, outcome, restored_text, message): as for files, without a name to go by; blank texts are ``empty``."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    named = texts.withColumn("file_name", F.lit("clipboard.txt"))
    out = restore_files(named, maps, entries, by=by).join(texts.select("file_id", blank.alias("blank")), "file_id")
    return out.select("file_id", F.when(F.col("blank"), "empty").otherwise(F.col("outcome")).alias("outcome"), "restored_text", "message")


def clipboard_outcome(docs: DataFrame, done: Anonymized, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(outcome, n_replaced): empty, nothing_found or ok."""
    rows = docs.select(id_col, F.coalesce(F.trim(F.regexp_replace(text_col, r"\s+", " ")), F.lit("")).alias("t")).join(done.texts.select(id_col, "n_replaced"), id_col)
    return rows.select(id_col, F.when(F.col("t") == "", "empty").when(F.col("n_replaced") == 0, "nothing_found").otherwise("ok").alias("outcome"), F.col("n_replaced").cast("long"))

