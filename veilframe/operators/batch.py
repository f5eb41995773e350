"""Batches: documents processed side by side, failures kept as data."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .filenames import anonymize_name, unique_names


def process(items: DataFrame, work: Callable[[str], str], *, text_col: str = "text") -> DataFrame:
    """Adds result, error and status (done or error); one item's failure leaves the others alone.

    Only queued items and those that failed before are worked on.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes if n not in ('status', 'result', 'error'))}, status string, result string, error string"

    def run(frames):
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                if record.get("status") in ("queued", "error"):
                    try:
                        record |= {"result": work(record[text_col]), "error": None, "status": "done"}
                    except Exception as error:  # noqa: BLE001  whatever fails belongs to the item
                        record |= {"result": None, "error": str(error), "status": "error"}
                rows.append(record)
            yield pd.DataFrame(rows, columns=[c.split("`")[1] if "`" in c else c.split()[0] for c in schema.split(", ")])

    for c in ("result", "error"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    return items.mapInPandas(run, schema)


def progress(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    state = F.col("status")
    return items.groupBy(*(by or [])).agg(F.count_if(state == "done").alias("complete"), F.count_if(state == "error").alias("failed"), F.count("*").alias("total"))


def export(items: DataFrame, *, by: list[str], name_col: str = "filename", text_col: str = "anonymized_text", map_col: str = "entries", order_col: str = "idx") -> DataFrame:
    """Two files an item: (filename, contents) with the text, and with the map as indented JSON; names are anonymised and unique."""
    rows = items.withColumn("base", anonymize_name(N.safe_base_name(F.col(name_col)), F.col(map_col)))
    rows = unique_names(rows, by=by, order_col=order_col)
    files = F.array(
        F.struct(N.result_name(F.col("unique_name"), F.lit("txt")).alias("filename"), F.col(text_col).alias("contents")),
        F.struct(N.result_name(F.col("unique_name"), F.lit("json"), "map").alias("filename"), F.to_json(F.struct(F.col(map_col).alias("entries")), {"pretty": "true"}).alias("contents")),
    )
    return rows.select(*by, order_col, "name_collision", F.explode(files).alias("f")).select(*by, order_col, "name_collision", "f.*")
