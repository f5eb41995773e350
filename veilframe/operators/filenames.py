"""File names from values: tokens for values, unique names, free paths."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

#: Shortest value, shortest word that matches by its stem, letters cut from a stem, letters an ending may have beyond.
LEAST_VALUE, LEAST_STEM, STEM_CUT, ENDING = 3, 7, 2, 3


@lru_cache(maxsize=4096)
def _pattern(body: str):
    # not behind or before a letter or digit; an underscore is neither
    return re.compile(rf"(?<![^\W_]){body}(?![^\W_])", re.IGNORECASE)


#: Kinds of forms: whole ones, whose words anything that separates words in a name may part, and stems with any ending.
BODIES = {
    "whole": lambda form: r"[\s_.-]+".join(map(re.escape, form.split(" "))),
    "stem": lambda form: re.escape(form[:-STEM_CUT]) + rf"[^\W\d_]{{0,{STEM_CUT + ENDING}}}",
}


def known_forms(entry) -> list[tuple[str, str]]:
    """(form, kind) by which a map's entry may stand in a name: its values, and the words of people's names."""
    values = list({" ".join(v.split()): None for v in [entry["canonical_text"], *(() if entry["variants"] is None else entry["variants"])]})
    words = [w for v in values for w in v.split(" ")] if entry["category"] == "PERSON" else []
    table = [(v, "whole") for v in values] + [(w, "stem" if len(w) >= LEAST_STEM else "whole") for w in words]
    return [row for row in table if len(row[0]) >= LEAST_VALUE]


def name_rules(entries) -> list[tuple[str, str]]:
    """(pattern body, token) of a map's forms, longest first; equally long ones in the map's order."""
    table = [(form, kind, e["token"]) for e in (() if entries is None else entries) for form, kind in known_forms(e)]
    return [(BODIES[kind](form), token) for form, kind, token in sorted(table, key=lambda row: len(row[0]), reverse=True)]


def rename(base: str, entries) -> str:
    """Values in a name become tokens; a placed token is out of reach for later rules."""
    parts: list[tuple[bool, str]] = [(False, base)]
    for body, token in name_rules(entries):
        out = []
        for placed, text in parts:
            if placed:
                out.append((placed, text))
                continue
            at = 0
            for m in _pattern(body).finditer(text):
                # the neighbours of a piece are placed tokens, which are neither letters nor digits
                out += [(False, text[at : m.start()]), (True, token)]
                at = m.end()
            out.append((False, text[at:]))
        parts = out
    return "".join(text for _, text in parts)


def anonymize_name(base: Column, entries: Column) -> Column:
    @F.pandas_udf("string")
    def apply(bases: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else b if m is None else rename(b, m) for b, m in zip(bases, maps)])

    return apply(base, entries)


def unique_names(names: DataFrame, *, by: list[str], base_col: str = "base", order_col: str = "idx") -> DataFrame:
    """Adds unique_name (n-th repeat of a base gets ``-n``) and whether that name collides with another one all the same."""
    n = F.row_number().over(Window.partitionBy(*by, base_col).orderBy(order_col))
    rows = names.withColumn("unique_name", F.when(n == 1, F.col(base_col)).otherwise(F.concat(F.col(base_col), F.lit("-"), n.cast("string"))))
    return rows.withColumn("name_collision", F.count("*").over(Window.partitionBy(*by, "unique_name")) > 1)


def free_names(wanted: DataFrame, existing: DataFrame, *, most: int = 999) -> DataFrame:
    """Adds free_name for one wanted (folder, name) each: the name, or the first of ``name (2)``... up to ``most`` that does not exist; null if none is left."""
    parts = lambda c: {"base_": N.base_of(F.col(c)), "ext_": F.regexp_extract(c, r"(?<=.)(\.[^.]*)$", 1)}
    # a taken name is its base's first, and where it ends with a number also that base's which stands before
    taken = existing.select("folder", F.col("name").alias("taken")).distinct().withColumns(parts("taken"))
    numbered = r"^(.*) \(([1-9][0-9]{0,3})\)$"
    later = taken.filter(F.col("base_").rlike(numbered)).select("folder", F.regexp_extract("base_", numbered, 1).alias("base_"), "ext_", F.regexp_extract("base_", numbered, 2).cast("int").alias("k"))
    taken = taken.select("folder", "base_", "ext_", F.lit(1).alias("k")).unionByName(later)
    rows = wanted.withColumns(parts("name"))
    hit = rows.join(taken, ["folder", "base_", "ext_"])
    used = hit.groupBy("folder", "name").agg(F.collect_set("k").alias("used"))
    rows = rows.join(used, ["folder", "name"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.when(F.size("used") == 0, 1).otherwise(F.try_element_at(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.col("used")), F.lit(1)))
    rows = rows.withColumn("k", free)
    name = F.when(F.col("k") == 1, F.col("name")).when(F.col("k") > 1, F.concat("base_", F.lit(" ("), F.col("k").cast("string"), F.lit(")"), "ext_"))
    return rows.withColumn("free_name", name).drop("base_", "ext_", "used", "k")
