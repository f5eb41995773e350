"""Custom rules: a pattern and a label."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES, MOST_PATTERN, PREVIEW = 25, 256, 20


def enabled(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled").select("name", "pattern", "label")


def load(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Rules of a JSON array; items without text for id, name, pattern and label are dropped, enabled is true unless false."""
    items = F.from_json(json_col, "array<struct<id:string,name:string,pattern:string,label:string,enabled:boolean>>")
    out = rows.select(F.explode(items).alias("r")).select("r.*").filter("id IS NOT NULL AND name IS NOT NULL AND pattern IS NOT NULL AND label IS NOT NULL")
    return out.withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def problem(name: str, pattern: str, label: str, existing: int) -> str | None:
    """Why a rule cannot be saved; the first reason counts."""
    if existing >= MOST_RULES:
        return f"No more than {MOST_RULES} rules can be saved."
    for value, what in ((name, "a name"), (label, "a label"), (pattern, "a pattern")):
        if not value.strip():
            return f"Give the rule {what}."
    if len(pattern) > MOST_PATTERN:
        return f"A pattern has at most {MOST_PATTERN} characters."
    try:
        re.compile(pattern)
    except re.error as error:
        return f"The pattern is not valid: {error}"
    return None


def problems(rules: DataFrame, existing: int = 0) -> DataFrame:
    """The checks that need no compiler, as a column."""
    blank = lambda c: F.trim(c) == ""
    first = F.when(F.lit(existing >= MOST_RULES), f"No more than {MOST_RULES} rules can be saved.").when(blank("name"), "Give the rule a name.").when(blank("label"), "Give the rule a label.").when(blank("pattern"), "Give the rule a pattern.").when(F.length("pattern") > MOST_PATTERN, f"A pattern has at most {MOST_PATTERN} characters.")
    return rules.withColumn("problem", first)


def preview(text: Column, pattern: str) -> Column:
    """The first twenty matches that are not empty."""
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != ""), 1, PREVIEW)
