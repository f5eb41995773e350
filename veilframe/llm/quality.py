"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or abstains (0).  Expectation-maximisation over the counts of
vote patterns (at most 3 ** rules rows, whatever the corpus) estimates how often each rule casts
each vote on good and on bad documents; a document is kept if its posterior probability of being
good reaches ``threshold``.  No document needs a label.

Edge cases: a null or empty text has no words and fails the base rule; a text without votes has the
prior; an empty table gives an empty result; repeated rows count each; further columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Words in three-word windows that occur twice or more.  Windows are sorted as 40 hash bits and 24
#: bits of position; neighbours with equal hash bits are compared word by word, and should unequal
#: windows ever share hash bits, the text's windows are sorted as texts instead.
REPEATS = """
transform(array(words__), ws -> transform(array(sort_array(transform(slice(ws, 1, greatest(size(ws) - 2, 0)),
    (w, i) -> (xxhash64(w, ws[i + 1], ws[i + 2]) & -16777216L) | cast(i as bigint)))),
  s -> transform(array(transform(s, (x, j) -> CASE WHEN j = 0 OR (x & -16777216L) != (get(s, j - 1) & -16777216L) THEN 0
        WHEN ws[cast(x & 16777215L as int)] = ws[cast(s[j - 1] & 16777215L as int)]
         AND ws[cast(x & 16777215L as int) + 1] = ws[cast(s[j - 1] & 16777215L as int) + 1]
         AND ws[cast(x & 16777215L as int) + 2] = ws[cast(s[j - 1] & 16777215L as int) + 2] THEN 1 ELSE 2 END)),
    f -> CASE WHEN size(ws) > 16777215 THEN {by_text}
              WHEN NOT array_contains(f, 1) AND NOT array_contains(f, 2) THEN 0
              WHEN array_contains(f, 2) THEN {by_text}
              ELSE {by_hash} END)[0])[0])[0]
"""
COVER = "transform(array({starts}), r -> size(array_union(array_union(r, transform(r, x -> x + 1)), transform(r, x -> x + 2))))[0]"
BY_HASH = COVER.format(starts="filter(transform(s, (x, j) -> CASE WHEN f[j] = 1 OR get(f, j + 1) = 1 THEN cast(x & 16777215L as int) END), x -> x IS NOT NULL)")
BY_TEXT = "transform(array(array_sort(transform(slice(ws, 1, size(ws) - 2), (w, i) -> struct(concat_ws(' ', w, ws[i + 1], ws[i + 2]) AS t, i AS i)))), z -> {})[0]".format(
    COVER.format(starts="filter(transform(z, (x, j) -> CASE WHEN x.t = get(z, j - 1).t OR x.t = get(z, j + 1).t THEN x.i END), x -> x IS NOT NULL)")
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("words__", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    lines = "transform(array(filter(split(coalesce(`{0}`, ''), '\\n', -1), l -> length(translate(l, ' \\t\\u000b\\u000c\\r', '')) > 0)), l -> struct(size(l) AS n, size(l) - size(array_distinct(l)) AS dup))[0]".format(text_col)
    rows = rows.withColumns({
        "n_words": F.size("words__").cast("long"),
        "word_chars": F.length(_without(text, BLANKS)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "lines__": F.expr(lines),
        "n_repeat_words": F.expr(REPEATS.format(by_text=BY_TEXT, by_hash=BY_HASH)).cast("long"),
        "n_distinct__": F.size(F.array_distinct("words__")).cast("long"),
        "n_bangs__": (F.length(text) - F.length(_without(text, "!"))).cast("long"),
        "n_stops__": (F.length(text) - F.length(_without(text, ".?!"))).cast("long"),
        "n_upper__": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_letters__": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
        "n_symbol_runs__": F.regexp_count(text, F.lit(r"[#*$%&|<>]+")).cast("long"),
    }).drop("words__")
    return rows.withColumn("n_dup_lines", F.col("lines__.dup").cast("long"))


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name; a rule abstains where a text is too short to tell or lies between its bounds.

    Long texts repeat words and three-word windows by nature, so from 2,000 words on ``repetition`` and ``variety`` can
    vote good but not bad; the base rule bounds repetition at every length.
    """
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    mean = per_word("word_chars")
    enough = F.col("n_words") >= 30
    return {
        "symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "symbol_runs": _vote(per_word("n_symbol_runs__") > 0.2, per_word("n_symbol_runs__") < 0.05),
        "letters": _vote(F.col("n_letters__") < 0.8 * F.col("word_chars"), F.col("n_letters__") > 0.9 * F.col("word_chars")),
        "capitals": _vote(enough & (F.col("n_upper__") > 0.3 * F.col("word_chars")), F.col("n_upper__") < 0.1 * F.col("word_chars")),
        "shouting": _vote(enough & (per_word("n_bangs__") > 0.2), per_word("n_bangs__") < 0.05),
        "repetition": _vote((F.col("n_words") < 2000) & (per_word("n_repeat_words") > 0.3), enough & (per_word("n_repeat_words") < 0.15)),
        "duplicate_lines": _vote(F.col("lines__.dup") > 0.3 * F.col("lines__.n"), (F.col("lines__.n") > 2) & (F.col("lines__.dup") <= 0.05 * F.col("lines__.n"))),
        "variety": _vote((F.col("n_words") < 2000) & enough & (per_word("n_distinct__") < 0.2), enough & (per_word("n_distinct__") > 0.35)),
        "word_length": _vote(enough & ((mean < 2.5) | (mean > 14)), (mean >= 3) & (mean <= 10)),
        "sentences": _vote(enough & (per_word("n_stops__") < 0.01), (per_word("n_stops__") > 0.03) & (per_word("n_stops__") < 0.3)),
    }


def _posterior(pattern: tuple[int, ...], model: dict) -> float:
    odds = math.log(model["prior"] / (1 - model["prior"]))
    odds += sum(math.log(model["good"][j][v] / model["bad"][j][v]) for j, v in enumerate(pattern) if v)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100, tolerance: float = 1e-7) -> dict:
    """Prior and each rule's vote probabilities by class, given that it votes, from (votes, count).

    Abstaining says nothing about the class.  At the start any bad vote makes a text likely bad.
    """
    m = len(patterns[0][0]) if patterns else len(rules())
    total = sum(n for _, n in patterns)
    belief = [0.05 if min(p) < 0 else 0.95 if max(p) > 0 else 0.5 for p, _ in patterns]
    model = {"prior": 0.9, "good": [{-1: 0.05, 1: 0.95}] * m, "bad": [{-1: 0.5, 1: 0.5}] * m}
    for _ in range(steps if total else 0):
        new = {"prior": min(0.999, max(0.001, sum(b * n for b, (_, n) in zip(belief, patterns)) / total)), "good": [], "bad": []}
        for j in range(m):
            for side, share in (("good", lambda b: b), ("bad", lambda b: 1 - b)):
                sums = {v: 1.0 + sum(share(b) * n for b, (p, n) in zip(belief, patterns) if p[j] == v) for v in (-1, 1)}
                new[side].append({v: s / (sums[-1] + sums[1]) for v, s in sums.items()})
        moved = abs(new["prior"] - model["prior"]) + sum(abs(new[s][j][1] - model[s][j][1]) for s in ("good", "bad") for j in range(m))
        model = new
        belief = [_posterior(p, model) for p, _ in patterns]
        if moved < tolerance:
            break
    return model


def score(model: dict, votes: dict[str, Column]) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, vote in enumerate(votes.values()):
        weight = {v: math.log(model["good"][j][v] / model["bad"][j][v]) for v in (-1, 1)}
        odds = odds + F.when(vote == -1, weight[-1]).when(vote == 1, weight[1]).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Id and text of the documents with their measures, base_failed, quality (posterior) and kept."""
    own = docs.select(F.col(id_col), F.col(text_col))
    measured = Scratch(docs.sparkSession, "quality").keep(with_measures(own, text_col), "rows")
    return _judge(measured, measured, threshold, least_words, repeat_percent)


def keep_quality(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The kept documents with all their columns, whatever their names."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"), F.col(text_col).alias("text__"))
    measured = Scratch(docs.sparkSession, "quality").keep(with_measures(own, "text__").drop("text__"), "rows")  # measuring costs more than writing
    return _judge(measured, measured, threshold, least_words, repeat_percent).filter("kept").select("row__.*")


def _judge(measured: DataFrame, counted: DataFrame, threshold: float, least_words: int, repeat_percent: int) -> DataFrame:
    names = list(rules())
    counts = counted.select(*[c.alias(n) for n, c in rules().items()]).groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts))
    out = measured.withColumn("base_failed", base_failed(least_words, repeat_percent)).withColumn("quality", score(model, rules()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("lines__", "n_distinct__", "n_bangs__", "n_stops__", "n_upper__", "n_letters__", "n_symbol_runs__")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    measured = Scratch(spark, "quality").keep(with_measures(docs).drop("text"), "measures")  # the texts are read once
    out = _judge(measured, measured, 0.5, 50, 50)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
