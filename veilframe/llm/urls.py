"""URL filtering: fixed rules first, then association rules mined by FP-growth.

A fixed rule fits its host, all subdomains, and the paths that start with its own; the longest one
wins.  Its verdict is the label of the pages that it fits.  FP-growth mines the token combinations of
the labelled pages together with their labels.  A rule needs ``min_support`` (a share of the labelled
pages, five at least), ``min_confidence`` (of the labelled pages that hold its tokens, those with its verdict) and
``min_coverage`` (of all pages that hold its tokens, the labelled ones): a combination that labels
hardly touch, like a top-level domain, says nothing about the pages beyond them.  Rules implied by a shorter one
at least as sure are pruned; an inverted index from token to rules finds those whose tokens a
url has in full.  The surest rule, then the best supported, decides; a url that none fits is allowed.

Two reductions keep the number of combinations small without losing a rule that pruning would keep: a token
that is a rule by itself with confidence 1 is left out of the combinations, and of tokens that stand in the same labelled
pages one enters, the one with the best coverage.  Frequent tokens are at most (tokens a url) / ``min_support``,
whatever the number of pages; templates of many tokens that nearly, but not quite, go together remain FP-growth's worst case.

Edge cases: a null url, or one without ``://``, has an empty host and path, no tokens, and is allowed;
repeated rows count each; an empty table, or one without a labelled page, mines nothing; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict of the fixed rules.
FIXED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled pages that a rule needs at least, however few there are.
MIN_PAGES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "\x00"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules=FIXED) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, from the columns host and path; null where none fits."""
    name = verdict = None
    for host, path, kind in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def url_tokens(url: str) -> Column:
    """Distinct tokens: host parts, path parts (numbers alike), and the names of query parameters."""
    part = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    query = F.regexp_extract(F.col(url), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    tokens = F.concat(part("host", F.split("host", r"\.")), part("path", F.split("path", r"[/.]")), part("query", names))
    return F.array_distinct(F.filter(tokens, lambda x: ~x.rlike("^[a-z]+:$")))


class RuleIndex:
    """Inverted index: token to the ranks of the rules that need it."""

    def __init__(self, rules):
        self.rules, self.by_token = rules, defaultdict(list)
        for rank, rule in enumerate(rules):
            for token in rule[0]:
                self.by_token[token].append(rank)

    def fitting(self, tokens):
        """Ranks of the rules whose tokens are all there."""
        seen: dict[int, int] = {}
        for token in tokens:
            for rank in self.by_token.get(token, ()):
                seen[rank] = seen.get(rank, 0) + 1
                if seen[rank] == len(self.rules[rank][0]):
                    yield rank

    def best(self, tokens) -> int | None:
        return min(self.fitting(tokens), default=None)


def _holders(pages: DataFrame, index: RuleIndex) -> dict[int, int]:
    """Rank of a rule to the number of pages that hold its tokens."""

    def count(batches):
        n: dict[int, int] = defaultdict(int)
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                for rank in index.fitting(tokens):
                    n[rank] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["rank", "n"])

    return {r["rank"]: r["n"] for r in pages.select("tokens").mapInArrow(count, "rank int, n bigint").groupBy("rank").agg(F.sum("n").alias("n")).collect()}  # a row for each rule


def mine(labelled: DataFrame, *, min_support: float = 0.005, min_confidence: float = 0.9, min_coverage: float = 0.5, partitions: int | None = None) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) from the columns tokens and label; surest first, no rule implied by a shorter one."""
    total = labelled.filter("label IS NOT NULL").count()
    if not total:
        return []
    least = max(MIN_PAGES, math.ceil(min_support * total - 1e-9))
    if least > total:
        return []
    page = F.xxhash64(F.array_sort("tokens"), "label").cast("decimal(38,0)")
    each = labelled.withColumn("page", F.when(F.col("label").isNotNull(), page)).select("label", "page", F.explode("tokens").alias("token"))
    each = each.groupBy("token").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("block"), F.sum("page").alias("pages"))
    alike: dict[tuple, tuple] = {}
    sure = []
    for r in sorted(each.filter(F.col("labelled") >= least).collect(), key=lambda r: (r["n"], r["token"])):
        if r["block"] in (0, r["labelled"]) and r["labelled"] >= min_coverage * r["n"]:
            sure.append(((r["token"],), "block" if r["block"] else "allow", 1.0, r["labelled"] / total))
        else:
            alike.setdefault((r["labelled"], r["block"], r["pages"]), r["token"])  # of several the least spread, so the best covered
    used = F.array(*[F.lit(t) for t in sorted(alike.values())]).cast("array<string>")
    items = labelled.filter("label IS NOT NULL").select(F.concat(F.array_intersect("tokens", used), F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence, numPartitions=partitions or max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))).fit(items).associationRules
    named = found.filter(F.substring(F.col("consequent")[0], 1, 1) == LABEL).select(F.array_sort("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"), "confidence", "support")
    rules = [(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in named.collect()]
    holders = _holders(labelled, RuleIndex(rules)) if rules else {}
    # a rule's labelled holders are its supported pages over its confidence
    rules = [r for rank, r in enumerate(rules) if r[3] * total / r[2] >= min_coverage * holders.get(rank, 0) - 1e-6]
    kept: list[tuple[tuple[str, ...], str, float, float]] = []
    by_token = defaultdict(list)
    for r in sorted(sure + rules, key=lambda r: (len(r[0]), r[0], r[1])):
        own = set(r[0])
        if not any(own > set(k[0]) and k[1] == r[1] and k[2] >= r[2] for t in own for k in by_token[t]):
            kept.append(r)
            for t in own:
                by_token[t].append(r)
    return sorted(kept, key=lambda k: (-k[2], -k[3], k[0], k[1]))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=FIXED, default: str = "allow", **mining) -> DataFrame:
    """One row per page: id, host, path, rule (the fixed rule's text or null), mined (tokens of the association rule or null), verdict."""
    name, verdict = fixed_rule(rules)
    host, path = host_path(F.col("url__"))
    own = pages.select(F.col(id_col), F.col(url_col).alias("url__")).withColumns({"host": host, "path": path})
    own = own.withColumns({"rule": name, "label": verdict, "tokens": F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens("url__"))}).drop("url__")
    index = RuleIndex(mine(own, **mining))

    def judge(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            mined, out = [], []
            for label, tokens in zip(batch.column(at("label")).to_pylist(), batch.column(at("tokens")).to_pylist()):
                best = None if label else index.best(tokens)
                mined.append(None if best is None else " ".join(index.rules[best][0]))
                out.append(label or (default if best is None else index.rules[best][1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in (id_col, "host", "path", "rule")), pa.array(mined, pa.string()), pa.array(out, pa.string())], names=[id_col, "host", "path", "rule", "mined", "verdict"])

    kind = dict(own.dtypes)[id_col]
    return own.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, mined string, verdict string")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
