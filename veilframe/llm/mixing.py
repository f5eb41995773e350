"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target of words.  A document's inclusion is ``target / source size``: its whole
part is taken for certain, the fraction is sampled.  The cube method moves the fractions along the
null space of the constraints (documents, words) until they are 0 or 1.  Each source is cut into
groups of about ``group_rows`` documents by a hash; a group ends with at most two open documents,
these form the groups of the next round.  The last round of a source holds back fourteen of its larger documents; with the two
still open they are the landing problem, solved for the choice nearest to the words wanted.  Groups never hold a whole large source, and a round's rows
are a few thousandths of those before.

Rows of one id, source, size and text are counted first and numbered, so that a hash spreads them, too, over the groups
and the mix depends on the rows alone, not on how they are stored.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source, the
last; repeated rows, with an id or without, are units of their own; an empty table gives an empty mix; further columns are
ignored by ``mix_sources`` and kept by ``take_mix``.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): ``share`` of all words dealt by weight, no source above ``most`` times its size.

    The common level ``theta`` with ``sum(min(theta * weight, most * size)) = share * total`` is found
    over the sources in the order in which they reach their cap; one row per source is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("before")) / F.col("rest"))
        .withColumn("theta", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    )
    return per.select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("theta") * F.col("w"), F.col("cap"))).alias("target"))


def flight(sizes: list[float], probs: list[float], draws: list[float]) -> list[float]:
    """Move ``probs`` until at most two are fractions; their sum and their sum weighted by size stay."""
    p, active, k = list(probs), [], 0
    todo = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    while True:
        while len(active) < 3:
            i = next(todo, None)
            if i is None:
                return [0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p]
            active.append(i)
        a, b, c = active
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        top = max(map(abs, u))
        u = tuple(x / top for x in u) if top else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for i, x in zip(active, u):
            p[i] += step * x
        active = [i for i in active if EPS < p[i] < 1 - EPS]


def land(sizes: list[float], probs: list[float]) -> list[float]:
    """Round the last fractions (``LANDING`` + 2 at most) so that words, then documents, come nearest to what they stand for."""
    left = [i for i, x in enumerate(probs) if EPS < x < 1 - EPS]
    choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    gap = choice - np.array([probs[i] for i in left])
    words = np.abs(gap @ np.array([sizes[i] for i in left])).round(6)
    best = np.lexsort((np.abs(gap.sum(axis=1)).round(6), words))[0]
    out = list(probs)
    for i, x in zip(left, choice[best]):
        out[i] = float(x)
    return out


#: Documents of a source, from its second largest to its median in geometric steps of rank, that its last flight leaves for the landing.
LANDING = 14


def _sample(frame, seed: int):
    frame = frame.sort_values(["size", "id", "text_hash", "n"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    first = frame.iloc[0]
    rng = np.random.default_rng(zlib.crc32(f"{seed}|{first['source']}|{first['bucket']}|{first['round']}".encode()))
    sizes, probs = frame["size"].astype(float).tolist(), frame["open"].tolist()
    last = first["buckets"] == 1
    held = {int(i): probs[int(i)] for i in np.geomspace(1, max(1, len(probs) // 2), LANDING).round() if i < len(probs)} if last else {}
    probs = flight(sizes, [0.0 if i in held else x for i, x in enumerate(probs)], rng.random(len(probs) + 1).tolist())
    for i, x in held.items():
        probs[i] = x
    frame["open"] = land(sizes, probs) if last else probs
    return frame


KEY = ("id", "source", "size", "text_hash")
#: Rows made of one counted row at a time.
STEP = 10_000


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("text_hash"))


def _numbered(counted: DataFrame) -> DataFrame:
    """A row for each of the ``k`` that a counted row stands for, with its number ``n``; those of very many in steps of their own."""
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / STEP))))
    if (counted.agg(F.max("k")).first()[0] or 0) > STEP:
        steps = steps.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, "step")
    rows = F.sequence(F.col("step") * STEP, F.least(F.col("k"), (F.col("step") + 1) * STEP) - 1)
    return steps.withColumn("n", F.explode(rows)).drop("step", "k")


def _mix(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, share: float, most: float, group_rows: int, seed: int) -> DataFrame:
    """A row for each document: the key's columns, n, source_size, target, copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    counted = scratch.keep(_keyed(docs, id_col, source_col, text_col).groupBy(*KEY).agg(F.count("*").alias("k")), "counted")
    per = counted.groupBy("source").agg(F.sum("k").alias("n"), F.sum(F.col("size") * F.col("k")).alias("source_size"))
    targets = scratch.keep(source_targets(per, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    sizes = _numbered(counted)
    rows = sizes.join(targets.drop("n"), sizes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    rows = rows.withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0)).withColumn("whole", F.floor(F.col("ratio") + EPS).cast("long"))
    rows = rows.withColumn("open", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0))).drop("ratio")
    is_open = (F.col("open") > EPS) & (F.col("open") < 1 - EPS)
    settled, k = [rows.filter(~is_open)], 0
    rows = rows.filter(is_open)
    while True:
        buckets = rows.groupBy("source").agg(F.ceil(F.count("*") / group_rows).cast("long").alias("buckets"))
        own = rows.join(buckets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        own = own.withColumn("round", F.lit(k)).withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_hash", "n", "round"), F.col("buckets")))
        done = scratch.keep(own.groupBy("source", "bucket").applyInPandas(lambda frame: _sample(frame, seed), own.schema), f"round{k}").drop("buckets", "round", "bucket")
        settled.append(done.filter(~is_open))
        rows = done.filter(is_open)
        if not rows.head(1):
            break
        k += 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.when(F.col("open") >= 1 - EPS, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3), share: float = 1.0, most: float = 3.0, group_rows: int = 1000, seed: int = 0) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (how often the mix takes it)."""
    out = _mix(docs, id_col, source_col, text_col, weights, share, most, group_rows, seed)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3), share: float = 1.0, most: float = 3.0, group_rows: int = 1000, seed: int = 0) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, with all their columns.

    Rows of one id, source, size and text share their decisions: those whose further columns hash lower are taken
    first.  Only hashes are counted and ranked; texts move once, to meet how often they are taken.
    """
    scratch = Scratch(docs.sparkSession, "take")
    mix = _mix(docs, id_col, source_col, text_col, weights, share, most, group_rows, seed)
    taken = mix.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.count("*").alias("k")).filter("copies > 0")
    plain = [F.to_json(F.struct(f"`{c}`")) if any(x in t for x in ("map<", "variant")) else F.col(f"`{c}`") for c, t in docs.dtypes]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.xxhash64(*plain).alias("row_hash"), *[c.alias(n) for c, n in zip((F.col(id_col), F.col(source_col), word_count(text_col), F.xxhash64(text_col)), KEY)])
    alike = lambda a, b: [a[c].eqNullSafe(b[c]) for c in KEY[:2]] + [a[c] == b[c] for c in KEY[2:]]
    kinds = keyed.groupBy(*KEY, "row_hash").agg(F.count("*").alias("rows"))
    kinds = kinds.join(taken, alike(kinds, taken)).select(*[kinds[c] for c in (*KEY, "row_hash", "rows")], "copies", "k")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*KEY).orderBy("row_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of k equal units some are taken once more than the others
    base, more = F.floor(F.col("copies") / F.col("k")), F.col("copies") % F.col("k")
    several = kinds.filter("rows < k").withColumn("times", F.col("rows") * base + F.least(F.greatest(more - before, F.lit(0)), F.col("rows")))
    times = scratch.keep(kinds.filter("rows = k").withColumn("times", F.col("copies")).unionByName(several).filter("times > 0").select(*KEY, "row_hash", "rows", "times"), "times")
    met = keyed.join(times, [*alike(keyed, times), keyed["row_hash"] == times["row_hash"]]).select("row_", *[times[c] for c in (*KEY, "row_hash", "rows", "times")])
    # rows that are equal throughout: one stands for all
    whole = met.filter("rows > 1").groupBy(*KEY, "row_hash").agg(F.any_value("row_").alias("row_"), F.any_value("times").alias("times"))
    out = met.filter("rows = 1").select("row_", "times").unionByName(whole.select("row_", "times"))
    return out.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row_.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
