"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

A document's set are its distinct five-word shingles.  One hash of each shingle fills ``BINS`` bins
with their minimum; empty bins borrow from filled ones by optimal densification.  ``ROWS`` bins make a
band, equal bands a bucket.  Two sets of similarity 0.75 miss all buckets with a chance of
``(1 - 0.75 ** ROWS) ** (BINS / ROWS)``, about 1e-8.

Documents with equal sets form one class and enter as one.  Shingles that no other candidate has
bound every similarity of a class from above, so pairs that cannot reach the threshold are left out
exactly; so do hashed bitmaps of the sets, whose unmatched bits are unmatched shingles.  In a bucket only the most central
class (the one with most companions over all its buckets) is paired with the others, so candidates
grow with the bucket's size, not its square.  Candidates are confirmed on full sets.  Classes of one
bucket that the stars leave in different components are then compared too: all such pairs if they
are few, after further stars around other centres if they are many.  No bucket is capped.

Edge cases: null and empty texts have an empty set and stay alone; fewer than five words are one
shingle; an empty table gives an empty result; repeated rows fall into one class; rows without an id take part,
a component without any id has a null one, and texts under one id are judged each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .scratch import Scratch

SHINGLE, SIMILARITY = 5, 75
BINS, ROWS = 192, 4
#: Pairs left over by the stars are all weighed once there are at most so many for each bucket entry; they
#: need so many common buckets (at similarity 0.75 a pair has fewer with a chance of 3e-6).
LEFT_OVER, STARS, COMMON = 2000, 6, 3
#: Entries of a bucket that are compared with each other in one go.
BLOCK = 1000
#: Size of a set's hashed bitmap, a power of two from 64 on; the bound is good for sets of up to about so many shingles.
BITS = 2048


@lru_cache(maxsize=4)
def _donors(bins: int, tries: int = 2048) -> np.ndarray:
    """For each bin the bins it asks in turn for a value while it is empty."""
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)[None, :]
    return (T.mix(grid + np.uint64(0x5EED)) % np.uint64(bins)).astype(np.int32)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation minima with optimal densification; ``shingles`` are sorted hashes, at least one."""
    width = (1 << 64) // bins + 1
    edges = (np.arange(bins, dtype=object) * width).astype(np.uint64)
    first = np.searchsorted(shingles, edges)
    after = np.append(first[1:], len(shingles))
    filled = first < after
    out = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    donors, at = _donors(bins), 0
    while len(empty) and at < donors.shape[1]:
        step = 16 if at < 64 else 256
        ok = filled[donors[empty, at : at + step]]
        found = ok.any(axis=1)
        out[empty[found]] = out[donors[empty[found], at + ok[found].argmax(axis=1)]]
        empty, at = empty[~found], at + step
    if len(empty):
        out[empty] = shingles[0]
    return out


def bands(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = minima.reshape(-1, rows)
    h = np.arange(len(grid), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        h = T.mix(h * np.uint64(T.BASE) + grid[:, k])
    return h.view(np.int64)


def _sets(batches, size: int):
    for batch in batches:
        for first, buf, offsets in T.chunks(batch.column(1)):
            yield batch.column(0).slice(first, len(offsets) - 1), T.shingle_sets(buf, offsets, size)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n_shingles, set_key and bands of every document; key and bands are null for an empty set."""

    def scan(batches):
        for ids, sets in _sets(batches, size):
            n, keys, found = [], [], []
            for s in sets:
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                found.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "bands"])

    T.bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(scan, f"id {dict(own.dtypes)['id']}, n_shingles bigint, set_key binary, bands array<bigint>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(set_key, cid, shingles, bits) of the texts in ``text__`` that are of one of their ``classes``; of all, without cid, where these are null."""

    def scan(batches):
        for batch in batches:
            text, classes = (batch.column(batch.schema.get_field_index(c)) for c in ("text__", "classes"))
            for first, buf, offsets in T.chunks(text):
                for k, s in enumerate(T.shingle_sets(buf, offsets, size), first):
                    own = classes[k].as_py() if len(s) else []
                    key = _key(s) if len(s) else None
                    for cid in [None] if own is None else [c["cid"] for c in own if c["set_key"] == key]:
                        bits = np.zeros(BITS, np.uint8)
                        bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([cid], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64())), pa.array([np.packbits(bits).view(np.int64)], pa.list_(pa.int64()))], names=["set_key", "cid", "shingles", "bits"])

    return texts.select("text__", "classes").mapInArrow(scan, "set_key binary, cid bigint, shingles array<bigint>, bits array<bigint>")


def _pair(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _find(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: int, common_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, set_key, component_id) of every document, and the key of each component's kept class with its least id."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs, id_col, text_col, size), "signed")
    classes = scratch.keep(
        signed.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("id").alias("first"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    # one exchange serves the counts and the join with them: the counts use all columns so that both read the same
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = classes.select("cid", "n", F.explode("bands").alias("bucket")).repartition(parts, "bucket")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("mates"), F.max(F.col("cid") + F.col("n")).alias("all_")).filter("mates > 1 AND all_ IS NOT NULL").drop("all_")
    entries = scratch.keep(entries.join(shared.hint("shuffle_hash"), "bucket"), "entries0")

    wanted = scratch.keep(entries.select("cid").distinct().join(classes, "cid").select("cid", "first", "set_key"), "wanted")
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text__"))
    # the joins with texts and sets are merge joins at any size: the tables they meet grow with the corpus
    by_id = full_sets(texts.join(wanted.filter("first IS NOT NULL").groupBy("first").agg(F.collect_list(F.struct("set_key", "cid")).alias("classes")).hint("merge"), "first"), size)
    no_id = wanted.filter("first IS NULL").select("set_key", "cid")  # their texts are told apart by content alone
    no_id = full_sets(texts.filter("first IS NULL").withColumn("classes", F.lit(None).cast("array<struct<set_key:binary,cid:bigint>>")), size).drop("cid").join(no_id, "set_key")
    sets = by_id.select("cid", "shingles", "bits").unionByName(no_id.select("cid", "shingles", "bits").dropDuplicates(["cid"]))
    sets = scratch.keep(sets, "sets")

    # common shingles of two classes are at most those of either that are not its own alone
    alone = sets.select("cid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("cid").alias("cid")).filter("k = 1").groupBy("cid").agg(F.count("*").alias("alone"))
    able = wanted.select("cid").join(classes.select("cid", "n"), "cid").join(alone, "cid", "left").select("cid", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), "n").filter(F.col("m") * 100 >= F.col("n") * similarity)
    able = entries.drop("n").join(scratch.keep(able, "able"), "cid")
    degree = able.groupBy("cid").agg(F.sum("mates").alias("degree"))
    entries = scratch.keep(able.drop("mates").join(degree, "cid"), "entries")
    scratch.drop("entries0")

    most = F.least("m", "m_")
    near = most * 100 >= (F.col("n") + F.col("n_") - most) * similarity
    inter, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        own = scratch.keep(pairs, f"{name}-pairs")
        joined = own.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
        return scratch.keep(joined.withColumn("inter", inter).filter(F.col("inter") * 100 >= (both - F.col("inter")) * similarity).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), name)

    def star(rank, rows: DataFrame) -> DataFrame:
        centre = rows.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), (-F.col("cid")).alias("cid"), F.col("n"), F.col("m"))).alias("c"))
        found = rows.join(centre, "bucket").select("cid", "n", "m", (-F.col("c.cid")).alias("cid_"), F.col("c.n").alias("n_"), F.col("c.m").alias("m_"))
        return found.filter((F.col("cid") != F.col("cid_")) & near).select(*_pair("cid", "cid_")).distinct()

    links = confirm(star(F.col("degree"), entries), "star0")
    tested = docs.sparkSession.read.parquet(f"{scratch.root}/star0-pairs")
    for k in range(1, STARS + 2):
        roots = scratch.keep(components(links, scratch, f"roots{k}"), f"roots{k}")
        rows = entries.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        per = rows.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("own"), F.count("*").alias("roots")).filter("roots > 1")
        open_ = scratch.keep(rows.join(per.select("bucket"), "bucket", "left_semi"), f"open{k}")
        total, most = per.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.max("all")).first()
        if not total:
            break
        last = k > STARS or total <= LEFT_OVER * max(open_.count(), 10_000)
        if last:
            words = [f"b{k}" for k in range(BITS // 64)]
            # large buckets are compared block by block, each pair of blocks apart
            open_ = open_.join(per.filter(F.col("all") > BLOCK).select("bucket", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")), "bucket", "left") if most > BLOCK else open_.withColumn("blocks", F.lit(1))
            open_ = open_.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
            own = open_.join(sets.select("cid", *[F.col("bits")[k].alias(w) for k, w in enumerate(words)]), "cid")
            other = own.select("bucket", F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"), *[F.col(c).alias(f"{c}_") for c in ("cid", "n", "m", "root", *words)])
            own = own.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1)))
            # a bit of one set that the other lacks is a shingle that it lacks; plain columns, as lambdas are not compiled
            only = lambda a, b: sum((F.bit_count(F.col(w + a).bitwiseAND(F.bitwise_not(F.col(w + b)))) for w in words), F.lit(0))
            common = F.least(F.col("n") - only("", "_"), F.col("n_") - only("_", ""))
            like = common * (100 + similarity) >= (F.col("n") + F.col("n_")) * similarity
            pairs = own.join(other, ["bucket", "low", "high"]).filter((F.col("root") != F.col("root_")) & ((F.col("low") < F.col("high")) | (F.col("cid") < F.col("cid_"))) & near & like).select(*_pair("cid", "cid_"))
            pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("buckets")).filter(F.col("buckets") >= common_buckets).drop("buckets")
        else:
            pairs = star(F.xxhash64("cid", F.lit(k)), open_)
        found = confirm(pairs.join(tested, ["a", "b"], "left_anti"), f"star{k}")
        links = links.unionByName(found)
        tested = tested.unionByName(docs.sparkSession.read.parquet(f"{scratch.root}/star{k}-pairs"))
        if last:
            break
    scratch.drop("sets")
    roots = components(links, scratch, "roots").withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "set_key", "first").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("set_key"))).getField("set_key").alias("kept_key"))
    named = rooted.join(least, "root").select("set_key", "component_id")
    return signed.select("id", "n_shingles", "set_key").join(named, "set_key", "left"), least.select(F.col("kept_key").alias("set_key"), F.col("component_id").alias("id"))


def find_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY, common_buckets: int = COMMON) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id it is linked with, over any number of links), kept.

    With ``common_buckets=1`` the last comparison takes every pair of a bucket, so only pairs without a common bucket can be missed.
    """
    out, _ = _find(docs, id_col, text_col, size, similarity, common_buckets)
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY, common_buckets: int = COMMON) -> DataFrame:
    """One document of each component, with all its columns, and every document without words.

    Rows without an id are not dropped.  Where an id stands on several rows, each text is judged for itself.
    """
    scratch = Scratch(docs.sparkSession, "singles")
    out, kept = _find(docs, id_col, text_col, size, similarity, common_buckets)
    kept = kept.filter("id IS NOT NULL").unionByName(out.filter("set_key IS NULL AND id IS NOT NULL").select("set_key", "id"))
    kept = scratch.keep(kept.distinct(), "kept")
    several = scratch.keep(out.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "several")
    # a merge join at any size, as the ids kept grow with the corpus
    own = docs.join(kept.join(several, "id", "left_anti").select(F.col("id").alias(id_col)).hint("merge"), id_col, "left_semi").select(*docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"), F.col(id_col).alias("id__"), F.col(text_col).alias("text__"))
    rows = rows.join(several.withColumnRenamed("id", "id__"), "id__", "left_semi")
    told = signatures(rows.select(F.struct("row__", "id__").alias("both"), "text__"), "both", "text__", size).select("id.row__", "id.id__", "set_key")
    told = told.join(kept, (F.col("id__") == F.col("id")) & told["set_key"].eqNullSafe(kept["set_key"]), "left_semi")
    single = told.filter("set_key IS NOT NULL").groupBy("id__", "set_key").agg(F.any_value("row__").alias("row__"))
    told = single.select("row__").unionByName(told.filter("set_key IS NULL").select("row__"))
    return own.unionByName(told.select("row__.*")).unionByName(docs.filter(F.col(id_col).isNull()))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return find_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact on small tables: all pairs that share a shingle.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') || ':' || least(5, len(w)) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT a, min(b) AS c FROM t GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n USING (doc_id)
"""
