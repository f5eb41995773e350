"""Benchmark decontamination: which documents repeat passages of test items (Wu-Manber search).

Test items are cut into windows of ten words; a shorter item is one window.  Windows of equal
length form one pattern set with three tables: SHIFT (how far a block of two words lets the search
jump), suffix-hash buckets (which windows may end here) and the windows' words, compared directly.
Symbols are words, found on the bytes; many stretches of text are searched in step with numpy.

The pattern tables, words as byte bounds and windows as places among them, are broadcast in blocks of about
``block_bytes`` of item text; a larger benchmark takes one pass over the documents for each block.

Edge cases: null and empty texts have no words and are never contaminated; an empty benchmark hits
nothing; repeated rows are judged row by row; items with equal windows are all reported; items
that share an id count once, and a null id reads as ``null``.  Further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

LANE = 1024


class PatternSet:
    """Windows of one length, ready for searching.

    A window is a place in the items' words (``raw``, with the words' byte bounds); ``owners`` are item numbers, those of
    window w at ``owners[owner_at[w]:owner_at[w + 1]]``.
    """

    def __init__(self, length: int, hashes: np.ndarray, places: np.ndarray, owners: np.ndarray, owner_at: np.ndarray):
        self.length = length
        self.block = min(2, length)
        steps = length - self.block + 1
        self.bits = max(12, min(24, int(8 * len(places) * steps).bit_length()))
        self.shift = np.full(1 << self.bits, min(steps, 255), np.uint8)
        for q in range(steps):
            np.minimum.at(self.shift, self.slot(np.stack([hashes[places + q + i] for i in range(self.block)])), min(steps - 1 - q, 255))
        suffix = self.slot(np.stack([hashes[places + steps - 1 + i] for i in range(self.block)]))
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.places = suffix[order], places[order]
        size = np.diff(owner_at)[order]
        self.owner_at = np.concatenate([[0], np.cumsum(size)])
        self.owners = owners[np.repeat(owner_at[:-1][order] - self.owner_at[:-1], size) + np.arange(self.owner_at[-1])]

    def slot(self, block: np.ndarray) -> np.ndarray:
        h = block[0]
        for x in block[1:]:
            h = T.mix(h * np.uint64(T.BASE) + x)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, bucket) wherever a block's shift is 0: all places where a window can end."""
        m, b = self.length, self.block
        at, until = [], []
        for lo, hi in zip(firsts[:-1], firsts[1:]):
            if hi - lo >= m:
                s = np.arange(lo + m - 1, hi, LANE)
                at.append(s)
                until.append(np.minimum(s + LANE, hi))
        if not at:
            return
        at, until = np.concatenate(at), np.concatenate(until)
        while len(at):
            slot = self.slot(np.stack([words[at - b + 1 + i] for i in range(b)]))
            jump = self.shift[slot].astype(np.int64)
            hit = jump == 0
            if hit.any():
                yield from zip((at[hit] - m + 1).tolist(), slot[hit].tolist())
            at = at + np.maximum(jump, 1)
            live = at < until
            at, until = at[live], until[live]

    def bucket(self, slot: int) -> range:
        """The windows that may end where this slot is met."""
        return range(*np.searchsorted(self.suffix, [slot, slot + 1]).tolist())


class Patterns:
    """The windows of a block of items: their words' bytes once, and a pattern set for each length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        texts = pa.array([text for _, text in items], pa.large_string())
        owner = np.array([number[name] for name, _ in items], np.int64)
        raw, hashes, starts, ends, heads, counts, at, base = [], [], [], [], [], [], 0, 0
        for _, buf, offsets in T.chunks(texts):
            buf = T.LOWER[buf]
            a, b, first = T.word_bounds(buf, offsets, T.ALNUM)
            raw.append(buf.tobytes())
            hashes.append(T.word_hashes(buf, a, b))
            starts.append(a + at)
            ends.append(b + at)
            heads.append(first[:-1] + base)
            counts.append(np.diff(first))
            at, base = at + len(buf), base + len(a)
        whole = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.raw, self.starts, self.ends = b"".join(raw), whole(starts), whole(ends)
        hashes, heads, counts = whole(hashes).astype(np.uint64), whole(heads), whole(counts)
        self.sets = []
        for m in np.unique(np.minimum(counts, window)).tolist():
            own = np.flatnonzero(np.minimum(counts, window) == m)
            n = counts[own] - m + 1
            if not m or not len(own):
                continue
            places = np.repeat(heads[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owners = np.repeat(owner[own], n)
            # equal windows are one; owners once each
            keys = T.run_hashes(hashes, m)[places]
            order = np.lexsort((owners, keys))
            keys, places, owners = keys[order], places[order], owners[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
            keys, places, owners = keys[new], places[new], owners[new]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.sets.append(PatternSet(m, hashes, places[new], owners, np.append(new, len(keys))))

    def text(self, place: int, length: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[place : place + length].tolist(), self.ends[place : place + length].tolist())]


def search_rows(column: pa.Array, patterns: Patterns) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each row: its words, the hit stretches of words, and the items found."""
    for _, buf, offsets in T.chunks(column):
        buf = T.LOWER[buf]
        starts, ends, firsts = T.word_bounds(buf, offsets, T.ALNUM)
        words = T.word_hashes(buf, starts, ends)
        raw = buf.tobytes()
        hits, items = defaultdict(list), defaultdict(set)
        for own in patterns.sets:
            m = own.length
            for first, slot in own.search(words, firsts):
                here = None
                for k in own.bucket(slot):
                    here = here or [raw[s:e] for s, e in zip(starts[first : first + m].tolist(), ends[first : first + m].tolist())]
                    if patterns.text(int(own.places[k]), m) == here:
                        row = int(np.searchsorted(firsts, first, side="right")) - 1
                        hits[row].append((first - int(firsts[row]), first - int(firsts[row]) + m))
                        items[row].update(patterns.names[i] for i in own.owners[own.owner_at[k] : own.owner_at[k + 1]].tolist())
                        break
        for row in range(len(offsets) - 1):
            yield int(firsts[row + 1] - firsts[row]), hits.get(row, []), items.get(row, set())


def covered(stretches: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(stretches):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _search(spark, out: DataFrame, benchmark: DataFrame, text_of: Callable[[pa.RecordBatch], pa.Array], item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The columns of ``out`` with n_words, spans and items of the texts that ``text_of`` finds in a batch of it."""
    T.bound_batches(spark)
    own = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    scratch = Scratch(spark, "decontaminate")
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    for k in range(n):
        block = own if n == 1 else own.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        sets = spark.sparkContext.broadcast(Patterns([(r["item"], r["text"]) for r in block.collect()], window))

        def scan(batches, sets=sets):
            for batch in batches:
                counts, spans, items = [], [], []
                before = batch.column(batch.schema.get_field_index("spans")).to_pylist(), batch.column(batch.schema.get_field_index("items")).to_pylist()
                for (words, hits, found), s, i in zip(search_rows(text_of(batch), sets.value), *before):
                    counts.append(words)
                    spans.append(s + [{"start": a, "end": b} for a, b in hits])
                    items.append(sorted(found | set(i)))
                kinds = [batch.schema.field(x).type for x in ("n_words", "spans", "items")]
                new = [pa.array(x, type=t) for x, t in zip((counts, spans, items), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], schema=batch.schema)

        out = out.mapInArrow(scan, schema)
        if k < n - 1:
            out = scratch.keep(out, f"pass{k}")
            if k:
                scratch.drop(f"pass{k - 1}")
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document: id, n_words, spans (hit word ranges), items (ids as strings)."""
    own = docs.select(F.col(id_col), F.col(text_col).alias("text__"))
    return _search(docs.sparkSession, own, benchmark, lambda batch: batch.column(batch.schema.get_field_index("text__")), item_col, item_text_col, window, block_bytes).drop("text__")


def hit_words(spans: str = "spans"):
    """Words inside any of the spans, each counted once."""
    return F.aggregate(
        F.array_sort(F.col(spans)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"],
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns, whatever their names.

    Rows go through the search as they are, so that each text is sent once.
    """
    at = docs.columns.index(text_col)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"))
    found = _search(docs.sparkSession, own, benchmark, lambda batch: batch.column(batch.schema.get_field_index("row__")).field(at), item_col, item_text_col, window, block_bytes)
    return found.filter(F.size("items") == 0).select("row__.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark)
    hit = hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
pos AS (SELECT doc_id, m, w, unnest(range(1, greatest(len(w) - m, -1) + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win)),
occ AS (SELECT doc_id, pos.i, pos.m, item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM pos) pos JOIN win USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
