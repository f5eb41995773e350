"""Exact substring dedup by a distributed difference-cover suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.

1. Screening.  Of each window of ``length`` bytes the least hash of its ``length // 2``-byte strings
   is selected; equal windows select equal hashes at equal places.  Windows whose selected hash is
   unique in the corpus cannot repeat and are left out.  Equal texts enter as one, and so do equal
   runs of windows around one selected place.  What is left falls into buckets by selected hash;
   windows of different buckets differ.
2. Difference cover.  A position belongs to level k + 1 if the k-th digit of its base-3 offset is 1
   or 2 and it belongs to level k.  The name of a position at level k + 1 ranks the triple of names
   at distances 0, 3**k and 2 * 3**k among all such triples: one distributed sort a level, until names
   span more than ``length`` bytes.
3. Merging.  From the deepest level upward, the positions left out (digit 0) are merged with the
   ranked ones: with digit 1 by (name, rank one step on), with digit 2 by (name, next name, rank two
   steps on).  Both merges are one distributed sort; ranks are counts of smaller suffixes.
4. Adjacent prefixes.  At the bottom, neighbours in the sorted order are compared over ``length``
   bytes by a 62-bit polynomial digest; those that agree repeat.  As only neighbours are
   compared, a wrong match has a chance of about ``length**2 / 2**62`` for each comparison.

Buckets of up to ``bucket_bytes`` are sorted in one task each (many to a task), with steps 2 to 4 on
arrays; larger ones, such as a passage in very many surroundings, are sorted by the whole cluster:
every sort is then a range partitioning of flat rows, and each step a table in the shared folder.

Edge cases: null reads as empty; shorter texts lose nothing; a text that exists twice goes as a whole
if it has ``length`` bytes; repeated rows are copies; texts count by their content, so ids may be null or name
several texts; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

LENGTH = 400
#: Buckets of more bytes are sorted by the whole cluster; a task sorts others in shares of about ``TASK_BYTES``,
#: at most a bucket more.  A byte takes about 60 bytes of arrays.
BUCKET_BYTES, TASK_BYTES = 1 << 22, 1 << 20
#: Rows of a task in the sorts.
TASK_ROWS = 400_000


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over all stretches of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    prefix = T.prefix_hash(raw)
    return T.mix((prefix[gram:] - prefix[:-gram]) * T.powers(len(raw))[1][: len(raw) - gram + 1])


def select(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash selected by each window, hashes at the selected places); at least ``length`` bytes."""
    hashes = gram_hashes(raw, gram)
    width = length - gram + 1
    least = _slide(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), width, np.maximum) == hashes
    return least, hashes[chosen]


def _twice(values: np.ndarray) -> np.ndarray:
    """Each value once, or twice if it occurs more than once."""
    kinds, n = np.unique(values, return_counts=True)
    return np.concatenate([kinds, kinds[n > 1]])


def _texts(column: pa.Array):
    for t in pc.fill_null(column, ""):
        yield np.frombuffer(t.as_buffer(), np.uint8)


def screen(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """id, n_bytes, sha (of the text) and prints (selected hashes, those that occur repeatedly twice)."""

    def scan(batches):
        for batch in batches:
            n, sha, prints = [], [], []
            for raw in _texts(batch.column(1)):
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).digest())
                prints.append(_twice(select(raw, length, gram)[1]).view(np.int64) if len(raw) >= length else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], names=["id", "n_bytes", "sha", "prints"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(scan, f"id {dict(own.dtypes)['id']}, n_bytes bigint, sha binary, prints array<bigint>")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    some = np.sort(some)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values if len(some) else np.zeros(len(values), bool)


def cut_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows with one shared selected hash: cid, start, n (windows), print (that hash), body (digest), twin (selected at several places)."""

    def scan(batches):
        width = length - gram + 1
        for batch in batches:
            at = batch.schema.get_field_index
            for cid, raw, prints in zip(batch.column(at("cid")).to_pylist(), _texts(batch.column(at("text"))), batch.column(at("prints"))):
                least, hashes = select(raw, length, gram)[0], gram_hashes(raw, gram)
                ends = np.flatnonzero(np.concatenate([least[1:] != least[:-1], [True]])) + 1
                starts = np.concatenate([[0], ends[:-1]])
                shared = _within(least[starts], prints.values.to_numpy().view(np.uint64))
                rows = []
                for s, e in zip(starts[shared].tolist(), ends[shared].tolist()):
                    twin = np.count_nonzero(hashes[s : e + width - 1] == least[s]) > 1
                    rows.append((cid, s, e - s, least[s : s + 1].view(np.int64)[0], hashlib.blake2b(raw[s : e + length - 1], digest_size=16).digest(), bool(twin)))
                for lo in range(0, len(rows), 65536):
                    part = list(zip(*rows[lo : lo + 65536]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=["cid", "start", "n", "print", "body", "twin"])

    return texts.mapInArrow(scan, "cid bigint, start bigint, n bigint, print bigint, body binary, twin boolean")


def _bodies(length: int):
    """The bytes of the runs listed in the column runs."""

    def scan(batches):
        for batch in batches:
            for raw, runs in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
                for lo in range(0, len(runs), 1024):
                    part = runs[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["print"] for r in part], pa.int64()), pa.array([r["body"] for r in part], pa.binary()), pa.array([r["large"] for r in part], pa.bool_()), pa.array([raw[r["start"] : r["start"] + r["n"] + length - 1].tobytes() for r in part], pa.binary())],
                        names=["print", "digest", "large", "body"],
                    )

    return scan


PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)


@lru_cache(maxsize=4)
def _modular(size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASES[k], pow(BASES[k], -1, PRIMES[k])):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), PRIMES[k])) % np.uint64(PRIMES[k])])
        out.append(p)
    return tuple(out)


def prefix_digests(raw: np.ndarray, length: int) -> np.ndarray:
    """A 62-bit digest of the ``length`` bytes from each start on."""
    size = 1 << max(16, int(len(raw) + 1).bit_length())
    out = np.zeros(len(raw) - length + 1, np.uint64)
    for k, prime in enumerate(PRIMES):
        up, down = _modular(size, k)
        p = np.uint64(prime)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)] % p)])
        out = (out << np.uint64(31)) | ((sums[length:] - sums[:-length]) % p * down[: len(out)] % p)
    return out.view(np.int64)


def _first_names(batches):
    """Level 1: three bytes are a name as they are."""
    for batch in batches:
        for sid, raw in zip(batch.column(0), _texts(batch.column(1))):
            c = np.concatenate([raw.astype(np.int64) + 1, [0, 0]])
            p = np.flatnonzero(np.arange(len(raw)) % 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), sid.as_py()), pa.int64()), pa.array(p, pa.int64()), pa.array(c[p] << 18 | c[p + 1] << 9 | c[p + 2])], names=["sid", "p", "value"])


def _first_bytes(length: int):
    def scan(batches):
        for batch in batches:
            for sid, raw in zip(batch.column(0), _texts(batch.column(1))):
                digest = prefix_digests(raw, length)
                n = len(digest)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sid.as_py()), pa.int64()), pa.array(np.arange(n)), pa.array(raw[:n].astype(np.int64) << 8 | raw[1 : n + 1]), pa.array(digest)], names=["sid", "p", "value", "digest"])

    return scan


def _whole(batches) -> dict[str, np.ndarray] | None:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


class Places:
    """Values by string and offset; 0 where there is none.  Values of one place add up."""

    def __init__(self, string: np.ndarray, p: np.ndarray, value: np.ndarray):
        key = string << 32 | p
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.key, self.value = key[first], np.add.reduceat(value[order], first) if len(first) else value
        self.string, self.p = self.key >> 32, self.key & 0xFFFFFFFF

    def at(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key), np.int64)
        i = np.searchsorted(self.key, key)
        i[i == len(self.key)] = 0
        return np.where(self.key[i] == key, self.value[i], 0)


def _batches(columns: dict[str, np.ndarray], rows: int = 100_000):
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=rows)


def _triples(step: int):
    def make(batches):
        if (x := _whole(batches)) is None:
            return
        sids, string = np.unique(x["sid"], return_inverse=True)
        names = Places(string, x["p"], x["value"])
        own = names.p // step % 3 != 0
        key = names.key[own]
        yield from _batches({"sid": sids[names.string[own]], "p": names.p[own], "k0": names.value[own], "k1": names.at(key + step), "k2": names.at(key + 2 * step)})

    return make


def _groups(x: dict, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of the group of equal keys, number of the group) by row of sorted rows."""
    new = np.zeros(len(x[keys[0]]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= x[k][1:] != x[k][:-1]
    number = np.cumsum(new) - 1
    return np.flatnonzero(new)[number], number


def _name(batches):
    if (x := _whole(batches)) is not None:
        first, number = _groups(x, ["k0", "k1", "k2"])
        part = TaskContext.get().partitionId()
        yield from _batches({"sid": x["sid"], "p": x["p"], "value": (part << 33 | number) + 1, "part": np.full(len(first), part), "before": first})


def _merge_rows(step: int):
    """Rows for both merges: side 0 with digit 1, side 1 with digit 2; kind 0 are names, kind 1 ranks."""

    def make(batches):
        if (x := _whole(batches)) is None:
            return
        sids, string = np.unique(x["sid"], return_inverse=True)
        name, rank = (Places(string[own], x["p"][own], x["value"][own]) for own in (x["kind"] == 0, x["kind"] == 1))
        digit = name.p // step % 3
        r1, r2, s1, own = rank.at(name.key + step), rank.at(name.key + 2 * step), name.at(name.key + step), rank.at(name.key)
        for side, drop in ((0, 2), (1, 1)):
            m = digit != drop
            zero = np.zeros(m.sum(), np.int64)
            yield from _batches({"sid": sids[name.string[m]], "p": name.p[m], "side": zero + side, "ranked": (digit[m] != 0).astype(np.int64), "k0": name.value[m], "k1": s1[m] if side else r1[m], "k2": r2[m] if side else zero, "r": own[m]})

    return make


def _merge_counts(batches):
    if (x := _whole(batches)) is None:
        return
    first, _ = _groups(x, ["side", "k0", "k1", "k2"])
    out = {"c0": np.zeros(len(first), np.int64), "c1": np.zeros(len(first), np.int64)}
    for side in (0, 1):
        on = x["side"] == side
        for c, kind in (("c0", 0), ("c1", 1)):
            before = np.concatenate([[0], np.cumsum(on & (x["ranked"] == kind))])
            out[c] = np.where(on, before[first], out[c])
    part = TaskContext.get().partitionId()
    yield from _batches({"sid": x["sid"], "p": x["p"], "side": x["side"], "ranked": x["ranked"], "r": x["r"], "part": np.full(len(first), part), **out})


def _last_rows(batches):
    """Three sorted lists, one for each two digits: 0 and 1, 0 and 2, 1 and 2."""
    if (x := _whole(batches)) is None:
        return
    sids, string = np.unique(x["sid"], return_inverse=True)
    starts, ranks = x["kind"] == 0, x["kind"] == 1
    rank = Places(string[ranks], x["p"][ranks], x["value"][ranks])
    s, p, v, d = string[starts], x["p"][starts], x["value"][starts], x["digest"][starts]
    key = s << 32 | p
    for side, digits, ahead, shift in ((0, (0, 1), 1, 8), (1, (0, 2), 2, 0), (2, (1, 2), 0, 63)):
        m = np.isin(p % 3, digits)
        yield from _batches({"sid": sids[s[m]], "p": p[m], "side": np.full(m.sum(), side), "k0": v[m] >> shift, "k1": rank.at(key[m] + ahead), "digest": d[m]})


def _neighbours(batches):
    """Starts whose digest equals a neighbour's, and the outermost rows of the task (edge 1 and 2)."""
    if (x := _whole(batches)) is None:
        return
    same = (x["digest"][1:] == x["digest"][:-1]) & (x["side"][1:] == x["side"][:-1])
    found = np.zeros(len(x["p"]), bool)
    found[1:] |= same
    found[:-1] |= same
    at = np.concatenate([np.flatnonzero(found), [0, len(found) - 1]])
    edge = np.concatenate([np.zeros(found.sum(), np.int64), [1, 2]])
    yield from _batches({"sid": x["sid"][at], "p": x["p"][at], "side": x["side"][at], "digest": x["digest"][at], "edge": edge, "part": np.full(len(at), TaskContext.get().partitionId())})


def repeats_here(bodies: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of all starts whose ``length`` bytes start twice or more in the strings: steps 2 to 4 on arrays."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes).astype(np.int32)
    p = (np.arange(len(end)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
    char = np.concatenate(bodies).astype(np.int32) + 1

    def ahead(values, at, step):
        there = at + step
        return np.where(there < end[at], values[np.minimum(there, len(values) - 1)], 0)

    def ordered(*keys):
        """Sorting order, and for each sorted row the first row with equal keys."""
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        return order, first[np.cumsum(new) - 1] if len(first) else first

    at = np.flatnonzero(p % 3).astype(np.int32)
    names = np.zeros(len(char), np.int32)
    names[at] = char[at] << 18 | ahead(char, at, 1) << 9 | ahead(char, at, 2)
    levels, step = [], 3
    while True:
        levels.append((step, names, at))
        own = at[p[at] // step % 3 != 0]
        order, first = ordered(names[own], ahead(names, own, step), ahead(names, own, 2 * step))
        rank = np.zeros(len(char), np.int32)
        rank[own[order]] = first + 1
        if step * 3 > length:
            break
        names, at, step = rank, own, step * 3
    for step, names, at in reversed(levels):
        digit = p[at] // step % 3
        merged = np.zeros(len(char), np.int32)
        for drop, keys in ((2, lambda x: (names[x], ahead(rank, x, step))), (1, lambda x: (names[x], ahead(names, x, step), ahead(rank, x, 2 * step)))):
            own = at[digit != drop]
            order, first = ordered(*keys(own))
            open_ = (digit[digit != drop] == 0)[order]
            before = np.concatenate([[0], np.cumsum(open_)])[first]
            merged[own[order]] += np.where(open_, first + 1 if drop == 2 else first - before, before)
        ranked = at[digit != 0]
        merged[ranked] += rank[ranked]
        rank = merged
    starts = np.concatenate([np.arange(e - n, e - length + 1) for n, e in zip(sizes, ends)])
    digest = np.concatenate([prefix_digests(b, length) for b in bodies])
    found = np.zeros(len(starts), bool)
    digit = p[starts] % 3
    for drop, keys in ((2, lambda x: (char[x], ahead(rank, x, 1))), (1, lambda x: (char[x], ahead(char, x, 1), ahead(rank, x, 2))), (0, lambda x: (rank[x],))):
        own = np.flatnonzero(digit != drop)
        own = own[ordered(*keys(starts[own]))[0]]
        same = digest[own[1:]] == digest[own[:-1]]
        found[own[1:][same]] = True
        found[own[:-1][same]] = True
    hit = starts[found]
    return np.searchsorted(ends, hit, side="right"), p[hit].astype(np.int64)


def _sort_here(length: int, task_bytes: int):
    """Sorts the buckets of a task, in shares of whole buckets of about ``task_bytes``; rows come sorted by bucket."""

    def share(rows):
        string, p = repeats_here([np.frombuffer(b, np.uint8) for _, b in rows], length)
        yield from _start_runs([pa.RecordBatch.from_pydict({"sid": np.array([r[0] for r in rows], np.int64)[string], "p": p})])

    def scan(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for sid, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held >= task_bytes and key != last:
                    yield from share(rows)
                    rows, held = [], 0
                rows.append((sid, body))
                held, last = held + len(body), key
        if rows:
            yield from share(rows)

    return scan


NAMED = "sid bigint, p bigint, value bigint, part bigint, before bigint"
TRIPLE = "sid bigint, p bigint, k0 bigint, k1 bigint, k2 bigint"
MERGE = "sid bigint, p bigint, side bigint, ranked bigint, k0 bigint, k1 bigint, k2 bigint, r bigint"
COUNTED = "sid bigint, p bigint, side bigint, ranked bigint, r bigint, part bigint, c0 bigint, c1 bigint"
LAST = "sid bigint, p bigint, side bigint, k0 bigint, k1 bigint, digest bigint"
MARKED = "sid bigint, p bigint, side bigint, digest bigint, edge bigint, part bigint"


def repeated_starts(strings: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(sid, p): starts in the strings (columns sid, body) whose ``length`` bytes also start elsewhere in them."""
    spark = strings.sparkSession
    size = strings.agg(F.sum(F.length("body"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda rows: max(least, -(-int(rows) // TASK_ROWS))

    def by_string(df, make, schema, rows):
        return df.repartition(parts(rows), "sid").mapInArrow(make, schema)

    def by_key(df, keys, make, schema, rows):
        return df.repartitionByRange(parts(rows), *keys).sortWithinPartitions(*keys).mapInArrow(make, schema)

    def offsets(counts):
        """Rows before each task's, from (part, n...) rows, one for each task."""
        rows = sorted(counts.collect())
        sums, out = [0] * (len(rows[0]) - 1 if rows else 0), []
        for r in rows:
            out.append((r[0], *sums))
            sums = [a + b for a, b in zip(sums, r[1:])]
        return out

    steps = [3]
    while steps[-1] * 3 <= length:
        steps.append(steps[-1] * 3)
    names = {3: scratch.keep(strings.select("sid", "body").mapInArrow(_first_names, "sid bigint, p bigint, value bigint"), "names3")}
    rows = size * 2 / 3
    for step in steps:  # names of level log3(step) make those of the next
        triples = scratch.keep(by_string(names[step], _triples(step), TRIPLE, rows), f"triples{step}")
        rows = rows * 2 / 3
        names[step * 3] = scratch.keep(by_key(triples, ["k0", "k1", "k2"], _name, NAMED, rows), f"names{step * 3}")
        scratch.drop(f"triples{step}")
        names[step * 3] = names[step * 3].select("sid", "p", "value", "part", "before")
    top = names.pop(steps[-1] * 3)
    shift = spark.createDataFrame(offsets(top.groupBy("part").count()), "part bigint, o bigint")
    ranks = top.join(F.broadcast(shift), "part").select("sid", "p", (F.col("before") + F.col("o") + 1).alias("value"))
    for step in reversed(steps):
        own = names[step].select("sid", "p", F.lit(0).cast("long").alias("kind"), "value").unionByName(ranks.select("sid", "p", F.lit(1).cast("long").alias("kind"), "value"))
        rows = rows * 3 / 2
        merge = scratch.keep(by_string(own, _merge_rows(step), MERGE, rows * 2), f"merge{step}")
        counted = scratch.keep(by_key(merge, ["side", "k0", "k1", "k2"], _merge_counts, COUNTED, rows * 4 / 3), f"ranks{step}")
        scratch.drop(f"merge{step}", f"names{step}", f"ranks{step * 3}")
        number = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("ranked") == kind))
        shift = spark.createDataFrame(offsets(counted.groupBy("part").agg(*[number(s, k).alias(f"o{s}{k}") for s in (0, 1) for k in (0, 1)])), "part bigint, o00 bigint, o01 bigint, o10 bigint, o11 bigint")
        o0, o1 = (F.when(F.col("side") == 0, F.col(f"o0{k}")).otherwise(F.col(f"o1{k}")) for k in (0, 1))
        less0, less1 = F.col("c0") + o0, F.col("c1") + o1
        # a rank is one more than the number of smaller suffixes: r has its 1, a new one gets it on side 0
        value = F.when(F.col("ranked") == 1, F.col("r") + less0).when(F.col("side") == 0, less0 + less1 + 1).otherwise(less1)
        ranks = counted.join(F.broadcast(shift), "part").select("sid", "p", value.alias("value"))
    starts = strings.select("sid", "body").mapInArrow(_first_bytes(length), "sid bigint, p bigint, value bigint, digest bigint")
    own = starts.select("sid", "p", F.lit(0).cast("long").alias("kind"), "value", "digest").unionByName(ranks.select("sid", "p", F.lit(1).cast("long").alias("kind"), "value", F.lit(0).cast("long").alias("digest")))
    last = scratch.keep(by_string(own, _last_rows, LAST, size * 2), "last")
    scratch.drop(f"ranks{steps[0]}")
    marked = scratch.keep(by_key(last, ["side", "k0", "k1"], _neighbours, MARKED, size * 2), "marked")
    scratch.drop("last")
    edges = sorted(marked.filter("edge > 0").select("part", "edge", "side", "digest", "sid", "p").collect())  # two of each task
    over = [(r["sid"], r["p"]) for a, b in zip(edges[:-1], edges[1:]) if a["part"] != b["part"] and (a["side"], a["digest"]) == (b["side"], b["digest"]) for r in (a, b)]
    return marked.filter("edge = 0").select("sid", "p").unionByName(spark.createDataFrame(over, "sid bigint, p bigint")).distinct()


def _start_runs(batches):
    if (x := _whole(batches)) is None:
        return
    order = np.lexsort((x["p"], x["sid"]))
    sid, p = x["sid"][order], x["p"][order]
    new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    yield from _batches({"sid": sid[first], "lo": p[first], "hi": p[last] + 1})


def _remove(batches):
    for batch in batches:
        n_removed, n_spans, sha = [], [], []
        at = batch.schema.get_field_index
        for raw, spans in zip(_texts(batch.column(at("text"))), batch.column(at("spans")).to_pylist()):
            kept, end, removed, runs = hashlib.sha256(), 0, 0, 0
            for s in sorted((s["lo"], s["hi"]) for s in spans):
                if s[0] > end or not runs:
                    kept.update(raw[end : s[0]])
                    runs += 1
                removed += max(0, s[1] - max(s[0], end))
                end = max(end, s[1])
            kept.update(raw[end:])
            n_removed.append(removed)
            n_spans.append(runs)
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(at("sha")), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), batch.column(at("spans"))], names=["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


SPANS = "array<struct<lo:bigint,hi:bigint>>"


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges, unmerged)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    gram, least = length // 2, int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = scratch.keep(screen(docs, id_col, text_col, length, gram), "seen")
    classes = scratch.keep(
        seen.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.any_value("prints").alias("prints")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    prints = classes.filter(F.col("prints").isNotNull()).select("cid", F.explode("prints").alias("print"))
    shared = prints.groupBy("print").count().filter("count > 1").select("print")
    wanted = scratch.keep(prints.join(shared, "print").groupBy("cid").agg(F.collect_set("print").alias("prints")).join(classes.select("cid", "first", "sha"), "cid"), "wanted")
    # by content, as an id may be null or name several texts; of copies those under the least id
    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"))
    texts = scratch.keep(rows.join(wanted, "sha").filter(F.col("id__").eqNullSafe(F.col("first"))).drop("id__"), "texts")
    runs = scratch.keep(cut_runs(texts, length, gram), "runs")
    size = F.col("n") + length - 1
    kinds = runs.groupBy("print", "body").agg(F.count("*").alias("copies"), F.min(F.struct("cid", "start")).alias("at"), F.any_value("n").alias("n"), F.any_value("twin").alias("twin"))
    kinds = scratch.keep(kinds, "kinds")
    buckets = kinds.groupBy("print").agg(F.count("*").alias("bodies"), F.bool_or("twin").alias("twins"), (F.sum(size) > bucket_bytes).alias("large")).filter("bodies > 1 or twins").select("print", "large")
    chosen = kinds.join(buckets, "print").groupBy("at.cid").agg(F.collect_list(F.struct("print", "body", "large", F.col("at.start").alias("start"), "n")).alias("runs"))
    strings = texts.select("cid", "text").join(chosen, "cid").select("text", "runs").mapInArrow(_bodies(length), "print bigint, digest binary, large boolean, body binary")
    strings = scratch.keep(strings.withColumn("sid", F.monotonically_increasing_id()), "strings")

    total, large = strings.agg(F.sum(F.length("body")), F.bool_or("large")).first()
    parts = max(least, -(-(total or 0) // (4 * TASK_BYTES)))
    inner = strings.filter(~F.col("large")).select("sid", "print", "body").repartition(parts, "print").sortWithinPartitions("print").mapInArrow(_sort_here(length, TASK_BYTES), "sid bigint, lo bigint, hi bigint")
    if large:
        found = repeated_starts(strings.filter("large").select("sid", "body"), length, scratch)
        inner = inner.unionByName(found.repartition(least, "sid").mapInArrow(_start_runs, "sid bigint, lo bigint, hi bigint"))
    inner = scratch.keep(inner.join(strings.select("sid", "print", F.col("digest").alias("body")), "sid").select("print", "body", "lo", "hi"), "inner")
    whole = kinds.filter("copies > 1").select("print", "body", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    single = kinds.filter("copies = 1").select("print", "body")
    per_run = whole.unionByName(inner.join(single, ["print", "body"], "left_semi"))
    spans = per_run.join(runs.select("print", "body", "cid", F.col("start").alias("at")), ["print", "body"])
    spans = spans.groupBy("cid").agg(F.collect_list(F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + length - 1).alias("hi"))).alias("spans"))
    single = classes.filter("copies = 1").select("cid")
    cut = texts.select("cid", "sha", "text").join(single, "cid", "left_semi").join(spans, "cid").select("sha", "text", "spans").mapInArrow(_remove, f"sha binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}")
    copied = classes.filter((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))).alias("spans")
    )
    result = cut.unionByName(copied)
    zero = F.lit(0).cast("long")
    return seen.select("id", "n_bytes", "sha").join(result, "sha", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: Exact up to MD5: all strings of 400 bytes, counted.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(b[i:i + 399]) AS k FROM (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 398, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS o FROM runs),
per AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans, string_agg(hex(b[o:lo - 1]), '' ORDER BY lo) AS kept, max(hi) AS last FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 1):]))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
