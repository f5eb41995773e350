"""Token-id output: documents packed into sequences of fixed length.

Texts are encoded whole; a document longer than a sequence is split without loss into pieces that
fill sequences, and a rest.  Pieces are packed best-fit decreasing: longest first, each into the open
sequence with the least room that still holds it, found in a segment tree over capacities.  A task
packs what it reads in windows of ``window_tokens``, so nothing is shuffled and memory is bounded; a
window leaves at most a few sequences partly filled.

A row is one sequence: its id matrix row (little-endian, padded), cumulative segment lengths, the places
where positions restart at 0 (each piece, and the padding), and the document and piece number of
each segment.  ``position_ids`` spells the positions out.

Edge cases: null and empty texts have no tokens and no segment; repeated rows are packed each; ties
go to the earlier piece; an empty table gives no sequence; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import VOCABULARY, encoder


class CapacityTree:
    """Segment tree over capacities 0..length that tells the least one at or above a bound with an open sequence."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (sequence, capacity) of the tightest fit."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.open[capacity].pop(), capacity

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Indices of the pieces in each sequence; every piece must be 1 to ``length`` long."""
    tree, sequences = CapacityTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = tree.take(n)
        if found:
            at, room = found
            sequences[at].append(i)
        else:
            at, room = len(sequences), length
            sequences.append([i])
        if room > n:
            tree.add(room - n, at)
    return sequences


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """Positions of a sequence that restart at each of ``resets``."""
    at = np.arange(length)
    resets = np.asarray(resets)
    return at - resets[np.searchsorted(resets, at, side="right") - 1]


#: Sequences handed over at once.
BATCH = 64
COLUMNS = "sequence_id bigint, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, vocabulary: str = VOCABULARY, pad_id: int = 50256, window_tokens: int = 1 << 21) -> DataFrame:
    """One row per sequence (see the module).  Ids are uint16 where they fit, else uint32."""
    own = docs.select(id_col, text_col)
    kind = dict(own.dtypes)[id_col]

    def pack(batches):
        encoding, lengths = encoder(vocabulary)
        dtype = np.dtype("<u2" if max(len(lengths), pad_id + 1) <= 1 << 16 else "<u4")
        prefix = TaskContext.get().partitionId() << 33
        done = 0

        def emit(pieces, id_type):
            nonlocal done
            sequences = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for lo in range(0, len(sequences), BATCH):
                block = sequences[lo : lo + BATCH]
                ids = np.full((len(block), length), pad_id, dtype)
                ends = []
                for row, members in enumerate(block):
                    at, cuts = 0, [0]
                    for i in members:
                        n = len(pieces[i][2])
                        ids[row, at : at + n] = pieces[i][2]
                        at += n
                        cuts.append(at)
                    ends.append(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(prefix + done, prefix + done + len(block)), pa.int64()),
                        pa.array([c[-1] for c in ends], pa.int32()),
                        pa.array([[pieces[i][0] for i in m] for m in block], pa.list_(id_type)),
                        pa.array([[pieces[i][1] for i in m] for m in block], pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())),
                        pa.array([c if c[-1] < length else c[:-1] for c in ends], pa.list_(pa.int32())),
                        pa.array([r.tobytes() for r in ids], pa.binary()),
                    ],
                    names=["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "position_resets", "input_ids"],
                )
                done += len(block)

        pieces, held, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encoding.encode_ordinary(text), dtype) if text else ()
                pieces += [(doc, k, ids[at : at + length]) for k, at in enumerate(range(0, len(ids), length))]
                held += len(ids)
                if held >= window_tokens:
                    yield from emit(pieces, id_type)
                    pieces, held = [], 0
        if pieces:
            yield from emit(pieces, id_type)

    return own.mapInArrow(pack, COLUMNS.format(kind=kind))


def op2_pack_tokens(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
