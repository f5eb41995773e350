"""Byte-pair encoding of whole texts with a public vocabulary file, and token counts by section.

Each document is encoded once.  Token byte spans follow from the tokens' lengths; an interval join of
token spans with section spans gives every token to the section that holds most of its bytes, the
earlier one on a tie, so that the sections' counts add up to the document's.

Edge cases: null and empty texts have no tokens and one empty section; sections without tokens
are reported with 0; repeated rows are counted each; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of vocabulary files and the one used unless another is named; a cluster passes its own path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """(encoding, token lengths in bytes) from a rank file; one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Tokens per section; ``ends`` are token end bytes from 0 on, ``borders`` section starts and the text's end.

    A token may touch many short sections: its section is the first of those that hold the most of it.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, ends, side="left") - 1
    own = first.copy()
    for k in np.flatnonzero(last > first):
        cuts = np.concatenate([[starts[k]], borders[first[k] + 1 : last[k] + 1], [ends[k]]])
        own[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return np.bincount(own, minlength=len(borders) - 1)


def line_borders(raw: bytes) -> np.ndarray:
    """Sections are lines, each with its line feed."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(raw)], [len(raw)]]).astype(np.int64)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, borders=line_borders) -> DataFrame:
    """One row per document and section: id, section (from 0), start and end (characters), n_tokens, doc_tokens."""
    own = docs.select(id_col, text_col)

    def count(batches):
        encoding, lengths = encoder(vocabulary)
        for batch in batches:
            rows, columns = [], [[] for _ in range(5)]
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                raw = text.encode()
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                cuts = borders(raw)
                n = allocate(np.cumsum(lengths[ids]), cuts)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[cuts]
                rows.append(np.full(len(n), k))
                for c, x in zip(columns, (np.arange(len(n)), chars[:-1], chars[1:], n, np.full(len(n), len(ids)))):
                    c.append(x)
            take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for c in columns)], names=[id_col, "section", "start", "end", "n_tokens", "doc_tokens"])

    return own.mapInArrow(count, f"`{id_col}` {dict(own.dtypes)[id_col]}, section bigint, start bigint, end bigint, n_tokens bigint, doc_tokens bigint")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
