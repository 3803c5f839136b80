"""Words of whole groups of texts as Arrow dictionary codes, cut out of one buffer, and Bloom filters of words.

No word becomes a Python object here: a translation table turns every byte that
ends a word into a blank, the words are slices between blanks, and Arrow encodes
equal slices with equal codes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import give_back


class Tokens:
    """Words of some texts: ``code`` (into ``words``), ``doc`` (index of the text) and ``piece`` (words of one piece share it).

    ``kind`` says of each byte whether it belongs to a word (0), ends a word (1)
    or ends a word and its piece (2); a text's end ends its last piece. The byte
    behind a ``lead`` byte belongs to the word too. ``table`` translates the
    bytes first (for lower case).
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray, table: bytes, lead: int | None = None):
        self.data = np.frombuffer(bytearray(b"".join(t + b"\n" for t in texts).translate(table)), np.uint8)
        found = kind[self.data]
        if lead is not None:
            found[np.flatnonzero(self.data == lead) + 1] = 0
        last = np.cumsum([len(t) + 1 for t in texts]) - 1
        found[last] = 2
        self.cut(found, last)

    def cut(self, found: np.ndarray, last: np.ndarray) -> None:
        ends = np.flatnonzero(found)
        self.data[ends] = 32
        # a word keeps the blank behind it, so that words follow each other without gaps
        edges = np.concatenate([[0], ends + 1])
        use = np.flatnonzero(ends > edges[:-1])
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        encoded = each.take(pa.array(use)).dictionary_encode()
        self.code = encoded.indices.to_numpy().astype(np.int64)
        self.words = pc.binary_slice(encoded.dictionary, 0, -1)
        breaks = np.concatenate([[0], np.cumsum(found[ends] == 2)])
        self.piece = breaks[use]
        self.doc = np.searchsorted(last, edges[use])


def counted(*keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one index, total) of each distinct combination of the keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(order))) if weight is None else np.add.reduceat(weight[order], heads)


def text_groups(batches: Iterator[pa.RecordBatch], column: str, between: re.Pattern, characters: int = 2_000_000) -> Iterator[tuple[list[bytes], pa.RecordBatch, np.ndarray]]:
    """Groups of texts of about so many characters, with the batch and the row of each.

    A longer text is cut into several behind matches of ``between``, at which no
    word goes on; where none comes the part grows until one does.
    """
    for batch in batches:
        parts, rows, size = [], [], 0
        for i, value in enumerate(batch.column(column)):
            text, start = value.as_py() or "", 0
            while start < len(text) or start == 0:
                found = between.search(text, start + characters) if len(text) - start > characters else None
                end = found.end() if found else len(text)
                parts.append(text[start:end].encode())
                rows.append(i)
                size += end - start
                start = max(end, 1)
                if size >= characters:
                    yield parts, batch, np.array(rows)
                    parts, rows, size = [], [], 0
        if parts:
            yield parts, batch, np.array(rows)
        del batch, parts
        give_back()


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what is written inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mixed(h: np.ndarray) -> np.ndarray:
    """A sum of products as an evenly spread 64-bit hash."""
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def bloom_block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The one 64-bit block of a blocked Bloom filter where a hash has its bits."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bloom_bits(h: np.ndarray) -> np.ndarray:
    """Up to four bits of that block, from the lower half of the hash."""
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (h & six)
    for shift in (6, 12, 18):
        bits |= one << (h >> np.uint64(shift) & six)
    return bits


def in_bloom(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = bloom_bits(h)
    return filter_[bloom_block(h, len(filter_))] & bits == bits


def gathered_blocks(marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of (block, bits) rows, or-ed in Spark; at most as many rows reach the driver as the filter has blocks."""
    found = marks.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    return found["block"].to_numpy(), found["bits"].to_numpy().view(np.uint64)
