"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece the encoding that BPE gives it has one last
token. These last tokens are all that need be stored: the last token of a
longer prefix is the one token that ends there and is compatible with the last
token before it. Appending bytes only adds entries, and after an edit only the
entries behind it are computed anew.
"""
from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import slim
from tidemark.llm.words import WordEncoder, in_groups
from tidemark.session import ship_package

#: Rows handed back to Spark at a time.
BATCH_ROWS = 1000


class Vocabulary:
    """Ranks of byte strings, and which neighbouring tokens BPE leaves apart."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.matches = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.matches.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matches.make_automaton()
        self.kept_apart: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: merge the neighbouring pair of lowest rank until none is left."""
        parts, rank = [data[i:i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            best = min((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 40:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [rank[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether BPE makes this one token of its bytes."""
        if (known := self.reached.get(token)) is None:
            known = self.reached[token] = self.merged(self.token[token]) == [token]
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens side by side."""
        if (known := self.kept_apart.get((left, right))) is None:
            if len(self.kept_apart) > 1_000_000:
                self.kept_apart.clear()
            known = self.kept_apart[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known


class PrefixTable:
    """The last token of every prefix of a byte string that may grow and change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact encoding of the longer string; earlier entries stay."""
        v, last, kept_apart = self.vocabulary, self.last, self.vocabulary.kept_apart
        back = max(0, len(last) - v.longest)  # tokens that end in the new bytes start no earlier
        self.data += data
        for stop, (token, size) in v.matches.iter(self.data[back:].decode("latin-1")):
            end = back + stop + 1
            if end <= len(last) or size > end:
                continue
            if size == end:
                fits = v.whole(token)
            else:
                fits = kept_apart.get((last[end - size - 1], token))
                if fits is None:
                    fits = v.apart(last[end - size - 1], token)
            if fits:
                last.append(token)
        if len(last) != len(self.data):
            raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of [start, end); entries before ``start`` stay."""
        rest = self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(data + rest)

    def ids(self) -> list[int]:
        out, end, sizes = [], len(self.last), self.vocabulary.token
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(sizes[token])
        return out[::-1]


@functools.cache
def encoder(path: str, pattern: str) -> tuple[Vocabulary, WordEncoder]:
    """One for each worker process: what it remembers serves later tasks too."""
    vocabulary, split, known = Vocabulary(path), regex.compile(pattern).findall, {}

    def encode_piece(piece: str) -> bytes:
        data = piece.encode()
        token = vocabulary.rank.get(data)
        ids = PrefixTable(vocabulary, data).ids() if token is None else [token]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(data) <= 64:
            if len(known) > 300_000:
                known.clear()
            known[piece] = found
        return found

    def encode_parts(parts: list[str]) -> list[bytes]:
        return [b"".join([known.get(piece) or encode_piece(piece) for piece in split(part)]) for part in parts]

    return vocabulary, WordEncoder(lambda text: encode_parts([text])[0], encode_parts)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids as little-endian unsigned 32-bit integers, without special tokens.

    One row per row; a null or empty text has no ids. The vocabulary file must
    be readable at ``path`` on every executor.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, pattern)[1]
        for part, texts in in_groups(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(to_ids(texts), pa.binary())], ["doc_id", "ids"])


    rows = slim(docs, id_col, text_col).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (bytes) to (doc_id, ids)."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as lines:
            token = {int(rank): base64.b64decode(data) for data, rank in (line.split() for line in lines if line.strip())}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
