"""Encode batches of texts word by word, each new word once."""
from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Where two blanks meet, the pattern's white-space rules look at the neighbours.
MEETING_BLANKS = re.compile(r"\s\s")


class WordEncoder:
    """Ids (little-endian, unsigned, 32 bits) of whole texts.

    Where no two blanks meet, the split pattern starts a new piece at every
    space and isolates every newline, so a text may be cut there and each part
    encoded (and remembered, up to ``limit`` parts) alone. Other texts are
    encoded whole. A part is a word that followed a space, or a newline and the
    word after it.

    ``encode`` takes one text; ``encode_parts`` takes many parts that neither
    start (but for their one space or newline) nor end with a blank.
    """

    def __init__(self, encode: Callable[[str], bytes], encode_parts: Callable[[list[str]], list[bytes]], limit: int = 600_000):
        self.encode, self.encode_parts, self.limit = encode, encode_parts, limit
        self.known: dict[str, bytes] = {}

    def learned(self, parts: set[str]) -> dict[str, bytes]:
        found, plain = {}, []
        for part in parts:
            body = part.removeprefix("\n")
            if body and body == body.strip():
                plain.append(part if part[0] == "\n" else " " + part)
            else:
                found[part] = self.encode("\n") * (part[:1] == "\n") + self.encode(body if part[:1] == "\n" else " " + body)
        found.update(zip((p if p[0] == "\n" else p[1:] for p in plain), self.encode_parts(plain)))
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        split = [None if MEETING_BLANKS.search(t) else f"\n{t}".replace("\n", " \n").split(" ")[1:] for t in texts]
        flat = [part for parts in split if parts is not None for part in parts]
        ids = list(map(self.known.get, flat))
        if new := {part for part, data in zip(flat, ids) if data is None}:
            found = self.learned(new)
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
            self.known.update(found)
            ids = [found[part] if data is None else data for part, data in zip(flat, ids)]
        at = 0
        for text, parts in zip(texts, split):
            if parts is None:
                out.append(self.encode(text))
            else:  # the newline put before the first word is taken off again
                out.append(b"".join(ids[at:at + len(parts)])[4:])
                at += len(parts)
        return out


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker serves many stages, and what it has once held counts against the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_groups(batches: Iterator[pa.RecordBatch], column: str, characters: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, each with its texts, of about so many characters (or one text)."""
    for batch in batches:
        texts, start, size = [], 0, 0
        for value in batch.column(column):
            texts.append(value.as_py())
            size += len(texts[-1])
            if size >= characters:
                yield batch.slice(start, len(texts)), texts
                texts, start, size = [], start + len(texts), 0
        if texts:
            yield batch.slice(start, len(texts)), texts
        del batch, texts
        give_back()
