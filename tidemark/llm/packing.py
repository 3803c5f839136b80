"""Best-fit packing of token pieces by patterns of lengths.

Piece lengths form a histogram of at most ``room`` bins. Patterns of two or
three lengths that fill a sequence are enumerated, non-negative least squares
fits how often each is repeated, the counts are rounded down, and what is left
is packed best-fit on the histogram. The pieces themselves never meet: each has
a rank within its length, and the plan maps ranks to sequences.
"""
from __future__ import annotations

import functools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim, small_batches
from tidemark.llm.words import in_groups
from tidemark.session import cut_lineage, ship_package


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE file if its merges are in the order of its ids, so that ranks alone say what is merged first."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = {token: i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocabulary.get(a + b, -1) for a, b in merges]
    if model.get("type", "BPE") != "BPE" or order != sorted(set(order)) or len(vocabulary) < 256 + len(order):
        return None
    made = {a + b for a, b in merges} | set(byte)
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token in made}


@functools.cache
def tokenizer(path: str, pattern: str | None) -> Callable[[list[str]], list[bytes]]:
    """Texts to the ids that ``tokenizers`` gives them for the file (little-endian, 32 bits); one for each worker process.

    A text that holds the string of an added token of the file gets that token's
    id there, as ``tokenizers`` gives it. With the file's split pattern given, no
    normalizer, and merges in rank order, tiktoken applies the same merges to all
    other texts, which gives the same ids in a third of the time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    ranks = byte_ranks(path) if pattern and model.get("normalizer") is None else None
    whole = Tokenizer.from_file(path)

    def slow(texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in whole.encode_batch_fast(texts, add_special_tokens=False)]

    if not ranks:
        return slow
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [token["content"] for token in model.get("added_tokens") or []]
    return lambda texts: [slow([text])[0] if any(token in text for token in added) else np.array(encode(text), "<u4").tobytes() for text in texts]


def cut(docs: DataFrame, path: str, pattern: str | None, room: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document with the task that made them and their number among its pieces of that length."""
    ship_package(docs.sparkSession)
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = tokenizer(path, pattern), TaskContext.get().partitionId(), [0] * (room + 1)
        end = end_id.to_bytes(4, "little")
        for part, texts in in_groups(batches, "text", 1_000_000):
            of, piece, start, length, ids, crc, nth = [], [], [], [], [], [], []
            for row, data in enumerate(encode(texts)):
                data += end
                n = len(data) // 4
                edges = [0, *range((n - 1) % room + 1, n + 1, room)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    of.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(data[4 * a:4 * b])
                    crc.append(zlib.crc32(ids[-1]))
                    nth.append(made[b - a])
                    made[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array([task] * len(of), pa.int64()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"],
            )

    rows = slim(docs, id_col, text_col).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, task long, nth long")


def patterns(bins: np.ndarray, room: int) -> np.ndarray:
    """All pairs and triples of lengths in use that fill a sequence; three columns, pairs with a zero."""
    use = np.flatnonzero(bins)
    use = use[(use > 0) & (use < room)]
    pairs = [(0, a, room - a) for a in use.tolist() if 2 * a <= room and bins[room - a]]
    triples = []
    for a in use[3 * use <= room].tolist():
        b = use[(use >= a) & (2 * use <= room - a)]
        b = b[bins[room - a - b] > 0]
        triples.append(np.stack([np.full(len(b), a), b, room - a - b], axis=1))
    return np.concatenate([np.array(pairs, np.int64).reshape(-1, 3), *triples]).astype(np.int64)


def repeat_counts(shapes: np.ndarray, bins: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative steps: how often to use each pattern so that the lengths used come to the histogram.

    Errors weigh as the square of the length: a long piece left over costs most of a sequence."""
    want = bins.astype(float).copy()
    want[0] = 0
    weight = np.arange(len(want), dtype=float) ** 2
    x = np.full(len(shapes), want.sum() / max(1, 3 * len(shapes)))
    upper = (weight * want)[shapes].sum(axis=1)
    for _ in range(rounds):
        used = np.bincount(shapes.ravel(), weights=np.repeat(x, 3), minlength=len(want))
        x *= upper / np.maximum((weight * used)[shapes].sum(axis=1), 1e-9)
    return x


def best_fit(bins: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length, on counts: (lengths of a sequence, how many such sequences)."""
    free: dict[int, list] = defaultdict(list)
    for length in range(min(room, len(bins) - 1), 0, -1):
        left = int(bins[length])
        while left:
            gap = next((r for r in range(length, room) if free[r]), None)
            if gap is None:
                each = room // length
                for times, size in ((left // each, each), (1, left % each)):
                    if times and size:
                        free[room - size * length].append([(length,) * size, times])
                left = 0
            else:
                held, times = free[gap][-1]
                now = min(left, times)
                if now == times:
                    free[gap].pop()
                else:
                    free[gap][-1][1] -= now
                free[gap - length].append([(*held, length), now])
                left -= now
    return [(held, times) for groups in free.values() for held, times in groups]


def layout(bins: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Which sequences to make of a histogram of lengths."""
    left, plan = bins.astype(np.int64).copy(), []
    left[0] = 0
    if left[room]:
        plan.append(((room,), int(left[room])))
        left[room] = 0
    shapes = patterns(left, room)
    if len(shapes):
        x = repeat_counts(shapes, left)
        for i in np.lexsort((-x, -shapes.max(axis=1))):  # patterns of long pieces first
            if x[i] < 1:
                continue
            lengths = [int(v) for v in shapes[i] if v]
            need = {v: lengths.count(v) for v in lengths}
            times = min(int(x[i]), *(int(left[v]) // k for v, k in need.items()))
            if times:
                plan.append((tuple(sorted(lengths, reverse=True)), times))
                for v, k in need.items():
                    left[v] -= k * times
    return plan + best_fit(left, room)


def places(plan: list[tuple[tuple[int, ...], int]], room: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from ``first rank`` on go to consecutive sequences."""
    rows, used, sequence = [], [0] * (room + 1), 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A document is its ids (null text: none) and ``end_id``; only one longer than
    ``room`` is cut, into pieces of ``room`` tokens of which the first may be
    shorter. Rows that share an id are packed each for itself. An empty table
    gives an empty result. The tokenizer's file must be readable at ``path`` on
    every executor. What reaches the driver is the histogram (``room`` numbers).
    """
    pieces = cut(docs, path, pattern, room, end_id, id_col, text_col)
    pieces = cut_lineage(pieces if with_ids else pieces.drop("ids"), "pieces")
    made = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bins = np.zeros(room + 1, np.int64)
    for row in made.groupBy("length").agg(F.sum("n").alias("n")).collect():
        bins[row["length"]] = row["n"]
    table = places(layout(bins, room), room)
    spread = 1 << 48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * spread + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * spread + rank, side="right") - 1
            arrays = [*(batch.column(c) for c in kept), pa.array(table[at, 2] + rank - table[at, 1], pa.int64()), pa.array(table[at, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(offsets, ["task", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
