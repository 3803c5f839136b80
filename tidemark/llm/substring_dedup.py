"""Substring dedup by super-k-mer partitioning.

A window is a run of consecutive words. Each window is dealt by its minimiser,
the smallest hash among its runs of ``MINI`` words; consecutive windows with
one minimiser travel as one packed string. The strings that a group of texts has
for one shuffle partition share a compressed block. Behind the shuffle they are
rows again, which Spark sorts by minimiser within the partition (and spills where
it must). A bucket is a stretch of that order, cut between minimisers: there every
window is cut out again, the windows are sorted by a rolling hash, equal runs are
verified byte by byte, and each window learns the smallest document that starts
it. What returns to the documents are runs of window starts.

A minimiser of a very common phrase would gather a bucket that no task can hold.
Slots (hash ranges of minimisers) are counted first, by strings and by bytes, and
windows of a slot far above the others are not gathered: their first documents
are pre-aggregated by window and joined back, a join that Spark can split.
"""
from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, restored, salted_join, schema, small_batches, written
from tidemark.llm.words import give_back, in_groups
from tidemark.session import ship_package

#: Words of a run whose hash can be a minimiser.
MINI = 3
#: Hash ranges of minimisers that are counted; a slot is hot beyond HOT_SHARE times the mean and HOT_LEAST packed strings, or as many bytes.
SLOTS, HOT_SHARE, HOT_LEAST, HOT_BYTES = 1 << 16, 8, 8192, 4_000_000
#: Bytes of packed strings beyond which a bucket ends at the next minimiser.
BUCKET_BYTES = 1_500_000
#: Windows of a packed string at most; the next string repeats the words that its first windows need.
STRING_WINDOWS = 4096
#: The smallest long stands for a null id, which counts as below all others.
NO_ID = -(1 << 63)


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class Spans:
    """Hashes of spans of a buffer, each in constant time from running sums."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(16, int(len(data)).bit_length())
        up, self.down = powers(n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * up[:len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and line numbers of the words of a buffer with one space or newline between words."""
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    line = np.concatenate([[0], np.cumsum(data[gaps] == 10)])
    return starts, ends, line


def windows_of(line: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that start a window: ``width`` words of one line."""
    if len(line) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(line[:len(line) - width + 1] == line[width - 1:])


class Packed:
    """Super-k-mers of a group of texts: arrays ``doc``, ``word`` (first word), ``size`` (windows), ``mini``, ``start``, ``end`` (bytes)."""

    def __init__(self, texts: list[bytes], width: int):
        self.text = b"\n".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        self.starts, self.ends, line = word_edges(data)
        first = windows_of(line, width)
        mini = Spans(data).hash(self.starts[:len(self.starts) - MINI + 1], self.ends[MINI - 1:]) if len(first) else np.zeros(0, np.uint64)
        least = sliding_min(mini, width - MINI + 1)[first] if len(first) else mini
        new = np.ones(len(first), bool)
        new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)
        if len(first):
            starts = np.flatnonzero(new)
            new = (np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))) % STRING_WINDOWS == 0
        heads = np.flatnonzero(new)
        self.size = np.diff(np.append(heads, len(first)))
        self.mini, at = least[heads], first[heads]
        self.doc = line[at]
        begins = np.searchsorted(line, np.arange(len(texts)))
        self.word, self.at = at - begins[self.doc], at
        self.start, self.end = self.starts[at], self.ends[at + self.size + width - 2]

    @property
    def slot(self) -> np.ndarray:
        return (self.mini >> np.uint64(47)).astype(np.int64) % SLOTS


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, Packed]]:
    """(ids, rids, packed) of groups of rows with at least one window; every text is whole."""
    for part, texts in in_groups(batches, "text", 1_000_000):
        words = [t.encode().split() for t in texts]
        use = [i for i, w in enumerate(words) if len(w) >= width]
        if use:
            d, rid = (part.column(c).to_numpy(zero_copy_only=False) for c in ("d", "rid"))
            yield d[use], rid[use], Packed([b" ".join(words[i]) for i in use], width)


def count_slots(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for _, _, found in grouped(batches, width):
            strings += np.bincount(found.slot, minlength=SLOTS)
            size += np.bincount(found.slot, weights=found.end - found.start, minlength=SLOTS).astype(np.int64)
        use = np.flatnonzero(strings)
        yield pa.RecordBatch.from_arrays([pa.array(use), pa.array(strings[use]), pa.array(size[use])], ["slot", "strings", "size"])

    return run


def pack_blocks(width: int, hot: frozenset[int], parts: int):
    """Rows (part, block): the packed strings of a group of texts for one shuffle partition, each with a line feed behind it, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        hot_slots = np.array(sorted(hot), np.int64)
        for d, rid, p in grouped(batches, width):
            part = (p.mini % np.uint64(parts)).astype(np.int32)
            use = np.flatnonzero(~np.isin(p.slot, hot_slots))
            order = use[np.argsort(part[use], kind="stable")]
            text, to, blocks = p.text, [], []
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(some):
                    docs, nth = np.unique(p.doc[some], return_inverse=True)
                    strings = [text[a:b] for a, b in zip(p.start[some].tolist(), p.end[some].tolist())]
                    to.append(part[some[0]])
                    blocks.append(squeeze(b"".join([
                        struct.pack("<II", len(docs), len(some)), d[docs].tobytes(), rid[docs].tobytes(), p.mini[some].tobytes(), p.word[some].astype("<i8").tobytes(),
                        nth.astype("<u4").tobytes(), b"\n".join(strings), b"\n"])))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    return run


def unpack(block: bytes) -> pa.RecordBatch:
    """The rows (mini, d, rid, word, string) of a block."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    docs, n = struct.unpack_from("<II", raw)
    at = 8

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += found.nbytes
        return found

    d, rid, mini, word, nth = column("<i8", docs), column("<i8", docs), column("<i8", n), column("<i8", n), column("<u4", n)
    text = raw[at:]
    edges = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1]).astype(np.int32)
    strings = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(text)])
    return pa.RecordBatch.from_arrays([pa.array(mini), pa.array(d[nth]), pa.array(rid[nth]), pa.array(word), strings], ["mini", "d", "rid", "word", "string"])


def unpack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            yield unpack(block.as_py())
        give_back()


def first_documents(strings: bytes, start: np.ndarray, end: np.ndarray, key: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each window the smallest ``d`` among windows with the same bytes.

    Sorted by hash; a run of equal hashes is compared with its first window byte
    by byte, and told apart by its bytes should they differ."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    sizes = np.diff(np.append(heads, len(order)))
    low = np.repeat(np.minimum.reduceat(d[order], heads), sizes)
    # only runs that would drop something need the proof
    run = np.repeat(np.arange(len(heads)), sizes)
    doubt = np.flatnonzero(np.isin(run, run[d[order] > low]))
    a, b = start[order].tolist(), end[order].tolist()
    lead = heads[run]
    wrong = {int(run[i]) for i in doubt.tolist() if strings[a[i]:b[i]] != strings[a[lead[i]]:b[lead[i]]]}
    for r in wrong:
        seen: dict[bytes, int] = {}
        span = range(heads[r], heads[r] + sizes[r])
        for i in span:
            text = strings[a[i]:b[i]]
            seen[text] = min(seen.get(text, d[order[i]]), d[order[i]])
        for i in span:
            low[i] = seen[strings[a[i]:b[i]]]
    out = np.empty(len(d), np.int64)
    out[order] = low
    return out


def judge_bucket(d: np.ndarray, rid: np.ndarray, word: np.ndarray, strings: bytes, width: int, window_hash: Callable | None = None) -> tuple[np.ndarray, ...]:
    """Runs (d, rid, start, length) of windows that a smaller document starts too; ``strings`` has a line for each packed string."""
    data = np.frombuffer(strings, np.uint8)
    starts, ends, line = word_edges(data)
    at = windows_of(line, width)
    of = line[at]
    begin, end = starts[at], ends[at + width - 1]
    key = (window_hash or Spans(data).hash)(begin, end)
    drop = np.flatnonzero(d[of] > first_documents(strings, begin, end, key, d[of]))
    of, at = of[drop], at[drop]
    heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])) if len(of) else np.zeros(0, np.int64)
    length = np.diff(np.append(heads, len(of)))
    place = word[of] + at - np.searchsorted(line, of)
    return d[of[heads]], rid[of[heads]], place[heads], length


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stretches of sorted rows, cut between minimisers, of about ``BUCKET_BYTES`` or one minimiser."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("string").nbytes
        if size >= BUCKET_BYTES:
            rows = pa.Table.from_batches(held)
            mini = rows["mini"].to_numpy()
            cut = int(np.searchsorted(mini, mini[-1]))
            if cut:
                yield rows.slice(0, cut)
                held = pa.Table.from_batches(rows.slice(cut).to_batches(), rows.schema).to_batches()
                size = sum(b.column("string").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def judge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets(batches):
            if rows.num_rows:
                strings = b"".join(rows["string"].to_pylist())[:-1]
                found = judge_bucket(*(rows[c].to_numpy() for c in ("d", "rid", "word")), strings, width)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["d", "rid", "start", "length"])

    return run


def hot_windows(width: int, hot: frozenset[int]):
    """Rows (window, d, rid, start): 128-bit digests of the windows in hot slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.array(sorted(hot), np.int64)
        for d, rid, p in grouped(batches, width):
            use = np.flatnonzero(np.isin(p.slot, slots))
            many = p.size[use]
            of = np.repeat(use, many)
            step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            a, b = p.starts[p.at[of] + step].tolist(), p.ends[p.at[of] + step + width - 1].tolist()
            digest = [hashlib.blake2b(p.text[x:y], digest_size=16).digest() for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(d[p.doc[of]]), pa.array(rid[p.doc[of]]), pa.array(p.word[of] + step)], ["window", "d", "rid", "start"])

    return run


def repeated_runs(rows: DataFrame, width: int, slots_hot: int = HOT_LEAST) -> DataFrame:
    """Runs (d, rid, start, length) of windows of (d, rid, text) that also start in a row with a smaller ``d``."""
    spark = rows.sparkSession
    ship_package(spark)
    small_batches(rows)
    rows = rows.select("d", "rid", "text")
    counts = rows.mapInArrow(count_slots(width), "slot long, strings long, size long").groupBy("slot").agg(F.sum("strings").alias("strings"), F.sum("size").alias("size"))
    table = counts.toPandas()  # at most SLOTS rows
    few = max(HOT_SHARE * table["strings"].sum() / SLOTS, slots_hot)
    short = max(HOT_SHARE * table["size"].sum() / SLOTS, HOT_BYTES)
    hot = frozenset(table.loc[(table["strings"] > few) | (table["size"] > short), "slot"].astype(int).tolist())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(pack_blocks(width, hot, parts), "part int, block binary").repartitionById(parts, "part")
    strings = blocks.mapInArrow(unpack_all, "mini long, d long, rid long, word long, string binary").sortWithinPartitions("mini")
    runs = strings.mapInArrow(judge(width), "d long, rid long, start long, length long")
    if hot:
        each = written(rows.mapInArrow(hot_windows(width, hot), "window binary, d long, rid long, start long"), "hot-windows")
        least = each.groupBy("window").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("window", "least")
        late = salted_join(each, least, ["window"], F.col("rid")).where("d > least").select("d", "rid", "start", F.lit(1).cast("long").alias("length"))
        runs = runs.unionByName(late)
    return runs


def covered(n: int, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words a window of the runs covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length + width - 1, -1)
    return np.cumsum(edge[:n]) > 0


def cut_words(width: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_groups(batches, "text", 1_000_000):
            n, gone, kept = [], [], []
            for text, runs in zip(texts, part.column("runs")):
                words = text.encode().split()
                n.append(len(words))
                runs = runs.values
                if runs is not None and len(runs):
                    drop = covered(len(words), runs.field("start").to_numpy(), runs.field("length").to_numpy(), width)
                    gone.append(int(drop.sum()))
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*columns, "n_words", "n_removed", "kept"])

    return run


def cut_rows(docs: DataFrame, id_col: str, text_col: str, width: int, slots_hot: int) -> DataFrame:
    """(row, text, n_words, n_removed, kept) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = packed(docs, id_col, text_col).withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    runs = repeated_runs(rows, width, slots_hot).distinct().groupBy("d", "rid").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    found = rows.join(written(runs, "runs"), ["d", "rid"], "left").select("row", "text", "runs")
    return found.mapInArrow(cut_words(width, ["row", "text"]), schema(found, ["row", "text"], "n_words long, n_removed long, kept string"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, slots_hot: int = HOT_LEAST) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but the text), ``kept`` text, ``n_words``, ``n_removed``.

    A word goes if a window of ``width`` consecutive words covers it that also
    starts in a row with a smaller id; windows are those of the input. Kept words
    are joined by one space. Null and empty texts have no words. A null id counts
    as below all others. Rows that share an id do not remove each other's words.
    An empty table gives an empty result.
    """
    return cut_rows(docs, id_col, text_col, width, slots_hot).select("row", "kept", "n_words", "n_removed")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """``docs`` with its own columns, the repeated words gone; a text that loses nothing stays as it is, blanks included."""
    cut = cut_rows(docs, id_col, text_col, width, HOT_LEAST)
    return cut.select(*restored(docs.columns, text_col, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))
