"""Spelling variants by Bloom-guided neighbourhoods.

For every word of the vocabulary its edits (one letter deleted, or replaced by a
later one) are generated as hashes and probed against a blocked Bloom filter of
the vocabulary; no edit is spelled out unless the filter knows it. The filter is
sharded by length, and a task needs the shards of the lengths it makes. What
passes is shuffled to an exact join with the vocabulary, which removes the false
positives. Insertions are the deletions of the longer word, and a replacement by
an earlier letter is found from the other word, so every pair comes up once.

A broadcast holds ``FILTER_BLOCKS`` at most: a larger vocabulary is probed in
several rounds over its lengths, and a length that is too large alone in several
ranges of the hash. Each round generates only the edits whose length it serves.
"""
from __future__ import annotations

import functools
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import name, written
from tidemark.llm.tokens import Tokens, batch_rows, bloom_bits, bloom_block, counted, gathered_blocks, in_bloom, mixed, text_groups
from tidemark.session import ship_package

#: The lead byte of U+00C0 to U+00FF in UTF-8; the byte behind it is any of that range.
LEAD = 0xC3
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")
#: 64-bit blocks that are broadcast at once (32 MB), of a shard at least, and bits for each word.
FILTER_BLOCKS, LEAST_BLOCKS, WORD_BITS = 1 << 22, 1 << 12, 16
#: Longer words share a shard with those of up to twice their length.
SINGLE_LENGTHS = 64
#: Letters of the words of one matrix.
LETTERS = 400_000


def kinds() -> np.ndarray:
    kind = np.ones(256, np.uint8)
    kind[list(string.ascii_letters.encode())] = 0
    kind[LEAD] = 0
    return kind


def planted(word: str, h: int) -> str:
    """The word without one of its letters, which the hash names."""
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(least_letters: int, every: int):
    """Rows (word, n) of groups of texts: lower-cased runs of letters, every so many of them (by document and run) a letter short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kinds()
        for texts, batch, rows in text_groups(batches, "text", BETWEEN):
            found = Tokens(texts, kind, LOWER, LEAD)
            words = found.words.cast(pa.large_string())
            long_enough = pc.utf8_length(words).to_numpy() >= least_letters if len(words) else np.zeros(0, bool)
            use = long_enough[found.code]
            code, doc = found.code[use], rows[found.doc[use]]
            at, n = counted(doc, code)
            if not len(at):
                continue
            code, doc = code[at], doc[at]
            heads = [zlib.crc32(f"{d}:".encode()) for d in batch.column("id").to_pylist()]
            raw = found.words.to_pylist()
            h = np.array([zlib.crc32(raw[c], heads[d]) for c, d in zip(code.tolist(), doc.tolist())], np.int64)
            cut = h % every == 0
            whole = np.bincount(code[~cut], weights=n[~cut], minlength=len(raw)).astype(np.int64)
            kept = np.flatnonzero(whole)
            short = [planted(raw[c].decode(), x) for c, x in zip(code[cut].tolist(), h[cut].tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.chunked_array([words.take(pa.array(kept)).cast(pa.string()), pa.array(short, pa.string())]).combine_chunks(),
                pa.array(np.concatenate([whole[kept], n[cut]]))], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least: int, every: int) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences, as a written table."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(name(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(name(text_col), F.lit("")).alias("text"))
    with batch_rows(docs.sparkSession, 1000):
        found = rows.mapInArrow(count_words(least_letters, every), "word string, n long").where(F.length("word") >= least_letters)
        return written(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "vocabulary")


@functools.cache
def letter_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


@functools.cache
def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, as many as the next power of two."""
    up = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    up[0] = 1
    return np.cumprod(up)


BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def up_to(n: int) -> np.ndarray:
    return powers(1 << max(6, int(n).bit_length()))[:n]


def length_class(length: Column) -> Column:
    """Lengths have classes of their own, long ones one for each doubling."""
    long = F.floor(F.log2(length.cast("double"))) + SINGLE_LENGTHS
    return F.when(length < SINGLE_LENGTHS, length).otherwise(long).cast("int")


def class_of(length: int) -> int:
    return length if length < SINGLE_LENGTHS else length.bit_length() - 1 + SINGLE_LENGTHS


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, letters) of words of one length: a row of ``letters`` for each word; of a bounded number of letters."""
    sizes = pc.utf8_length(words).to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = max(1, LETTERS // size)
        for i in range(0, len(at), step):
            some = at[i:i + step]
            text = "".join(words.take(pa.array(some)).to_pylist())
            yield some, np.frombuffer(text.encode("latin-1"), np.uint8).reshape(len(some), size)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash by eight bits that no Bloom filter uses."""
    return ((h >> np.uint64(24) & np.uint64(255)) * np.uint64(parts) >> np.uint64(8)).astype(np.int64)


class Round:
    """What one broadcast serves: for each length class its offset, blocks, and the hash range ``part`` of ``parts``."""

    def __init__(self, shards: dict[int, tuple[int, int, int, int]]):
        self.shards = shards
        self.blocks = sum(s[1] for s in shards.values())

    def marks(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offset, blocks, part, parts = self.shards[class_of(size)]
        h = h[part_of(h, parts) == part]
        return offset + bloom_block(h, blocks), bloom_bits(h)

    def knows(self, filter_: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
        offset, blocks, part, parts = self.shards[class_of(size)]
        found = in_bloom(filter_[offset:offset + blocks], h)
        return found if parts == 1 else found & (part_of(h, parts) == part)


def rounds(counts: dict[int, int], most: int) -> list[Round]:
    """The length classes, split where one is too large and put together while they fit ``most`` blocks."""
    units = []
    for c, n in sorted(counts.items()):
        blocks = max(LEAST_BLOCKS, n * WORD_BITS // 64 + 1)
        parts = min(256, -(-blocks // most))
        units += [(c, max(1, blocks // parts), p, parts) for p in range(parts)]
    out: list[dict] = [{}]
    used = 0
    for c, blocks, part, parts in units:
        if out[-1] and (c in out[-1] or used + blocks > most):
            out.append({})
            used = 0
        out[-1][c] = (used, blocks, part, parts)
        used += blocks
    return [Round(s) for s in out if s]


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return mixed((letter_values()[letters] * up_to(letters.shape[1])).sum(axis=1, dtype=np.uint64))


def mark(served: Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in by_length(batch.column("word")):
                block, bits = served.marks(letters.shape[1], word_hashes(letters))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    return run


def used_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(256, bool)
    for batch in batches:
        seen[np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8)] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["letter"])


def deletions(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the distinct words with one letter less: of equal neighbours only the first goes."""
    terms = letter_values()[letters] * up_to(letters.shape[1])
    before = np.cumsum(terms, axis=1, dtype=np.uint64)
    rest = (before[:, -1:] - before) * BACK
    before -= terms
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(first)
    return row, place, mixed((before + rest)[row, place])


def replacements(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(new letter, row, place, hash) of the words with one letter replaced by a later one."""
    values, up = letter_values(), up_to(letters.shape[1])
    terms = values[letters] * up
    # all terms but one's own
    others = terms.sum(axis=1, dtype=np.uint64)[:, None] - terms
    for letter in alphabet.tolist():
        row, place = np.nonzero(letters < letter)
        yield letter, row, place, mixed(others[row, place] + values[letter] * up[place])


def probe(served: Round, filter_, alphabet: np.ndarray, least_letters: int):
    """Rows (word, n, near) of the edits that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_.value
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            for at, letters in by_length(words):
                size, spelled = letters.shape[1], words.take(pa.array(at)).to_pylist()
                rows: list[int] = []
                near: list[str] = []
                if size > least_letters and class_of(size - 1) in served.shards:
                    row, place, h = deletions(letters)
                    hit = served.knows(known, size - 1, h)
                    rows += row[hit].tolist()
                    near += [spelled[r][:p] + spelled[r][p + 1:] for r, p in zip(row[hit].tolist(), place[hit].tolist())]
                if class_of(size) in served.shards:
                    for letter, row, place, h in replacements(letters, alphabet):
                        hit = served.knows(known, size, h)
                        rows += row[hit].tolist()
                        near += [spelled[r][:p] + chr(letter) + spelled[r][p + 1:] for r, p in zip(row[hit].tolist(), place[hit].tolist())]
                take = pa.array(at[rows] if rows else [], pa.int64())
                yield pa.RecordBatch.from_arrays([words.take(take), n.take(take), pa.array(near, pa.string())], ["word", "n", "near"])

    return run


def near_pairs(words: DataFrame, least_letters: int, most_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words once, from a written table (word, n)."""
    spark = words.sparkSession
    ship_package(spark)
    classed = words.withColumn("class", length_class(F.length("word")))
    counts = {r[0]: r[1] for r in classed.groupBy("class").count().collect()}  # fewer than a hundred classes
    letters = words.mapInArrow(used_letters, "letter long").distinct()
    alphabet = np.sort(letters.toArrow()["letter"].to_numpy())  # at most 90
    passed = []
    for served in rounds(counts, most_blocks):
        filter_ = np.zeros(served.blocks, np.uint64)
        block, bits = gathered_blocks(classed.where(F.col("class").isin(list(served.shards))).select("word").mapInArrow(mark(served), "block long, bits long"))
        filter_[block] = bits
        sent = spark.sparkContext.broadcast(filter_)
        shorter = length_class(F.length("word") - 1)
        mine = classed.where(F.col("class").isin(list(served.shards)) | shorter.isin(list(served.shards))).select("word", "n")
        with batch_rows(spark, 10_000):
            passed.append(written(mine.mapInArrow(probe(served, sent, alphabet, least_letters), "word string, n long, near string"), "passed"))
        sent.unpersist()
    if not passed:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    every = functools.reduce(DataFrame.unionByName, passed)
    return every.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Each is ten times as frequent as the word, so a few doublings reach the end."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = found.join(onward, "root")
        if moved.isEmpty():
            return found
        found = written(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least: int = 2, times: int = 10, every: int = 31, most_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; a run
    whose checksum with its document's id is a multiple of ``every`` loses a
    letter, which plants misspellings of known origin. A word has at least
    ``least_letters`` letters and ``least`` occurrences ``n``. Words are near that
    differ by one letter inserted, deleted or replaced; ``n_near`` counts them.
    ``form`` is the near word with the largest n (ties: the smallest), if it has
    ``times`` the word's n, ``form_n`` its n, ``root`` the last of the forms (the
    word itself without one). Null and empty texts have no words, a null id is
    written as nothing, repeated rows count as often as they occur, runs of any
    length are words, an empty table gives an empty result. Other columns are
    not read.
    """
    words = vocabulary(docs, id_col, text_col, least_letters, least, every)
    pairs = written(near_pairs(words, least_letters, most_blocks), "pairs")
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    large = -F.col("best.down") >= times * F.col("n")
    each = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.down")).alias("form_n")), "forms")
    last = roots(each.where(F.col("form").isNotNull()).select("word", "form"))
    return each.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
