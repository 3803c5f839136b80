"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared only within buckets: of five parts of the 64 bits at
least two are untouched by three flipped bits, so each fingerprint joins the
ten buckets of its pairs of parts. In a bucket, bit planes are held vertically
and many distances are counted at once by carry-save adders on machine words; a
block is abandoned when every distance in it exceeds the radius. Links leave a
bucket as a spanning forest, never as pairs, and components are joined by
alternating star steps.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, restored, salted_join, slim, small_batches
from tidemark.llm.words import in_groups
from tidemark.session import cut_lineage, ship_package

BITS = 64
#: Widths of the five parts; a bucket is two of them (25 or 26 bits).
PARTS = (13, 13, 13, 13, 12)
#: Members of a bucket that one task compares with as many others.
TILE = 8192


def bit_majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at:at + 65_536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def text_fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words (repeats count; fewer words: the whole sequence; none: 0)."""
    words = text.encode().lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    return bit_majority(np.array([hashed(joined[a:b], 42) for a, b in spans], np.uint64))


def fingerprints(rows: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, rid, fp) of (doc_id, rid, text); ``fp`` holds the 64 bits as a long."""
    ship_package(rows.sparkSession)
    small_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_groups(batches, "text", 1_000_000):
            fp = np.array([text_fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(fp)], ["doc_id", "rid", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id {kind}, rid long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 of them to a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    tall = np.zeros((BITS, -(-len(values) // 64) * 64), np.uint8)
    tall[:, :len(values)] = bits.T
    return np.packbits(tall, axis=1, bitorder="little").view("<u8")


def beyond(differences: Iterable[np.ndarray], radius: int) -> np.ndarray:
    """Words whose bits mark the lanes that differ in more than ``radius`` places.

    ``differences`` yields one plane of differing bits at a time. Counters of
    just enough bits are held as planes and increased by carry-save addition;
    a lane that overflows stays marked. Stops when all lanes have."""
    counters: list[np.ndarray] = []
    over = start = None
    for number, carry in enumerate(differences):
        if over is None:
            width = radius.bit_length()
            start = (1 << width) - 1 - radius  # so that the counter overflows just past the radius
            full = np.full_like(carry, np.iinfo(np.uint64).max)
            counters = [full.copy() if start >> k & 1 else np.zeros_like(carry) for k in range(width)]
            over = np.zeros_like(carry)
        for k, held in enumerate(counters):
            counters[k], carry = held ^ carry, held & carry
        over |= carry
        if number % 8 == 7 and (over == np.iinfo(np.uint64).max).all():
            break
    return over


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def joined(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each group) after linking p[i] with q[i]."""
    while len(p):
        low = np.minimum(labels[p], labels[q])
        np.minimum.at(labels, labels[p], low)
        np.minimum.at(labels, labels[q], low)
        while (labels != (up := labels[labels])).any():
            labels = up
        apart = labels[p] != labels[q]
        p, q = p[apart], q[apart]
    return labels


def link_tiles(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Labels over ``left`` followed by ``right`` (or ``left`` alone, if they are one) from all links between the two."""
    same = left is right
    values = left if same else np.concatenate([left, right])
    labels, shift = np.arange(len(values)), 0 if same else len(left)
    tall = planes(right)
    # bits that vary come first: they tell lanes apart, the others never differ
    varies = [b for b in range(BITS) if len(np.unique((values >> np.uint64(b)) & np.uint64(1))) > 1]
    for at in range(0, len(left), 64):
        some = left[at:at + 64]
        asked = {b: np.where((some >> np.uint64(b)) & np.uint64(1), np.iinfo(np.uint64).max, 0).astype(np.uint64)[:, None] for b in varies}
        if not varies:
            near = np.ones((len(some), len(right)), bool)
        else:
            over = beyond((tall[b][None, :] ^ asked[b] for b in varies), radius)
            if (over == np.iinfo(np.uint64).max).all():
                continue
            near = ~lanes(over, len(right))
        p, q = np.nonzero(near)
        labels = joined(labels, p + at, q + shift)
    return labels


def link_small(cell: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Labels over many small sorted cells at once; lane i of step d compares i with i + d."""
    labels = np.arange(len(values))
    for step in range(1, len(values)):
        p = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(p):
            break
        tall = planes(values[p] ^ values[p + step])
        near = ~lanes(beyond((tall[b] for b in range(BITS)), radius), len(p))
        labels = joined(labels, p[near], p[near] + step)
    return labels


def links_in_cells(radius: int):
    """A function for mapInArrow: rows (cell, side, fp) sorted by cell and side in, spanning links (a, b) out."""

    def solve(cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, ids = fp.view(np.uint64), np.arange(len(fp))
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(heads, len(cell)))
        small = np.repeat(sizes <= 64, sizes) & ~np.repeat(side[heads] != side[heads + sizes - 1], sizes)
        a, b = [], []
        if small.any():
            labels = link_small(np.repeat(heads, sizes)[small], values[small], radius)
            at = ids[small]
            a.append(fp[at])
            b.append(fp[at[labels]])
        for head, size in zip(heads[~small[heads]].tolist(), sizes[~small[heads]].tolist()):
            part, sides = values[head:head + size], side[head:head + size]
            cut = int(np.searchsorted(sides, sides[-1]))
            labels = link_tiles(part, part, radius) if cut == 0 else link_tiles(part[:cut], part[cut:], radius)
            a.append(part.view(np.int64))
            b.append(part[labels].view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        return a[a != b], b[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit(rows):
            a, b = solve(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "fp"))
            if not len(rows[0]):
                continue
            held.append(rows)
            size += len(rows[0])
            if size >= 4 * TILE and rows[0][0] != rows[0][-1]:  # cells are whole but for the last
                rows = tuple(np.concatenate(x) for x in zip(*held))
                end = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1
                yield emit(tuple(x[:end] for x in rows))
                held, size = [tuple(x[end:] for x in rows)], len(rows[0]) - end
        if held:
            yield emit(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def links(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints within ``radius`` (3 at most)."""
    if not 0 <= radius <= len(PARTS) - 2:
        raise ValueError("the parts serve a radius of at most three")
    ship_package(fps.sparkSession)
    at = [sum(PARTS[:i]) for i in range(len(PARTS))]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, PARTS)]
    two = [(i, j) for i in range(len(PARTS)) for j in range(i)]
    keys = F.array(*[F.shiftleft(part[i], 13).bitwiseOR(part[j]).bitwiseOR(F.lit(k << 26)) for k, (i, j) in enumerate(two)])
    spread = fps.select("fp", F.explode(keys).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = salted_join(spread, sizes, ["bucket"], F.col("fp")).select("bucket", "fp", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    members = members.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a large bucket becomes cells, one for each pair of its tiles
    cells = members.select("bucket", "fp", F.col("tile").alias("side"), "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    cells = cells.select("bucket", low.alias("low"), high.alias("high"), "side", "fp")
    dealt = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side", "fp")
    one = F.struct("bucket", "low", "high")
    keyed = dealt.select(F.xxhash64(one).alias("cell"), "side", "fp")
    return keyed.mapInArrow(links_in_cells(radius), "a long, b long").distinct()


def crooked(edges: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are anything but stars around their ``v``: a node has two edges down, or one down and one up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    most = nodes.agg(F.max(F.col("down") + F.col("up")).alias("most")).first()["most"]
    return most is not None and most > 1


def stars(edges: DataFrame) -> DataFrame:
    """Edges (node, root) that join every node of a component to its smallest node.

    Alternates large-star and small-star steps; each ends in a written table.
    Both keep components whole and edges falling, so once only stars are left
    their centres are the smallest nodes. Hot nodes only ever appear as keys of
    pre-aggregated minima and of joins that Spark can split."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while crooked(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], F.col("v"))
        edges = cut_lineage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(rows: DataFrame, radius: int = 3, width: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, rid, fp, root, component_id) of (doc_id, rid, text).

    ``root`` tells components apart also where rows of two of them share the smallest id."""
    prints = cut_lineage(fingerprints(rows, width), "prints")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = stars(links(fps.select("fp"), radius, tile))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(salted_join(rooted, smallest, ["root"], F.col("fp")).select("fp", "root", "component_id"), "fp").select("doc_id", "rid", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Fingerprints link at ``radius`` (at most 3) or fewer differing bits. Null and
    empty texts have fingerprint zero, linked like any other. A null id is never
    the smallest unless all ids of a component are null. An empty table gives an
    empty result.
    """
    found = classes(slim(docs, id_col, text_col), radius, width)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of rows that share it the first by text hash.

    Rows without a word are one component, as their fingerprints are equal."""
    rows = packed(docs, id_col, text_col).withColumn("key", F.struct("doc_id"))
    found = classes(rows.select("doc_id", "rid", "text"), radius, width)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    stay = first.select(F.struct(F.col("first.doc_id").alias("doc_id")).alias("key"), F.col("first.rid").alias("rid"))
    kept = rows.join(stay, ["rid", "key"], "left_semi").dropDuplicates(["rid", "key"])
    return kept.select(*restored(docs.columns, text_col, F.col("text")))
