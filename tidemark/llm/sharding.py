"""Sharding along a Hilbert curve through metadata.

Several metadata dimensions are quantised to a few bits each. A row's cell is a
point of a small grid, and the Hilbert curve walks the grid in steps of one
cell, so rows that follow each other on the curve are alike in all dimensions
at once. Rows are put in curve order and cut into runs; the minima and maxima
of every run then prune reads by any of the dimensions. DataFrame functions
only, and no task holds a shard: rows are ranged over tasks, a few numbers a
task carry the totals of those before it.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import name, salted_join, written

#: Bits of row numbers within a task in ``monotonically_increasing_id``.
ROW_BITS = 33


@dataclass(frozen=True)
class Dimension:
    """One axis of the grid.

    ``kind``: ``rank`` (share of rows with a smaller value, so every level holds
    about as many), ``range`` (equal steps between the smallest and the largest
    number) or ``size`` (doublings of the row's size; ``column`` is not used).
    """

    column: str | None
    kind: str


#: What documents are usually selected by.
METADATA = (Dimension("lang", "rank"), Dimension("source", "rank"), Dimension(None, "size"), Dimension("doc_id", "range"))


def hilbert(df: DataFrame, axes: Sequence[str], bits: int, out: str) -> DataFrame:
    """``df`` with the place ``out`` of the point ``axes`` (whole numbers below 2**bits) on the Hilbert curve.

    Axes are turned into the curve's transposed form level by level, highest
    bit first, and its bits are interleaved. Every step is a projection of its
    own, as each uses the last one's values several times.
    """
    first = axes[0]
    work = df.withColumns({f"__{a}": F.col(a).cast("long") for a in axes})
    col = lambda a: F.col(f"__{a}")
    for bit in range(bits - 1, 0, -1):
        low = F.lit((1 << bit) - 1).cast("long")
        for a in axes:
            set_here = F.shiftright(col(a), bit).bitwiseAND(F.lit(1)) == 1
            if a == first:
                work = work.withColumn(f"__{first}", F.when(set_here, col(first).bitwiseXOR(low)).otherwise(col(first)))
            else:
                differ = col(first).bitwiseXOR(col(a)).bitwiseAND(low)
                work = work.withColumns({
                    f"__{first}": F.when(set_here, col(first).bitwiseXOR(low)).otherwise(col(first).bitwiseXOR(differ)),
                    f"__{a}": F.when(set_here, col(a)).otherwise(col(a).bitwiseXOR(differ))})
    for before, a in zip(axes, axes[1:]):
        work = work.withColumn(f"__{a}", col(a).bitwiseXOR(col(before)))
    last, flip = col(axes[-1]), F.lit(0).cast("long")
    for bit in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.shiftright(last, bit).bitwiseAND(F.lit(1)) * F.lit((1 << bit) - 1))
    work = work.withColumn("__flip", flip)
    place = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(col(a).bitwiseXOR(F.col("__flip")), bit).bitwiseAND(F.lit(1)))
    return work.withColumn(out, place).drop("__flip", *[f"__{a}" for a in axes])


def in_order(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` as a written table in the order of some columns, with ``at``: the number of its range, then its row there."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("at", F.monotonically_increasing_id()), label)


def range_totals(ordered: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(range, each sum, ``before_`` each sum): one row per range of :func:`in_order`, as many as that write had tasks."""
    each = ordered.groupBy(F.shiftright("at", ROW_BITS).alias("range")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("*", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in sums])


def rank_levels(values: DataFrame, levels: int, label: str) -> DataFrame:
    """(value, level) of the distinct values of the one column ``value``, by the share of rows below each."""
    counted = in_order(values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n")), ["value"], label)
    totals = written(range_totals(counted, {"n": F.col("n")}).withColumnRenamed("n", "here"), f"{label}-totals")
    rows = totals.agg(F.sum("here")).first()[0] or 1
    run = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    joined = counted.withColumn("range", F.shiftright("at", ROW_BITS)).join(F.broadcast(totals.select("range", "before_n")), "range")
    below = F.col("before_n") + F.coalesce(F.sum("n").over(run), F.lit(0))
    return written(joined.select("value", below.alias("below")).select("value", F.floor(F.col("below") * levels / F.lit(rows)).cast("long").alias("level")), f"{label}-levels")


def with_levels(rows: DataFrame, dimensions: Sequence[Dimension], bits: int) -> DataFrame:
    """``rows`` with ``l0``, ``l1``, ... below 2**bits for their ``v0``, ``v1``, ...; null is level 0."""
    levels, top = 1 << bits, (1 << bits) - 1
    ends = {i: (F.min(f"v{i}").cast("double"), F.max(f"v{i}").cast("double")) for i, d in enumerate(dimensions) if d.kind == "range"}
    found = rows.agg(*[e.alias(f"{k}{i}") for i, pair in ends.items() for k, e in zip("ab", pair)]).first() if ends else {}
    for i, d in enumerate(dimensions):
        if d.kind == "rank":
            known = rank_levels(rows.select(F.col(f"v{i}").alias("value")), levels, f"rank{i}").withColumnsRenamed({"value": f"v{i}", "level": f"l{i}"})
            rows = salted_join(rows, known, [f"v{i}"], F.struct("id", "size"), "left").withColumn(f"l{i}", F.coalesce(f"l{i}", F.lit(0)))
        elif d.kind == "range":
            low, high = found[f"a{i}"], found[f"b{i}"]
            share = (F.col(f"v{i}").cast("double") - F.lit(low)) * levels / F.lit((high or 0.0) - (low or 0.0) + 1.0)
            rows = rows.withColumn(f"l{i}", F.coalesce(F.least(F.floor(share), F.lit(top)), F.lit(0)).cast("long"))
        else:
            rows = rows.withColumn(f"l{i}", F.least(F.length(F.bin("size")) - 1, F.lit(top)).cast("long"))
    return rows


def first_rows(ordered: DataFrame, totals: DataFrame, shards: int, total: int) -> list[tuple[int, int, int]]:
    """(shard, ``at`` and place of its first row) of the runs of near equal bytes; only ranges that hold a cut are walked row by row."""
    shard = lambda before: F.floor(before * shards / F.lit(total)).cast("int")
    begin, end = shard(F.col("before_bytes")), shard(F.col("before_bytes") + F.col("bytes") - 1)
    whole = totals.where(begin == end).select(begin.alias("shard"), F.shiftleft("range", ROW_BITS).alias("at"), F.col("before_rows").alias("place"))
    cut = F.broadcast(totals.where(begin != end).select("range", "before_bytes", "before_rows"))
    run = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.select("at", "size", F.shiftright("at", ROW_BITS).alias("range")).join(cut, "range").select(
        shard(F.col("before_bytes") + F.coalesce(F.sum("size").over(run), F.lit(0))).alias("shard"), "at",
        (F.col("before_rows") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("place"))
    firsts = whole.unionByName(inside).groupBy("shard").agg(F.min("at").alias("at"), F.min("place").alias("place")).orderBy("shard")
    return [tuple(r) for r in firsts.collect()]  # at most one row a shard


def placed(docs: DataFrame, id_col: str, text_col: str, dimensions: Sequence[Dimension], bits: int, shards: int, law: str, keep: bool) -> DataFrame:
    """(id, size, crc, curve, shard, slot, v0, v1, ...) of every row; with ``keep`` the row's columns travel along as ``row``."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law {law!r} is neither bytes nor rows")
    if not 0 < bits * len(dimensions) < 63:
        raise ValueError("the curve's places must fit 62 bits")
    text = F.coalesce(name(text_col), F.lit("")).cast("binary")
    values = [(name(d.column) if d.column else F.lit(None).cast("long")).alias(f"v{i}") for i, d in enumerate(dimensions)]
    carried = [F.struct(*[name(c) for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(name(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), *values, *carried)
    axes = [f"l{i}" for i in range(len(dimensions))]
    rows = hilbert(with_levels(rows, dimensions, bits), axes, bits, "curve").drop(*axes)
    # rows that agree in the first four may swap places, and no result shows it
    ordered = in_order(rows.withColumn("nth", F.monotonically_increasing_id()), ["curve", "id", "size", "crc", "nth"], "curve").drop("nth")
    totals = written(range_totals(ordered, {"rows": F.lit(1), "bytes": F.col("size")}), "curve-totals")
    n, total = totals.agg(F.sum("rows"), F.sum("bytes")).first()
    if not n:
        firsts = [(0, 0, 0)]
    elif law == "bytes":
        firsts = first_rows(ordered, totals, shards, total)
    known = F.broadcast(totals.select("range", "before_rows"))  # one row a task of the write
    found = ordered.withColumn("range", F.shiftright("at", ROW_BITS)).join(known, "range").withColumn("place", F.col("before_rows") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    if law == "rows":
        found = found.withColumn("shard", F.floor(F.col("place") * shards / F.lit(n or 1)).cast("int"))
        begin = F.ceil(F.col("shard").cast("long") * F.lit(n or 1) / shards)
    else:
        shard, begin = F.lit(firsts[0][0]), F.lit(firsts[0][2])
        for s, at, place in firsts[1:]:
            shard, begin = F.when(F.col("at") >= at, F.lit(s)).otherwise(shard), F.when(F.col("at") >= at, F.lit(place)).otherwise(begin)
        found = found.withColumn("shard", shard.cast("int"))
    return found.withColumn("slot", (F.col("place") - begin).cast("long")).drop("at", "range", "before_rows", "place")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: Sequence[Dimension] = METADATA, bits: int = 5, shards: int = 8, law: str = "bytes") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``bytes`` (runs of near equal size: a cut is off by less than the
    row it falls on) or ``rows`` (counts at most one apart). ``size`` is the
    text's UTF-8 bytes plus one, ``slot`` the row's place in its shard. Rows are
    in the order of their place on the curve, then of id, size and checksum, so
    equal cells are cut like any other. A null text is empty, a null value of a
    dimension is its lowest level, a null id comes first. Rows that repeat each
    other have places of their own. With fewer rows than shards, and where one
    row is larger than a shard, shards stay empty. An empty table gives an empty
    result. ``grown_shard`` is null: a curve has no law for one more shard.
    """
    found = placed(docs, id_col, text_col, dimensions, bits, shards, law, keep=False)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dimensions: Sequence[Dimension] = METADATA, bits: int = 5, shards: int = 8, law: str = "bytes") -> DataFrame:
    """Write ``docs`` to ``path``/shards (one folder a shard, rows in curve order) and return the manifest, also written to ``path``/manifest.

    The manifest has a row per shard: shard, n_rows, n_bytes and for the
    dimension ``i`` its smallest and largest value, ``low_i`` and ``high_i`` (the
    size itself for a ``size`` dimension; nulls are not counted). A column of
    ``docs`` named ``shard`` would clash with the folders and is refused.
    """
    if "shard" in docs.columns:
        raise ValueError("the column shard would clash with the folders")
    spark = docs.sparkSession
    found = written(placed(docs, id_col, text_col, dimensions, bits, shards, law, keep=True), "placed")
    ends = [(F.col("size") if d.kind == "size" else F.col(f"v{i}"), i) for i, d in enumerate(dimensions)]
    found.sortWithinPartitions("shard", "slot").select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "shard").write.partitionBy("shard").parquet(f"{path}/shards")
    each = found.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"),
        *[f(c).alias(f"{k}_{i}") for c, i in ends for k, f in (("low", F.min), ("high", F.max))])
    each.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_shards(spark, path: str, bounds: dict[int, tuple]) -> DataFrame:
    """The rows of the shards that can hold values within ``bounds`` (dimension: smallest, largest), other folders unread."""
    manifest = spark.read.parquet(f"{path}/manifest")
    for i, (low, high) in bounds.items():
        manifest = manifest.where((F.col(f"high_{i}") >= F.lit(low)) & (F.col(f"low_{i}") <= F.lit(high)))
    use = [r[0] for r in manifest.select("shard").collect()]  # at most one row a shard
    return spark.read.parquet(f"{path}/shards").where(F.col("shard").isin(use))
