"""Document fingerprints: a Merkle tree over paragraphs and sections.

Lines are paragraphs; a section ends after a paragraph whose own digest says so
(one in four), so an edit moves no boundary but those next to it. Roots test
equality, section digests locate an edit, and short marks of the pieces of a
paragraph measure how much two texts share. DataFrame functions only.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim

#: A piece: 32 characters of a line and the rest of the word they end in, or what is left of the line.
PIECE = r"[^\n]{32}[^\n ]{0,64} ?|[^\n]+"


def paragraphs(text: Column) -> Column:
    """Digests (128 bits, hex) of the lines."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.substring(F.sha2(p, 256), 1, 32))


def sections(digests: Column) -> Column:
    """Digests of the runs of paragraphs; a run ends after a digest that starts with 0 to 3."""
    marked = F.array_join(F.transform(digests, lambda d: F.when(F.substring(d, 1, 1) <= "3", F.concat(d, F.lit("/"))).otherwise(d)), "")
    return F.transform(F.split(F.rtrim(marked, F.lit("/")), "/"), lambda s: F.substring(F.sha2(s, 256), 1, 32))


def root(section_digests: Column) -> Column:
    return F.sha2(F.array_join(section_digests, ""), 256)


def marks(text: Column) -> Column:
    """A 32-bit mark of each piece, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.hash(p))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>sections``, ``<prefix>root`` and ``<prefix>marks`` of a text column."""
    return (
        df.withColumn(f"{prefix}sections", sections(paragraphs(F.col(text))))
        .withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))
        .withColumn(f"{prefix}marks", marks(F.col(text)))
    )


def as_string(prefix: str) -> Column:
    """``root:sections:marks`` in hexadecimal; equal texts have equal strings."""
    short = F.array_join(F.transform(f"{prefix}sections", lambda s: F.substring(s, 1, 16)), "/")
    hexed = F.array_join(F.transform(f"{prefix}marks", lambda m: F.lpad(F.hex(m.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")
    return F.concat_ws(":", F.col(f"{prefix}root"), short, F.lower(hexed))


def likeness(a: str, b: str) -> Column:
    """1 where the roots agree, else the share of marks that two fingerprints have in common (Dice; 0 where neither has any)."""
    common = F.size(F.array_intersect(f"{a}marks", f"{b}marks"))
    total = F.size(F.array_distinct(f"{a}marks")) + F.size(F.array_distinct(f"{b}marks"))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.lit(1.0)).otherwise(F.when(total > 0, 2.0 * common / total).otherwise(F.lit(0.0)))


def differing_sections(a: str, b: str) -> Column:
    """The section digests of ``b`` that ``a`` lacks: the branches in which an edit lies."""
    return F.array_except(f"{b}sections", f"{a}sections")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sections, root, marks, fingerprint) of every row; a null text counts as empty."""
    rows = with_tree(slim(docs, id_col, text_col), "text", "")
    return rows.select("doc_id", "sections", "root", "marks", as_string("").alias("fingerprint"))


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Deal rows into ranges of ids by quantiles; null ids are spread over buckets of their own (negative)."""
    share = [i / buckets for i in range(1, buckets)]
    quantiles = rows.select(F.percentile_approx(F.col("doc_id").cast("double"), share, 20 * buckets).alias("q")).first()["q"] or []
    splits = [-math.inf, *(sorted(set(quantiles)) or [0.0]), math.inf]
    with_id = rows.withColumn("__place", F.col("doc_id").cast("double"))
    dealt = Bucketizer(splits=splits, inputCol="__place", outputCol="__bucket", handleInvalid="keep").transform(with_id)
    bucket = F.when(F.col("doc_id").isNull(), -1 - F.pmod("rid", F.lit(64))).otherwise(F.col("__bucket").cast("long"))
    return dealt.select("doc_id", "rid", "text", bucket.alias("bucket"))


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as
    many of the next document's (or all of it), in ascending id order, and after
    the last comes the first. Rows that share an id follow each other by a hash
    of their text, and each is the next of the one before. A null id has no
    place in the order: its next document is empty. A null text counts as empty;
    a table of one row is its own next. An empty table gives an empty result.

    Rows are shuffled once, by ranges of ids; within a range the next row is
    read from a window, and only the first row of each range is handed to the
    range before it.
    """
    rows = slim(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_bucket(rows, min(4096, 8 * parts)).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("doc_id", "rid")
    heads = dealt.where("bucket >= 0").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("bucket").alias("at"), F.col("text").alias("head"))
    # a handful of numbers, one for each range: who follows whom
    ids = dealt.where("bucket >= 0").select("bucket").distinct()
    every = Window.orderBy("bucket")
    follows = ids.select(F.col("bucket").alias("of"), F.coalesce(F.lead("bucket").over(every), F.min("bucket").over(every)).alias("next"))
    heads = heads.join(follows, F.col("at") == F.col("next")).select("of", "head")

    tree = with_tree(dealt, "text", "")
    nexts = {c: F.lead(c).over(order) for c in ("text", "root", "marks")}
    led = tree.select("*", *[v.alias(f"next_{c}") for c, v in nexts.items()])
    joined = led.join(heads, F.col("bucket") == F.col("of"), "left")
    lonely, last = F.col("bucket") < 0, F.col("next_root").isNull()
    head = F.when(lonely, F.lit("")).otherwise(F.coalesce("head", F.lit("")))
    known = joined.select(
        "doc_id", "text", "sections", "root", "marks", F.length("text").alias("n"),
        F.when(lonely | last, head).otherwise(F.col("next_text")).alias("next"),
        F.when(lonely | last, root(sections(paragraphs(head)))).otherwise(F.col("next_root")).alias("next_root"),
        F.when(lonely | last, marks(head)).otherwise(F.col("next_marks")).alias("next_marks"),
    )
    half = F.floor(F.col("n") / 2).cast("int")
    edited = known.withColumn("edited", F.concat(F.left("text", F.col("n") - half), F.left("next", half)))
    both = with_tree(edited, "edited", "edited_")
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string("").alias("fingerprint"), as_string("edited_").alias("edited_fingerprint"),
        likeness("", "edited_").alias("near_edited"), likeness("", "next_").alias("near_next"),
        F.size("sections").alias("n_sections"), F.size(differing_sections("", "edited_")).alias("n_edited_sections"),
    )
