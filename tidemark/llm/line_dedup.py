"""Line dedup: drop lines that many documents share, all but one copy.

Lines are exploded and reduced to a digest of their normalised form; documents
per digest are counted in two pre-aggregated steps, so a line that a third of
all documents hold is never gathered in one task. Only positions go back to
the documents, which are reassembled by position. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, lower_ascii, packed, restored, salted_join, same_row


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rid, pos, key) of every line long enough to be judged.

    ``key`` is 128 bits of the SHA-256 of the line, stripped of blanks at both
    ends and with A-Z lower-cased."""
    lines = rows.select("doc_id", "rid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    stripped = lines.select("doc_id", "rid", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= min_chars)
    return stripped.select("doc_id", "rid", "pos", F.unhex(F.substring(F.sha2(lower_ascii(F.col("line")), 256), 1, 32)).alias("key"))


def without(lines: Column, drop: Column) -> Column:
    """The lines whose positions are not in the sorted array ``drop``: the slices between dropped positions, linear in both."""
    edge = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: F.slice(lines, F.get(edge, i) + 2, F.get(edge, i + 1) - F.get(edge, i) - 1))
    return F.flatten(between)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``row`` (as it was), ``kept`` text, ``n_lines``, ``n_dropped``.

    A line with a key of at least ``min_chars`` code points that occurs in at
    least ``min_docs`` documents is dropped everywhere but in the document with
    the largest id that holds it (there every copy stays). A null or empty text
    is one empty line. Rows that share an id are one document when documents
    are counted; a null id is a document below all others. An empty table gives
    an empty result.
    """
    rows = packed(docs, id_col, text_col)
    keys = line_keys(rows, min_chars)
    spread = (
        keys.select("key", "doc_id").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("stays")).where(F.col("n_docs") >= min_docs)
    )
    drop = (
        salted_join(keys, spread, ["key"], F.col("rid")).where(~F.col("doc_id").eqNullSafe(F.col("stays")))
        .groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    found = rows.join(drop, same_row(rows, drop), "left").select("row", "text", "drop")
    split = found.select("row", "text", "drop", F.split("text", "\n", -1).alias("lines"))
    return split.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("lines"), F.col("drop")), "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its own columns, the common lines gone from the text (and ``n_chars`` brought up to date)."""
    return judged(docs, id_col, text_col, min_chars, min_docs).select(*restored(docs.columns, text_col, F.col("kept")))
