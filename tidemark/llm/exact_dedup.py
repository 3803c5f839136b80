"""Exact dedup by content-defined chunk recipes.

A text with its blanks normalised is cut into chunks where its own content says
so. Chunks are reduced to identifiers, and the identifiers are verified: every
distinct chunk is grouped with its identifier once, and where two different
chunks share one, a rank tells them apart. From there on documents are compared
by their ordered identifier lists, a few bytes for each kilobyte of text; no
document is moved whole. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, slim
from tidemark.session import cut_lineage

#: A chunk ends after punctuation and a blank, 512 code points from its start at
#: the earliest; with no such place in the first 4096 it ends there.
CHUNK = r"(?s).{512,4096}?[.,;:!?] |.{1,4096}"


def normalised(text: Column) -> Column:
    """Each run of blanks as one space (single spaces are left alone, which saves most of the work)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunk_id(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = slim(docs, id_col, text_col).select("doc_id", "rid", normalised(F.col("text")).alias("text"))
    return rows.select("doc_id", "rid", "text", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks"))


def shared_ids(cut: DataFrame, bits: int) -> DataFrame:
    """(id, chunk, rank) of the chunks whose identifier another chunk has too; with 64 bits hardly ever any.

    Each distinct chunk is moved once; a chunk that occurs often is reduced to
    one row before the shuffle."""
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(chunk_id(F.col("chunk"), bits).alias("id"), "chunk").distinct()
    doubtful = cut_lineage(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "doubtful")
    if doubtful.isEmpty():
        return None
    ranked = distinct.join(doubtful, "id").select("id", "chunk", F.row_number().over(Window.partitionBy("id").orderBy("chunk")).alias("rank"))
    return cut_lineage(ranked, "ranked")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified chunk identifiers of each normalised text, as a written table."""
    cut = chunks(docs, id_col, text_col)
    shared = shared_ids(cut, bits)
    ids = F.transform("chunks", lambda c: chunk_id(c, bits))
    if shared is None:
        return cut_lineage(cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), ids.alias("recipe")), "recipes")
    # each (doc_id, rid) has one text, so its chunks are ranked once
    each = cut.select("doc_id", "rid", F.posexplode("chunks").alias("pos", "chunk")).distinct().withColumn("id", chunk_id(F.col("chunk"), bits))
    ranks = (
        each.join(shared, ["id", "chunk"], "left")
        .groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "rank"))).alias("found"))
        .select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), F.transform("found", lambda x: F.concat_ws(":", x["id"], x["rank"])).alias("recipe"))
    )
    joined = cut.join(ranks, (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return cut_lineage(joined.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce("recipe", F.array().cast("array<string>")).alias("recipe")), "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of blanks became one space;
    null counts as empty. The smallest id of a group stays; nulls among ids come
    after all others. Of rows that repeat the id that stays, one is kept. An
    empty table gives an empty result. ``bits`` shortens the identifiers, which
    only tests of the verification want.
    """
    found = recipes(docs, id_col, text_col, bits)
    rows = found.groupBy("recipe", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep"), F.sum("copies").alias("size")).where("size > 1")
    joined = salted_join(rows, groups, ["recipe"], F.col("doc_id"), "left")
    each = joined.select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", "copies").alias("group_size"),
        "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
