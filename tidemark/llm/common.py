"""Small helpers that several of the operators share."""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

#: The six characters that count as white space in lines and words.
BLANKS = " \t\n\x0b\f\r"


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``rid`` and the rest of the row as ``row``.

    The row travels as one struct (``columns``: all but the text; ``no_text``:
    it was null), so no column of the caller can clash with those that an
    operator adds. ``rid`` tells apart rows that share an id but not a text;
    rows that agree in both have one ``rid`` and one fate.
    """
    text = F.coalesce(name(text_col), F.lit(""))
    columns = F.struct(*[name(c) for c in docs.columns if c != text_col])
    row = F.struct(columns.alias("columns"), name(text_col).isNull().alias("no_text"))
    return docs.select(name(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(name(id_col), text).alias("rid"), row.alias("row"))


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """:func:`packed` without the row."""
    text = F.coalesce(name(text_col), F.lit(""))
    return docs.select(name(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(name(id_col), text).alias("rid"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, rid) that also pairs null ids."""
    return (left["rid"] == right["rid"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def restored(columns: list[str], text_col: str, text: Column) -> list[Column]:
    """The caller's columns out of ``row``, with a new text (a null stays null) and its length in ``n_chars``, if there is one."""
    text = F.when(~F.col("row.no_text"), text)
    out = []
    for c in columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c))
        else:
            out.append(F.col("row.columns").getField(c).alias(c))
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def training_fold(doc_id: Column) -> Column:
    """True where crc32 of the id as text is no multiple of five (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


#: Copies of the small side of a salted join; a hot key is dealt to so many tasks before Spark splits any further.
SALTS = 8


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """Join where a key may be hot in ``many`` and is unique in ``few``: rows of a key are dealt by a hash of ``by``."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copied = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


#: Spark's own switch for removing the shuffle files of a query once it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage``, after which the shuffle files that made the table are gone."""
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, None)
    conf.set(SWEEP, "true")
    try:
        return cut_lineage(df, name)
    finally:
        conf.unset(SWEEP) if before is None else conf.set(SWEEP, before)


#: Rows of an Arrow batch at most, for rows that carry whole texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Keep Arrow batches at ``BATCH_ROWS`` rows, unless the session asks for fewer: JVM and Python hold one batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    if not 0 < rows <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))


def schema(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The types of some columns of ``df``, followed by those of the DDL text ``more``."""
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(more).fields])
