"""Session helpers: shared scratch space, lineage cuts and table loading."""
from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only when a local session names none (tests) is one made here; on a cluster
    a folder of one machine would lose rows, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives the loss of executors (the files are not on executor disks) and
    stops a wide plan from being recomputed by each consumer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; the session works in UTC so cutoffs compare cleanly."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def with_one_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as literals (no join of any kind)."""
    row = single.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in single.schema.fields})


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (like ``--py-files``)."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    bundle = pathlib.Path(tempfile.mkdtemp(prefix="tidemark-zip-")) / "tidemark.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for source in root.rglob("*.py"):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._tidemark_shipped = True
