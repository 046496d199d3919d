"""Results that are read several times, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode where that is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="weft-paths-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows with short columns that a join sends whole to every task.
FEW = 100_000


def paired(rows: DataFrame) -> DataFrame:
    """``rows`` (settled) as a side of a join with a larger table: sent to its tasks if they are few, else merged with it.

    Spark guesses sizes from compressed files, of which ten million ids take few MB, and would send such a table whole.
    """
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else merged(rows)


def merged(rows: DataFrame) -> DataFrame:
    """``rows``, of any number, as a side of a join that sends neither side whole."""
    return rows.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """As ``settled``, for tables of many rows: columns compressed, so they take a fraction of the place."""
    path = f"{shared_dir(df.sparkSession)}/weft/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage in the session's shared checkpoint folder (a temporary one only in local mode)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
