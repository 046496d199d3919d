"""Shared-folder tables that cut lineage, and joins that stay level under hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    found = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long rows: let the session send at most ``rows`` of them to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    modest_batches(spark)
    path = f"{shared_dir(spark)}/weft/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.weft_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, parts: int = 512, salts: int = 64) -> DataFrame:
    """Join ``rows`` to ``groups`` (one row for each ``key``, ``size`` rows of ``rows`` each) without a hot task.

    Groups that hold more than ``total / parts`` rows are fewer than ``parts``: their keys are broadcast, their rows get
    one of ``salts`` numbers by a hash of all columns, and the group's row comes once for each number.
    """
    keys, limit = [key] if isinstance(key, str) else key, max(1000, total // parts)
    hot, salt = (free_name([*rows.columns, *groups.columns], x) for x in ("hot", "salt"))
    large = F.broadcast(groups.filter(F.col(size) > limit).select(*keys, F.lit(True).alias(hot)))
    dealt = F.when(F.col(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    numbers = F.when(F.col(size) > limit, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    marked = rows.join(large, keys, "left").withColumn(salt, dealt).drop(hot)
    return marked.join(groups.withColumn(salt, F.explode(numbers)), [*keys, salt]).drop(salt)


def free_name(taken: list[str], stem: str) -> str:
    """A column name that none of ``taken`` equals, whatever its case."""
    used, name = {x.lower() for x in taken}, stem
    while name.lower() in used:
        name += "_"
    return name
