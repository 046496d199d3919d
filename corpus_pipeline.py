"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the byte-level classifier rejects go.
2. exact: of equal texts the document with the smallest id stays.
3. near: of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays.
4. decontaminate: passages of benchmark items are cut out; a document that is nothing else goes.
5. pack: token ids of what is left, dealt over sequences.

Each stage works on everything that its predecessor kept. All but the last return the columns of documents.

Defined results: null text is empty and scored like any other; the exact stage keeps one of all empty texts, the near stage
links none of them, the last stage gives each one its end token. Null doc_ids sort last and aren't near copies of anything but
their own text. Texts are read whole, whatever their length. Of ties the smallest doc_id stays; a repeated row is its
document again and goes in the exact stage. Of an empty table every stage gives none, without labels or benchmark items the
quality and decontaminate stages keep everything. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from weftgraph.llm.storage import materialize


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs, k=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", _quality), ("exact", _exact), ("near", _near), ("decontaminate", _decontaminate), ("pack", _pack)]

#: The classifier and the tokenizer can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
