import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables: good and bad documents, copies, near copies, passages of an item."""
    r = random.Random(8)
    word = lambda alphabet: "".join(r.choices(alphabet, k=r.randint(2, 7)))
    good = lambda n: [word("abcdefghijklm") for _ in range(n)]
    bad = lambda n: [word("ABCDEFGHIJKLM") + "!!" for _ in range(n)]
    rows = {i: good(120) for i in range(150)} | {i: bad(120) for i in range(150, 200)}
    rows[20] = rows[3]
    rows[21] = [*rows[5][:-1], "changed"]
    item = good(40)
    rows[30] = [*rows[30], *item[5:30]]
    place = tmp_path_factory.mktemp("tables")
    texts = {i: " ".join(w) for i, w in rows.items()} | {300: None, 301: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows, item


def test_stages(spark, tables):
    place, rows, item = tables
    docs, seen = spark.read.parquet(f"{place}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, place).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(set(seen["quality"]) & set(range(150, 200))) <= 2
    assert set(range(150)) <= set(seen["quality"])
    assert set(seen["quality"]) - set(seen["exact"]) - {300, 301} == {20}
    assert set(seen["exact"]) - set(seen["near"]) == {21}
    assert set(seen["near"]) == set(seen["decontaminate"])
    assert {i for i, t in seen["near"].items() if seen["decontaminate"][i] != t} == {30}
    assert " ".join(rows[30][:120]) == seen["decontaminate"][30].rstrip()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, place).collect()
    assert {r["doc_id"] for r in last} == set(seen["decontaminate"])
    whole = corpus_pipeline.run(spark, place).collect()
    key = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert key(whole) == key(last)


CLASHES = "id quality gone row h sha _spans key _h asked s doc node root label score _score n sig fp keep_id text_sha256 kept".split()


def test_stages_with_clashing_columns(spark, tables):
    """Every stage keeps columns that are named like its own, and the rows that it keeps without them."""
    place, _, _ = tables
    plain = spark.read.parquet(f"{place}/documents.parquet")
    marked = plain.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHES))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, marked, place)
        assert out.columns == marked.columns
        rows = out.collect()
        assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in stage(spark, plain, place).collect()}
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, marked, place).count() > 0


def test_stages_of_nothing(spark, tables):
    place, _, _ = tables
    none = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, place).count() == 0


def test_every_query_is_there():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
