"""The pipeline's stages on a small table with planted rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registered(spark):
    import __spark_entry__ as registry

    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontamination", "mixing", "sharding"]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("clash"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    extra = [(1001, item, "en", None, 1, "x"), (1002, None, None, "src1", 0, "x"), (1003, "", "en", "src1", 0, "x"), (None, "some words of a row without number", "en", "src2", 1, "x")]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema)).union(docs.where("doc_id = 5"))


def test_stages(spark, rows):
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, rows, SF)
    assert good.columns == rows.columns and 0 < good.count() < rows.count()
    single = stage["jaccard"](spark, rows, SF)
    ids = [r["doc_id"] for r in single.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and {1001, 1002, 1003} <= set(ids) and single.columns == rows.columns
    clean = stage["decontamination"](spark, single, SF)
    left = {r["doc_id"] for r in clean.collect()}
    assert 1001 not in left and {None, 1002, 1003} <= left and clean.columns == rows.columns
    mixed = stage["mixing"](spark, clean, SF)
    assert mixed.columns == rows.columns and 0 < mixed.count()
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3
    # On rows that share a doc_id or have none, each row still counts as one.
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    again = stage["mixing"](spark, rows, SF)
    words = [df.agg(F.sum(size)).first()[0] for df in (rows, again)]
    assert again.columns == rows.columns and abs(words[1] - words[0]) < 0.1 * words[0] and again.groupBy("doc_id").count().where("count > 3").count() <= 1
    placed = stage["sharding"](spark, mixed, SF)
    assert placed.count() == mixed.count() and dict(placed.dtypes)["shard"] == "int" and placed.select("shard").distinct().count() <= 24


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("slot is not null and shard between 0 and 23").count() > 0


def test_equal_rows_are_mixed_each_by_itself(spark):
    """Each source's words come within one document of its target, though its rows are equal and have no number."""
    from strataweave.llm import mixing

    text = " ".join("abcdefghij")
    some = [(None, text, "en", "a", 19, "x")] * 50 + [(7, text + " k", "en", "b", 21, "x")] * 40 + [(i, "w " * (i % 9), "en", "c", 1, "x") for i in range(30)]
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(4)
    from strataweave.llm.common import written

    docs = written(docs, "equal-rows")
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    got = {r[0]: r[1] for r in corpus_pipeline.mixing_stage(spark, docs, SF).groupBy("source").agg(F.sum(size)).collect()}
    want = {r[0]: r[1] for r in mixing.mix(docs).groupBy("source").agg(F.max("target")).collect()}
    assert want.keys() == got.keys() and all(abs(got[s] - want[s]) <= 11 for s in want), (got, want)
