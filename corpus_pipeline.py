"""A corpus pipeline: filter by quality, keep one of each group of near copies, drop contaminated documents, mix, shard.

Each stage takes all rows that its predecessor kept, is written as Parquet to the folder that all executors share and
read again by the next one, so the loss of an executor costs one stage at most. All but the last return the columns
of documents.

Defined results: columns beyond those of documents pass through the stages that don't make a column of that name;
rows without doc_id are judged by their own text and never count as copies; rows that repeat a doc_id count as copies
of each other; null and empty texts pass the filters if the classifier keeps them and are never taken by the mix, as
they have no words; very long texts are judged whole; ties between copies go to the smallest doc_id; empty tables give
an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import decontaminate, jaccard, mixing, quality, sharding
from strataweave.llm.common import shared_folder, table, written

SHARDS = 24


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids`` (a written table).

    A bit filter of fixed size tells most of them by their id alone; only the rest, a few more than ``ids``, move their
    texts for the exact join.
    """
    filled = jaccard.bit_filter(ids.select(F.col("doc_id").alias("id")))

    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((filled[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) != 0)

    marked = docs.withColumn("_maybe", maybe(jaccard.place_of("doc_id")))
    sure = marked.where(~F.col("_maybe") | F.col("doc_id").isNull())
    doubtful = marked.where(F.col("_maybe") & F.col("doc_id").isNotNull()).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return sure.select(*docs.columns).union(doubtful.select(*docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=True).where("predicted = 1").select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, and all that have no words."""
    classes = written(jaccard.join(docs), "pipeline-classes")
    kept = without(docs, classes.where("component_id != doc_id"))
    repeated = written(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*kept.columns)
    return without(kept, repeated).union(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5% stand in phrases of a benchmark item; rows without doc_id get a number of their own meanwhile."""
    own = written(docs.where("doc_id is null").withColumn("doc_id", F.monotonically_increasing_id()), "pipeline-unnumbered")
    benchmark, kept = table(spark, sf_dir, "benchmark"), []
    for part in (docs.where("doc_id is not null"), own):
        judged = written(decontaminate.judge(part, benchmark), "pipeline-judged")
        kept.append(without(part, judged.where("contaminated")))
    return kept[0].select(*docs.columns).union(kept[1].withColumn("doc_id", F.lit(None).cast("long")).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies: the last one of a source if at least half of it is taken.

    A source's documents come in the order of their draws, so the copies of each follow from its source's whole epochs and
    the last draw that the epoch begun takes in: a row for each source, and no text moves.
    """
    # Equal rows share a draw; their places in the table, which its files fix, tell them apart.
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    ordered = {"_draw": F.concat(mixing.draw("mix", F.col("doc_id"), F.col("text")), F.lpad(F.hex("_place"), 16, "0")), "_key": mixing.source_key()}
    rows = placed.select("doc_id", "source", "text", "_place").withColumns(ordered).drop("_place")
    mixed = mixing.mix(rows, keep=("_draw", "_key"), order=F.col("_draw"))
    whole = F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))
    part = F.col("taken") - F.col("size") * whole
    begun = F.when((F.col("size") > 0) & (2 * part >= F.col("size")), F.col("_draw"))
    sources = written(mixed.groupBy("_key").agg(F.max(whole).cast("int").alias("_whole"), F.max(begun).alias("_last")), "pipeline-sources")
    drawn = placed.withColumns({**ordered, "_size": mixing.words(F.col("text"))}).join(sources, "_key")
    copies = F.when(F.col("_size") > 0, F.col("_whole") + F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False)).cast("int")).otherwise(0)
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.shard(docs, [1.0] * SHARDS)


STAGES = [("quality", quality_stage), ("jaccard", jaccard_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: SQL cannot express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/strataweave/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
