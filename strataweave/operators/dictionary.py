"""Dense numbers for values of any ordered type, strings included, and edges written with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.session import written


def dictionary(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(column, idx): the distinct values and their places in ascending order, from 0; null has no place.

    Values are cut into ranges and written with the number of their range. Only the counts of the ranges meet in one
    task; each range is numbered by itself. Strings go by their UTF-8 bytes. The written ranges make reruns of a lost
    task see the same cuts.
    """
    parts = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    cut = written(values.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return cut.join(F.broadcast(before), "_part").select(column, (F.col("_before") + inside).cast("bigint").alias("idx"))  # a row for each range


def with_node_ids(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """The edges with src_idx and dst_idx, and the dictionary (node, idx) of both ends. An end that is null has a null number."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("_node"))
    nodes = written(dictionary(ends, "_node").withColumnRenamed("_node", "node"), "nodes")
    out = edges
    for side in (src, dst):
        named = nodes.select(F.col("node").alias("_node"), F.col("idx").alias(f"{side}_idx"))
        out = out.join(named, out[side] == named["_node"], "left").drop("_node")
    return out, nodes
