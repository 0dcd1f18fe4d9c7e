"""Weighted rendezvous hashing: each record goes to the shard that wins a draw fixed by its key and the shard alone.

A shard's draw is ``ln(u) / weight`` with ``u`` from md5(key, shard); the largest wins, so a shard gets records in
proportion to its weight, and adding one moves into it only the records it wins. No table of assignments exists
and no record looks at another, so placement is one projection. Only the slots (0, 1, 2 ... in each shard) need a
shuffle; they are counted by buckets, as one shard holds too many rows for one task.

Defined results: a null key counts as the key "" and a null text as empty; rows that repeat a key share its shard
and get slots of their own; equal rows may swap slots; equal draws (ties) go to the lowest shard; a very long text moves
as any other row and is never cut; an empty table gives an empty result. Columns that come with
the input stay, apart from those of the result's names, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import bucket_of, running

#: 13 hex digits fill the 52 bits of a double's fraction.
DIGITS = 13


def draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS), 16, 10).cast("double")
    return F.log((digits + 0.5) / float(16**DIGITS)) / F.lit(float(weight))


def winner(key: Column, weights: list[float]) -> Column:
    """The number of the shard that wins; of equal draws, the lowest number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(-i).alias("minus"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard(documents: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown: list[float] | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and, with the weights ``grown``, the shard under those."""
    body, name = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), F.coalesce(F.col(key).cast("string"), F.lit(""))
    rest = [c for c in documents.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_bucket")]
    placed = documents.select(
        *rest,
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        winner(name, weights).alias("shard"),
        (winner(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("_bucket", bucket_of(F.col(key), F.col("text_crc32")))
    return running(placed, ["shard"], "_bucket", [key, "text_crc32", "size"], F.lit(1), "slot").withColumn("slot", F.col("slot").cast("long")).drop("_bucket")
