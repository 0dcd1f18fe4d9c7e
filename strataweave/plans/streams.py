"""Queries that run as streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataweave.plans.graphs import TRAIL
from strataweave.plans.tx import TX
from strataweave.session import shared_folder
from strataweave.streaming.features import run_available, trailing_stream

QUERIES, ORACLES = {}, {}


def stream_fan_degree(spark, sf):
    """The batch window features of senders, from a stream with state for each account."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = events.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("account"), F.get_json_object("props", "$.k").cast("bigint").alias("other"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("epoch_s"))
    folder = f"{shared_folder(spark)}/strataweave/stream-{uuid.uuid4().hex}"
    return run_available(trailing_stream(stream), f"{folder}/rows", f"{folder}/state")


QUERIES["stream_fan_degree"] = stream_fan_degree
ORACLES["stream_fan_degree"] = f"WITH {TX}, f AS (SELECT row_id, src AS account, {TRAIL.format(key='src', other='dst').replace('FROM t ', 'FROM tx ')}) SELECT row_id, account, degree, fan FROM f"
