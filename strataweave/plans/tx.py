"""The given tables as a transaction graph with scorers, verdicts and annotators; the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.identifiers import edge_id, split_bounds, split_label

#: (member, seed, c): the scorer gives value / (value + c).
SCORERS = [("A", 42, 50.0), ("A", 123, 60.0), ("B", 42, 40.0), ("B", 123, 80.0), ("C", 42, 30.0), ("C", 123, 70.0)]
MODELS, RUNS = ("m1", "m2", "m3"), (0, 1)
#: Typologies in the order of their numbers.
TYPOLOGIES = ["fan-out", "fan-in", "cycle", "scatter-gather", "gather-scatter", "stack", "bipartite", "random"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nibble(*key: Column | str) -> Column:
    """A number from 0 to 15 from the first hex digit of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])), 1, 1), 16, 10).cast("int")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    label = F.when((F.col("event_type") == "error") & (F.col("value") >= 100), 1).otherwise(0)
    typed = F.when((label == 0) | (k % 5 == 0), F.lit(-1)).otherwise(k % 8).cast("int")
    bounds = split_bounds(events.count())
    return events.select(
        F.col("event_id").alias("row_id"), edge_id(F.col("event_id")).alias("edge_id"), "ts",
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("epoch_s"),
        F.col("user_id").alias("src"), k.alias("dst"), (F.col("user_id") % 7).alias("src_bank"), (k % 7).alias("dst_bank"),
        F.col("value").alias("amount"), F.col("event_type").alias("payment_format"), label.alias("label"), typed.alias("typology"),
        split_label(F.col("event_id"), bounds).alias("split"), (F.col("value") / (F.col("value") + 50)).alias("p"),
    )


def test_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).where("split = 'test'")


def scorers(df: DataFrame) -> DataFrame:
    """Long form: a row for each row of df, member and seed, with p."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.lit(s).alias("seed"), (F.col("amount") / (F.col("amount") + c)).alias("p")) for m, s, c in SCORERS]))
    return df.drop("p").withColumn("_s", each).select(*[c for c in df.columns if c != "p"], "_s.*")


def heads(df: DataFrame) -> DataFrame:
    """Long form of the raters' typologies: member, position and typ."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.lit(i).alias("position"), F.pmod(nibble("typ", m, F.col("row_id")), F.lit(8)).alias("typ")) for i, m in enumerate("ABC")]))
    return df.withColumn("_s", each).select("row_id", "label", "typology", "p", "_s.*")


def verdicts(df: DataFrame) -> DataFrame:
    """Long form of the external models: model, run, pred (1 for half of the rows) and pred_typology."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("run"), (nibble(m, r, F.col("row_id")) % 2).alias("pred"), F.when(nibble("cls", m, r, F.col("row_id")) < 8, nibble("cls", m, r, F.col("row_id"))).otherwise(F.col("typology")).alias("pred_typology")) for m in MODELS for r in RUNS]))
    return df.withColumn("_s", each).select(*df.columns, "_s.*")


# ---------------------------------------------------------------- the same in SQL


def sql_nibble(*key: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 1)) AS INTEGER)"


TX = """n AS (SELECT count(*) AS n FROM events),
tx AS (SELECT row_id, 'e_' || row_id AS edge_id, ts, epoch_s, src, dst, src % 7 AS src_bank, dst % 7 AS dst_bank, amount, payment_format, label,
  CASE WHEN label = 0 OR dst % 5 = 0 THEN -1 ELSE CAST(dst % 8 AS INTEGER) END AS typology,
  CASE WHEN row_id < floor(n * 0.6::DOUBLE) THEN 'train' WHEN row_id < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split, amount / (amount + 50) AS p
  FROM (SELECT event_id AS row_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, value AS amount, event_type AS payment_format,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END AS label FROM events) CROSS JOIN n),
t AS (SELECT * FROM tx WHERE split = 'test')"""
SCORED = f"s AS (SELECT t.* EXCLUDE (p), member, seed, amount / (amount + c) AS p FROM t CROSS JOIN (VALUES {', '.join(str(x) for x in SCORERS)}) v(member, seed, c))"
HEADS = f"h AS (SELECT row_id, label, typology, p, member, position, {sql_nibble(chr(39) + 'typ' + chr(39), 'member', 'row_id')} % 8 AS typ FROM t CROSS JOIN (VALUES ('A', 0), ('B', 1), ('C', 2)) v(member, position))"
VERDICTS = f"""v AS (SELECT t.*, model, run, {sql_nibble('model', 'run', 'row_id')} % 2 AS pred,
  CASE WHEN {sql_nibble("'cls'", 'model', 'run', 'row_id')} < 8 THEN {sql_nibble("'cls'", 'model', 'run', 'row_id')} ELSE typology END AS pred_typology
  FROM t CROSS JOIN (VALUES {', '.join(f"('{m}', {r})" for m in MODELS for r in RUNS)}) w(model, run))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles with the digits that do not depend on the order of addition."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
