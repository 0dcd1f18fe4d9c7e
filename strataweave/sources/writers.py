"""Sinks: fixed columns, guarded and verified writes, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str], force: bool = False) -> None:
    """The named columns in that order, others left out; an existing target is an error unless forced."""
    df.select(*columns).write.mode("overwrite" if force else "errorifexists").csv(path, header=True)


def write_ragged(parts: Sequence[DataFrame], path: str, force: bool = False) -> None:
    """Rows with different columns under the union of all columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_csv(out, path, out.columns, force)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").option("compression", "gzip" if gzip else "none").json(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 100_000, by: Sequence[str] = (), level: int = 12, force: bool = False) -> None:
    """zstd Parquet in files of bounded length, laid out by the columns that readers prune on."""
    writer = df.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): equal for equal multisets of rows; a sum of hashes, so each task sends one row."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).cast("decimal(38,0)")).alias("digest"))


def write_verified(df: DataFrame, path: str, force: bool = False, **options) -> None:
    """Writes aside, reads again and compares; only a table without a difference is renamed to ``path``, and the former one, renamed itself, goes after that."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs
    target = files.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and not force:
        raise ValueError(f"{path} exists")
    expected = row_digest(df).first()
    write_parquet(df, aside, **options)
    found = row_digest(spark.read.schema(df.schema).parquet(aside)).first()
    if found != expected:
        raise ValueError(f"{aside}: wrote {expected}, read back {found}")
    former = files.Path(f"{aside}-former")
    if system.exists(target) and not system.rename(target, former):
        raise ValueError(f"{path} could not be renamed")
    if not system.rename(files.Path(aside), target):
        system.rename(former, target)
        raise ValueError(f"{aside} could not be renamed to {path}")
    system.delete(former, True)


def write_cases(cases: DataFrame, path: str, force: bool = False) -> None:
    """Cases as lines of JSON, the table that joins them to their rows, and a record of what was written: folders cases, rows and metadata."""
    write_jsonl(cases, f"{path}/cases", force=force)
    write_csv(cases, f"{path}/rows", ["case_id", "row_id"], force)
    about = cases.agg(F.count("*").alias("cases"), F.countDistinct("case_id").alias("names"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    write_jsonl(about, f"{path}/metadata", force=force)


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def rewritten(old: DataFrame, changes: DataFrame, key: Sequence[str], column: str) -> tuple[DataFrame, DataFrame]:
    """The table with ``column`` replaced where ``changes`` has a value, and a report of how many rows changed from what to what."""
    joined = old.join(changes.select(*key, F.col(column).alias("_new")), list(key), "left")
    value = F.coalesce("_new", column)
    report = joined.where(~value.eqNullSafe(F.col(column))).groupBy(F.col(column).alias("old"), F.col("_new").alias("new")).count()
    return joined.withColumn(column, value).drop("_new"), report
