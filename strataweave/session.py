"""A session with the settings that this library counts on."""

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set by the cluster's owner or left to Spark: masters, memory, shuffle partitions. AQE sizes the partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "strataweave", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, the warehouse in local mode, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: they are computed once, and the loss of an executor loses none."""
    path = f"{shared_folder(df.sparkSession)}/strataweave/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A Parquet sink looks at the size of its page and row group after so many rows; by default it holds a hundred first, however long.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def large_rows(spark: SparkSession) -> None:
    """Settings for results with texts of many MB a row; what the session's owner has set stays."""
    for key, value in LARGE_ROWS.items():
        if spark.conf.get(key, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(key) is None:
            spark.conf.set(key, value)
