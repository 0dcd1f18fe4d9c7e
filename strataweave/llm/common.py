"""What several operators share: the shared folder, prefix sums that survive hot groups, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the md5 that split a group: 4096 buckets for each group.
BUCKET_DIGITS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of its own in local mode, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder. Lineage ends there, and the loss of an executor loses none."""
    path = f"{shared_folder(df.sparkSession)}/strataweave/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that a Python worker holds little text at a time; lower ones stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int((spark.conf.get(key, None) or "0").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for the actions inside; afterwards the session's settings are as before."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k, None) for k in keys]
    small_batches(spark)
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def fitting(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which rows of a sample to keep, in order: those that still fit into the budget, none of them over a sixteenth of it unless it is the only one."""
    keep, used = np.zeros(len(sizes), bool), 0
    for i, size in enumerate(sizes.tolist()):
        if size <= budget // 16 and used + size <= budget:
            keep[i], used = True, used + size
    if len(sizes) and not keep.any():
        keep[int(np.argmin(sizes))] = True
    return keep


def bucket_of(*columns: Column) -> Column:
    """A bucket that spreads the rows of any group, from a stable hash of the columns."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, BUCKET_DIGITS)


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str, extra: DataFrame | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group, ordered by bucket and then ``order``.

    A group can hold any share of the rows: only one bucket of it meets in a task, and the sums of the
    buckets are added up over the small table of buckets. ``extra`` joins that small table on ``group``.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    if extra is not None:
        sums = sums.join(extra, group)
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, bucket]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


# ---------------------------------------------------------------- words of UTF-8 text as 64-bit hashes

_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def byte_class(rule) -> np.ndarray:
    return np.array([rule(b) for b in range(256)], dtype=bool)


#: A word is a run of bytes other than space and 09 to 0D; or of digits, ASCII letters and bytes beyond ASCII.
SPACED = byte_class(lambda b: b != 0x20 and not 9 <= b <= 13)
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


def _tables(n: int):
    """Lower-casing of ASCII, a random number for each byte, and the powers of _STEP with their inverses modulo 2**64."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(n, f, dtype=np.uint64)) for f in (_STEP, pow(_STEP, -1, 1 << 64)))
        noise = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))
    return noise[lower], up, down


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, one text behind the other, and where each begins (with the end); null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def sliced(batch, column: int, limit: int = 2 << 20):
    """The batch in runs of rows with about ``limit`` bytes of text, or one row, so that working memory stays small."""
    _, at = utf8_column(batch.column(column))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        yield batch.slice(a, z - a)
        a = z


def fixed_width(column, width: int) -> np.ndarray:
    """An Arrow binary column of values of one width as a matrix of bytes, without a copy."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if n else np.zeros(0, np.uint8)
    return data.reshape(-1, width)


def hash_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word (A-Z only) of all texts in order, and the number of words of each text.

    Works in pieces that end between words, so memory stays a small multiple of the text however long it is.
    """
    n, found, owners, a = len(data), [], [np.zeros(0, np.int64)], 0
    size = min(n, PIECE)
    noise, up, down = _tables(size)
    is_start = np.zeros(n + 1, dtype=bool)
    is_start[at] = True
    while a < n:
        z = min(n, a + PIECE)
        while z < n and kind[data[z - 1]] and kind[data[z]] and not is_start[z]:
            more = np.flatnonzero(~kind[data[z : z + PIECE]] | is_start[z : min(n, z + PIECE)])
            z = z + int(more[0]) if len(more) else min(n, z + PIECE)
        if size < z - a:  # a word longer than the piece
            size = 2 * (z - a)
            noise, up, down = _tables(size)
        b, cut = data[a:z], is_start[a : z + 1]
        w = kind[b]
        first = w & (cut[:-1] | np.concatenate(([True], ~w[:-1])))
        last = w & (cut[1:] | np.concatenate((~w[1:], [True])))
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(noise[b] * up[: z - a])))
            found.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_ODD)))
        owners.append(np.searchsorted(at, s + a, side="right") - 1)
        a = z
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.bincount(np.concatenate(owners), minlength=len(at) - 1).astype(np.int64)


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; fewer words count as one run, none give none."""
    out, ends = [], np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        all_runs = np.zeros(n, np.uint64)
        for j in range(size):
            all_runs = all_runs * np.uint64(_STEP) + words[j : j + n]
        all_runs = mix(all_runs)
        for c, e in zip(counts.tolist(), ends.tolist()):
            if c >= size:
                out.append(np.unique(all_runs[e - c : e - size + 1]))
            elif c:
                whole = np.uint64(c)
                for x in words[e - c : e]:
                    whole = whole * np.uint64(_STEP) + x
                out.append(mix(np.array([whole + np.uint64(_ODD)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
