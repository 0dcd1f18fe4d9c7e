"""Trailing-window features of accounts over an unbounded stream of transactions.

State is kept for each account: the times and partners of its transactions within the window, no more, so it is bounded
by the busiest window of one account. No row is dropped: a late row is answered from what the window still holds.
Batch and stream give equal rows where an account's transactions arrive in order of time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT = "row_id long, account long, degree long, fan long"
STATE = "times array<long>, others array<long>"


def answers(times: np.ndarray, others: np.ndarray, asked: np.ndarray, seconds: int) -> tuple[np.ndarray, np.ndarray]:
    """(degree, fan) of the window that ends at each time of ``asked``, which ascend, over rows sorted by time: one pass with two pointers."""
    lo, hi = np.searchsorted(times, asked - seconds), np.searchsorted(times, asked, side="right")
    held, fan, a, z = Counter(), np.zeros(len(asked), np.int64), 0, 0
    for i in range(len(asked)):
        while z < hi[i]:
            held[others[z]] += 1
            z += 1
        while a < lo[i]:
            held[others[a]] -= 1
            if not held[others[a]]:
                del held[others[a]]
            a += 1
        fan[i] = len(held)
    return hi - lo, fan


def _updater(seconds: int):
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, others = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))
        rows = [b[["row_id", "epoch_s", "other"]].to_numpy(np.int64) for b in batches]
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
        times, others = np.concatenate((times, rows[:, 1])), np.concatenate((others, rows[:, 2]))
        order = np.argsort(times, kind="stable")
        times, others = times[order], others[order]
        moments, of = np.unique(rows[:, 1], return_inverse=True)  # rows of one moment see each other, as in a range frame
        degree, fan = answers(times, others, moments, seconds)
        kept = times >= times[-1] - seconds
        state.update((times[kept].tolist(), others[kept].tolist()))
        yield pd.DataFrame({"row_id": rows[:, 0], "account": key[0], "degree": degree[of], "fan": fan[of]})

    return update


def trailing_stream(stream: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(row_id, account, degree, fan) from a stream of (row_id, account, other, epoch_s)."""
    return stream.groupBy("account").applyInPandasWithState(_updater(seconds), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now, into a Parquet table that is then read."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
