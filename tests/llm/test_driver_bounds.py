"""What comes to the driver stays small."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataweave.llm import decontaminate, warc


@pytest.mark.parametrize(("ids", "limit"), [("id * 2", 10_000), ("id * 2", 100_000), ("id * id", 50_000), ("id % 3", 20_000), ("id * 2 - 9000000000000000000", 30_000)])
def test_borders_of_shards(spark, monkeypatch, ids, limit):
    rows = spark.range(400_000).select(F.expr(ids).alias("page_id"), (F.lit(90) + F.col("id") % 21).alias("bytes")).cache()
    brought, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: brought.append(collect(df)) or brought[-1])
    shards = warc.Shards(rows, limit)
    most = max(len(x) for x in brought)
    assert most <= max(warc.CELLS, warc.FINER * 2 * int(shards.parts.sum()) + 1)
    total = rows.agg(F.sum("bytes")).first()[0]
    assert total / limit <= shards.parts[1:].sum() + 1
    if ids != "id % 3":
        x, n = (np.array(c) for c in zip(*collect(rows.select("page_id", "bytes"))))
        assert np.bincount(np.searchsorted(shards.first, x, side="right"), n).max() <= limit
    rows.unpersist()


def test_a_block_of_items():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 4000) % 50_000) for _ in range(8 * (1 << 20) // 16_000)]
    items = pd.DataFrame({"item_id": [str(i) for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    queries = decontaminate.Queries(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 7 << 20 and len(queries.length) > 1_000_000
    assert peak < 400 << 20


def test_equal_runs_are_one():
    a = " ".join("abcdefghijklmno")
    items = pd.DataFrame({"item_id": ["x", "y", "z", None, "x", "e", "n"], "text": [a, a, "a b", "a b", "A B!", "", None]})
    queries = decontaminate.Queries(items, 13)
    assert sorted(queries.length.tolist()) == [2, 13, 13, 13]
    held = sorted(sorted(str(queries.names[i]) for i in queries.items_of(r)) for r in range(4))
    assert held == sorted([["x", "y"]] * 3 + [["None", "x", "z"]])
