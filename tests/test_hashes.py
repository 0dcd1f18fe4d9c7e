"""Hashes of many messages at once are md5; hops by them keep the order of ``draw`` for any ids."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataweave.functions import hashes as H
from strataweave.operators import graph as G


@pytest.mark.parametrize("p, k, most", [(1, 1, 10), (3, 700, 10**5), (40, 33, 10**9), (9, 4096, 9000), (5, 300, 10**18), (2, 400, 10**6)])
def test_words_are_those_of_md5(p, k, most):
    r = random.Random(p)
    heads = [f"42|{r.randrange(most)}|{r.randrange(-5, most)}|".encode() for _ in range(p)]
    tails = [str(r.randrange(-3, most)).encode() for _ in range(k)]
    got = {int(i): [int(x) for x in row] for at, words in H.first_words(heads, tails) for i, row in zip(at, words)}
    assert got == {i: [int.from_bytes(hashlib.md5(h + t).digest()[:4], "big") for t in tails] for i, h in enumerate(heads)}


def test_no_tails():
    assert not list(H.first_words([b"a"], []))


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_hops_in_lots_and_parts_take_the_first_by_hash(spark, monkeypatch, kind):
    """A hub in several parts that meets its cases in several lots."""
    monkeypatch.setattr(G, "REACH", 300)
    monkeypatch.setattr(G, "LOT", 16)
    hub, cases, cap = 1000, 50, 4
    edges = spark.range(1, hub + 1).selectExpr("id AS row_id", f"cast(0 as {kind}) AS src", f"cast(id as {kind}) AS dst")
    seeds = spark.range(1, cases + 1).selectExpr("id AS case_id", f"explode(array(cast(0 as {kind}), cast(id as {kind}))) AS node")
    got = G.k_hop(seeds, edges, 1, cap).where("hop = 1").groupBy("case_id").agg(F.collect_list(F.col("node").cast("int")).alias("n")).collect()
    draw = lambda c: lambda y: hashlib.md5(f"42|{c}|0|{y}".encode()).hexdigest()
    assert {r["case_id"]: sorted(r["n"]) for r in got} == {c: sorted(sorted(set(range(1, hub + 1)) - {c}, key=draw(c))[:cap]) for c in range(1, cases + 1)}
