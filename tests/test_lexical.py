"""Patterns of traces: the same hits as the plain patterns, and lines that cost their length."""

import random
import re
import time

from pyspark.sql import functions as F

from strataweave.functions import parsing as P


def test_patterns_hit_what_they_say(spark):
    words = "acct acct_7 acct-x hub central hubs out_degree indegree degree degrees 12 3 edges accounts nodes volume total sum sums temporal timestamp time-bucket timebucket biweekly daily identical same amount amounts repeated threshold just below cycle cycles return returns origin loops back and forth layer layering multi-hop multitier rapid quick fast burst transfer transfers movement multiple many manyfold several counterpart counterparties émany".split()
    rng = random.Random(7)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", "\n", "\r", "", "\u2028"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    low = F.col("t")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", P.features_in(low).alias("f"), P.markers_in(low).alias("m"))
    hits = lambda patterns, t: sum(bool(re.search(p, t)) for p in patterns)
    assert {r["i"]: (r["f"], r["m"]) for r in df.collect()} == {i: (hits(P.PARSE, t), hits(P.MARKERS, t)) for i, t in enumerate(texts)}


def test_long_lines_cost_their_length(spark):
    """200,000 first words of a pair in one line and no second one behind them."""
    n = 200_000
    texts = ["sum " * n, "amount " + "repeated " * n, "origin " + "return " * n, "transfer " + "rapid " * n, "counterpart " + "many " * n]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    began = time.time()
    got = df.select(P.features_in(F.col("t")).alias("f"), P.markers_in(F.col("t")).alias("m")).agg(F.sum("f"), F.sum("m")).first()
    assert time.time() - began < 30
    assert tuple(got) == (0, 0)
