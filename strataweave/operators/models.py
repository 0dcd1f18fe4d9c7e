"""Features for models, Spark ML detectors, walks and searches over sampling designs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.operators import metrics as M
from strataweave.operators import sampling as S
from strataweave.operators.graph import capped, neighbours
from strataweave.session import written


def normalised(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None, clip: float = 10.0) -> DataFrame:
    """(x - mean) / (sd_pop + 1e-8), clipped; statistics from all rows or from those that ``fit_on`` marks. One row of them is broadcast."""
    part = df if fit_on is None else df.where(fit_on)
    stats = part.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8))) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)


def detector(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42):
    """A boosted-trees model of Spark ML with its vector assembler."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(labelCol=label, featuresCol="_features", maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"), trees]).fit(train)


def typology_head(train: DataFrame, features: Sequence[str], label: str = "typology", trees: int = 20, seed: int = 42):
    """A forest over the typed illicit rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(labelCol=label, featuresCol="_features", numTrees=trees, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"), forest]).fit(train)


def tuned_detector(train: DataFrame, features: Sequence[str], grid: dict[str, Sequence], label: str = "label", seed: int = 42):
    """The best of a grid of depths and rounds by area under the PR curve on a split of the training rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    trees = GBTClassifier(labelCol=label, featuresCol="_features", seed=seed)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(trees.getParam(name), list(values))
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"), trees])
    return TrainValidationSplit(estimator=steps, estimatorParamMaps=build.build(), evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), trainRatio=0.75, seed=seed).fit(train).bestModel


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def wrapped(df: DataFrame, tau: float, head: str) -> DataFrame:
    """Supervised scores as predictions: a typology only where the detector fires."""
    fires = F.col("score") >= tau
    return df.withColumns({"illicit": fires, "pred_typology": F.when(fires, F.col(head))})


def random_walk(edges: DataFrame, starts: DataFrame, steps: int, teleport: float = 0.15, seed: int = 42) -> DataFrame:
    """(walker, step, node): walkers move to a neighbour by hash, or back to their start with the probability of teleport.

    All walkers move at once. Neighbours are numbered once, by hash; a walker draws a number and takes that neighbour in
    one join on (node, number), so a hub's neighbours never meet a walker. Each step is written before the next one.
    """
    near = neighbours(edges).withColumn("_draw", draw(seed, F.col("node"), F.col("other")))
    near = written(near.withColumn("_i", F.row_number().over(Window.partitionBy("node").orderBy("_draw", "other")) - 1).select("node", "other", "_i"), "neighbours")
    degree = written(near.groupBy("node").agg(F.count("*").alias("_n")), "degrees")
    here = written(starts.select("walker", "node", F.col("node").alias("start")).withColumn("step", F.lit(0)), "walk")
    out = [here]
    u = lambda s, what: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{what}|{s}"), F.col("walker").cast("string"))), 1, 12), 16, 10).cast("bigint"), F.lit(1 << 30))
    for s in range(1, steps + 1):
        drawn = here.join(degree, "node", "left").withColumn("_i", u(s, "move") % F.col("_n"))
        moved = drawn.join(near, ["node", "_i"], "left")
        there = F.when(u(s, "home") < int(teleport * (1 << 30)), F.col("start")).otherwise(F.coalesce("other", "start"))
        here = written(moved.select("walker", there.alias("node"), "start").withColumn("step", F.lit(s)), "walk")
        out.append(here)
    return reduce(DataFrame.unionByName, out).select("walker", "step", "node")


def bounded_cycles(edges: DataFrame, length: int = 4, seconds: int = 86_400) -> DataFrame:
    """(start, hops, n): time-increasing cycles of up to ``length`` edges within the window, by extension of open paths.

    Each extension joins on (account, time cell); paths that return to their start are counted and not extended.
    """
    cell = F.floor(F.col("epoch_s") / seconds)
    step = edges.where("src != dst").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("epoch_s").alias("t"), cell.alias("cell"))
    paths = step.select(F.col("at").alias("start"), F.col("to").alias("at"), F.col("t").alias("t0"), F.col("t").alias("t1"), F.array("at", "to").alias("seen"))
    found = None
    for hops in range(2, length + 1):
        reach = paths.withColumn("cell", F.explode(F.array(F.floor(F.col("t1") / seconds), F.floor(F.col("t1") / seconds) + 1)))
        nextp = reach.join(step, ["at", "cell"]).where(f"t > t1 and t - t0 <= {seconds}")
        closed = nextp.where("to = start").groupBy("start").agg(F.count("*").alias("n")).withColumn("hops", F.lit(hops))
        found = closed if found is None else found.unionByName(closed)
        paths = nextp.where(~F.array_contains("seen", F.col("to"))).select("start", F.col("to").alias("at"), "t0", F.col("t").alias("t1"), F.concat("seen", F.array("to")).alias("seen"))
    return found.select("start", "hops", "n")


def smallest_design(df: DataFrame, sizes: Sequence[int], seeds: Sequence[int], tau: float, tolerance: float = 0.05) -> DataFrame:
    """(size, seed, d_f1, feasible) of unweighted equal-size designs, every size and seed in one job; the smallest feasible size is then a minimum.

    A size takes a prefix of the seed's order, so each row is ranked once for each seed.
    """
    truth = M.prf(df.withColumn("pred", (F.col("p") >= tau).cast("int"))).select(F.col("f1").alias("truth"))
    each = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("_d", draw(F.col("seed"), F.col("row_id")))
    most = each.select("seed", "label").distinct().withColumn("take", F.lit(max(sizes)).cast("bigint"))
    near = S.first_ranked(each, ["seed", "label"], "_d", most)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("seed", "label").orderBy("_d"))).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("_r <= size")
    got = M.prf(near.withColumn("pred", (F.col("p") >= tau).cast("int")), ["size", "seed"])
    return got.crossJoin(F.broadcast(truth)).select("size", "seed", F.abs(F.col("f1") - F.col("truth")).alias("d_f1"), (F.abs(F.col("f1") - F.col("truth")) <= tolerance).alias("feasible"))  # one row


def demonstrations(train: DataFrame, edges: DataFrame, cap: int = 15) -> DataFrame:
    """One-hop neighbourhoods of demonstration rows, capped for each seed node."""
    ends = train.select(F.col("row_id").alias("case_id"), F.explode(F.array("src", "dst")).alias("node"))
    return capped(ends.join(neighbours(edges), "node"), ["case_id", "node"], draw(1, F.col("case_id"), F.col("other")), cap)
