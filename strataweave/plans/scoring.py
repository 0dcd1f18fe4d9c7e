"""Queries: splits, ensembles, thresholds, detection and multi-class metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import case_id, case_number, match_key, node_id, numbered
from strataweave.functions.ratios import ratio0, ratio_null
from strataweave.operators import metrics as M
from strataweave.operators.ordered import quantiles
from strataweave.plans.tx import HEADS, MODELS, SCORED, TX, TYPOLOGIES, VERDICTS, heads, read, rounded, scorers, sql_nibble, test_part, tx, verdicts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def grid_sql(grid) -> str:
    return "(VALUES " + ", ".join(f"({float(g)!r}::DOUBLE)" for g in grid) + ") g(threshold)"


RATES = """coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy"""


def confusion_sql(source: str, by: str = "", weight: str = "1", pred: str = "pred", kind: str = "BIGINT") -> str:
    """tp, fp, fn, tn and rates, by the columns named."""
    cells = ", ".join(f"CAST(coalesce(sum({weight}) FILTER (label = {y} AND {pred} = {p}), 0) AS {kind}) AS {n}" for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT *, {RATES} FROM (SELECT {by + ',' if by else ''} {cells} FROM {source}{group})"


@query(f"WITH {TX} SELECT split, label, count(*) AS n FROM tx GROUP BY ALL")
def split_stats(spark, sf):
    return tx(spark, sf).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM tx UNION SELECT dst FROM tx)")
def node_dictionary(spark, sf):
    t = tx(spark, sf)
    return numbered(t.select(F.col("src").alias("node")).union(t.select("dst")).distinct(), "node")


@query(f"WITH {TX}, d AS (SELECT payment_format, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM tx GROUP BY payment_format) SELECT code, payment_format, count(*) AS n FROM tx JOIN d USING (payment_format) GROUP BY ALL")
def dictionary_first_seen(spark, sf):
    """Codes in the order of first appearance."""
    t = tx(spark, sf)
    first = t.groupBy("payment_format").agg(F.min("row_id").alias("first"))  # a row for each distinct value
    codes = first.select("payment_format", (F.row_number().over(Window.orderBy("first")) - 1).cast("bigint").alias("code"))
    return t.join(codes, "payment_format").groupBy("code", "payment_format").agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT row_id, src_bank || '_' || src AS source, dst_bank || '_' || dst AS target, ts || ',' || src_bank || ',' || src AS key FROM (SELECT * REPLACE (strftime(ts, '%Y/%m/%d %H:%M') AS ts) FROM tx)")
def node_and_match_keys(spark, sf):
    t = tx(spark, sf)
    return t.select("row_id", node_id(F.col("src_bank"), F.col("src")).alias("source"), node_id(F.col("dst_bank"), F.col("dst")).alias("target"), match_key(F.date_format("ts", "yyyy/MM/dd HH:mm"), F.col("src_bank"), F.col("src")).alias("key"))


LINES = """l AS (SELECT row_id, row_id // 1000 AS file, CASE WHEN row_id % 10 = 0 THEN 'BEGIN LAUNDERING ATTEMPT - ' || upper(['fan-out','cycle','stack'][row_id // 10 % 3 + 1]) || ': note' WHEN row_id % 10 = 9 THEN 'END LAUNDERING ATTEMPT'
  ELSE epoch_s // 60 || ',' || src || ',' || dst || ',' || payment_format || ',' || CAST(floor(amount) AS BIGINT) END AS line FROM tx)"""


@query(f"""WITH {TX}, {LINES}, c AS (SELECT *, CASE WHEN line LIKE 'BEGIN%' THEN lower(regexp_extract(line, ' - ([^:]*)', 1)) WHEN line LIKE 'END%' THEN '' END AS head FROM l),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_id) AS typology FROM c)
SELECT line AS key, max_by(typology, row_id) AS typology FROM f WHERE head IS NULL AND typology <> '' GROUP BY line""")
def pattern_carry_forward(spark, sf):
    from strataweave.sources.readers import pattern_labels

    t = tx(spark, sf)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("FAN-OUT", "CYCLE", "STACK")]), (F.floor(F.col("row_id") / 10) % 3 + 1).cast("int"))
    record = F.concat_ws(",", F.floor(F.col("epoch_s") / 60).cast("string"), F.col("src").cast("string"), F.col("dst").cast("string"), "payment_format", F.expr("cast(floor(amount) as bigint)").cast("string"))
    line = F.when(F.col("row_id") % 10 == 0, F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), kind, F.lit(": note"))).when(F.col("row_id") % 10 == 9, "END LAUNDERING ATTEMPT").otherwise(record)
    return pattern_labels(t.select(F.floor(F.col("row_id") / 1000).alias("file"), F.col("row_id").alias("line_no"), line.alias("line")))


@query(f"WITH {TX}, pat AS (SELECT src, dst, min(typology) AS typ FROM tx WHERE typology >= 0 GROUP BY ALL) SELECT row_id, label, CASE WHEN label = 1 THEN coalesce(typ, -1) ELSE -1 END AS attached FROM tx LEFT JOIN pat USING (src, dst)")
def typology_left_join(spark, sf):
    """Labels attach by key from a unique right side; only illicit rows keep them."""
    t = tx(spark, sf)
    patterns = t.where("typology >= 0").groupBy("src", "dst").agg(F.min("typology").alias("typ"))
    return t.join(patterns, ["src", "dst"], "left").select("row_id", "label", F.when(F.col("label") == 1, F.coalesce("typ", F.lit(-1))).otherwise(-1).alias("attached"))


@query(f"WITH {TX}, {SCORED} SELECT row_id, round(avg(p), 6) AS p FROM s GROUP BY row_id")
def ensemble_soft_avg(spark, sf):
    return rounded(scorers(test_part(spark, sf)).groupBy("row_id").agg(F.avg("p").alias("p")))


WEIGHTED = f"{TX}, {SCORED}, o AS (SELECT member, seed, coalesce(2.0 * sum(CASE WHEN label = 1 AND p >= 0.5 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + sum(label), 0), 0) AS w FROM s GROUP BY ALL)"


@query(f"WITH {WEIGHTED} SELECT row_id, round(sum(p * w) / sum(w), 6) AS p FROM s JOIN o USING (member, seed) GROUP BY row_id")
def ensemble_weighted_avg(spark, sf):
    s = scorers(test_part(spark, sf)).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    worth = M.prf(s, ["member", "seed"]).select("member", "seed", F.col("f1").alias("w"))  # a row for each scorer
    return rounded(s.join(worth, ["member", "seed"]).groupBy("row_id").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p")))


@query(f"WITH {TX}, {SCORED} SELECT member, seed, count(*) AS n, count(DISTINCT row_id) AS n_rows, count(*) FILTER (p < 0 OR p > 1 OR isnan(p)) AS out_of_range FROM s GROUP BY ALL")
def strict_probability_scan(spark, sf):
    """What a strict read of scorers rejects: missing, duplicate or impossible probabilities."""
    s = scorers(test_part(spark, sf))
    return s.groupBy("member", "seed").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"), F.count_if((F.col("p") < 0) | (F.col("p") > 1) | F.isnan("p")).alias("out_of_range"))


VOTES = f"{TX}, {SCORED}, m AS (SELECT row_id, label, member, avg(p) AS p FROM s GROUP BY ALL), b AS (SELECT row_id, label, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS votes, count(*) AS members FROM m GROUP BY ALL)"


@query(f"WITH {VOTES} SELECT row_id, CASE WHEN votes >= (members + 1) // 2 THEN 1 ELSE 0 END AS pred FROM b")
def hard_vote(spark, sf):
    b = _votes(spark, sf)
    return b.select("row_id", (F.col("votes") >= F.floor((F.col("members") + 1) / 2)).cast("int").alias("pred"))


@query(f"WITH {VOTES} SELECT row_id, CASE WHEN votes >= 2 THEN 1 ELSE 0 END AS pred FROM b")
def both_agree(spark, sf):
    return _votes(spark, sf).select("row_id", (F.col("votes") >= 2).cast("int").alias("pred"))


def _votes(spark, sf):
    m = scorers(test_part(spark, sf)).groupBy("row_id", "label", "member").agg(F.avg("p").alias("p"))
    return m.groupBy("row_id", "label").agg(F.sum((F.col("p") >= 0.5).cast("int")).alias("votes"), F.count("*").alias("members"))


@query(f"WITH {TX}, {HEADS}, c AS (SELECT row_id, typ, count(*) AS n FROM h GROUP BY ALL) SELECT row_id, typ FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, typ) = 1")
def mode_lowest(spark, sf):
    return heads(test_part(spark, sf)).groupBy("row_id").agg(F.mode("typ", True).alias("typ"))


@query(f"WITH {TX}, {HEADS}, c AS (SELECT row_id, typ, count(*) AS n, min(position) AS pos FROM h GROUP BY ALL) SELECT row_id, typ FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pos) = 1")
def mode_first_rater(spark, sf):
    c = heads(test_part(spark, sf)).groupBy("row_id", "typ").agg(F.count("*").alias("n"), F.min("position").alias("pos"))
    return c.groupBy("row_id").agg(F.max_by("typ", F.struct("n", -F.col("pos"))).alias("typ"))


def _sweep_sql(grid) -> str:
    return f"WITH {TX}, x AS (SELECT threshold, label, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pred FROM t CROSS JOIN {grid_sql(grid)}) " + confusion_sql("x", "threshold")


@query(_sweep_sql(M.CONSTRUCTION_GRID))
def threshold_sweep_construction(spark, sf):
    return M.threshold_sweep(test_part(spark, sf), M.CONSTRUCTION_GRID)


@query(_sweep_sql(M.EVALUATION_GRID))
def threshold_sweep_evaluation(spark, sf):
    return M.threshold_sweep(test_part(spark, sf), M.EVALUATION_GRID)


@query(f"WITH {TX}, {SCORED}, x AS (SELECT member, seed, threshold, label, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pred FROM s CROSS JOIN {grid_sql(M.CONSTRUCTION_GRID)}), y AS ({confusion_sql('x', 'member, seed, threshold')}) SELECT member, seed, max(f1) AS best_f1, coalesce(min(threshold) FILTER (f1 > 0 AND f1 = m), 0.5) AS threshold FROM (SELECT *, max(f1) OVER (PARTITION BY member, seed) AS m FROM y) GROUP BY ALL")
def best_threshold_by_scorer(spark, sf):
    by = ["member", "seed"]
    return M.best_threshold(M.threshold_sweep(scorers(test_part(spark, sf)), M.CONSTRUCTION_GRID, by), by)


@query(f"WITH {TX}, {VERDICTS} " + confusion_sql("v", "model, run"))
def unweighted_prf(spark, sf):
    return M.prf(verdicts(test_part(spark, sf)), ["model", "run"])


@query(f"WITH {TX} " + confusion_sql("(SELECT *, 1 AS pred, 1.0 + row_id % 3 AS w FROM t)", "", "w", kind="DOUBLE"))
def predict_all_floor(spark, sf):
    return M.predict_all_floor(test_part(spark, sf).withColumn("w", 1.0 + F.col("row_id") % 3), weight="w")


@query(f"""WITH {TX}, {VERDICTS}, c AS ({confusion_sql('v', 'payment_format, model, run')}), m AS (SELECT payment_format, model, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall FROM c GROUP BY ALL), fl AS ({confusion_sql('(SELECT *, 1 AS pred FROM t)', 'payment_format')})
SELECT payment_format, count(*) AS cells, {', '.join(f'round(min(m.{c}), 6) AS {c}_lowest, round(max(m.{c}), 6) AS {c}_highest' for c in ('f1', 'precision', 'recall'))}, round(max(fl.f1), 6) AS floor_f1, round(max(fl.precision), 6) AS floor_precision FROM m JOIN fl USING (payment_format) GROUP BY payment_format""")
def cell_mean_range(spark, sf):
    """The range over models of their means over runs, for each dataset, beside the floor of a scorer that flags everything."""
    t = test_part(spark, sf)
    cells = M.prf(verdicts(t), ["payment_format", "model", "run"])
    floor = M.predict_all_floor(t, ["payment_format"])
    return rounded(M.cell_mean_range(cells, ["payment_format"], ["model"], ["f1", "precision", "recall"], floor))


@query(f"WITH {TX}, {VERDICTS}, c AS ({confusion_sql('v', 'model, run')}) SELECT model, count(f1) AS n, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS sd_pop, round(stddev_samp(f1), 6) AS sd_samp, round(min(f1), 6) AS min, round(max(f1), 6) AS max FROM c GROUP BY model")
def seed_spread(spark, sf):
    return rounded(M.spread(M.prf(verdicts(test_part(spark, sf)), ["model", "run"]), ["model"], "f1"))


# ---------------------------------------------------------------- multi-class


def class_sql(source: str, by: str, truth: str, pred: str, classes: str = "") -> str:
    both = f"(SELECT DISTINCT {by} FROM {source}) CROSS JOIN {classes}" if classes else f"(SELECT {by}, {truth} AS cls FROM {source} WHERE {truth} IS NOT NULL UNION SELECT {by}, {pred} FROM {source} WHERE {pred} IS NOT NULL)"
    return f"""SELECT {by}, cls, CAST(count(*) FILTER ({truth} = cls AND {pred} = cls) AS DOUBLE) AS tp, CAST(count(*) FILTER ({pred} = cls AND {truth} IS DISTINCT FROM cls) AS DOUBLE) AS fp, CAST(count(*) FILTER ({truth} = cls AND {pred} IS DISTINCT FROM cls) AS DOUBLE) AS fn, CAST(count(*) FILTER ({truth} = cls) AS DOUBLE) AS support
 FROM {both} JOIN {source} USING ({by}) GROUP BY {by}, cls"""


CLASSES = "(VALUES (0),(1),(2),(3),(4),(5),(6),(7)) c(cls)"
TPS = f"{TX}, {VERDICTS}, q AS (SELECT model, run, typology AS y, CASE WHEN pred_typology >= 0 THEN pred_typology END AS z FROM v WHERE label = 1 AND pred = 1 AND typology >= 0)"
F1S = "SELECT *, CASE WHEN support > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM"


def _classes(spark):
    return spark.createDataFrame([(i,) for i in range(8)], "cls int")


def _tps(spark, sf):
    v = verdicts(test_part(spark, sf)).where("label = 1 AND pred = 1 AND typology >= 0")
    return v.select("model", "run", F.col("typology").alias("y"), F.when(F.col("pred_typology") >= 0, F.col("pred_typology")).alias("z"))


@query(f"WITH {TPS} SELECT model, run, round(coalesce(avg(f1), 0), 6) AS macro_f1, count(f1) AS classes FROM ({F1S} ({class_sql('q', 'model, run', 'y', 'z', CLASSES)})) GROUP BY model, run")
def typology_macro_f1_tp(spark, sf):
    return rounded(M.macro_f1(M.class_f1(_tps(spark, sf), "y", "z", _classes(spark), ["model", "run"]), ["model", "run"]))


@query(f"WITH {TPS} SELECT model, run, cls, tp, fp, fn, support, round(f1, 6) AS f1 FROM ({F1S} ({class_sql('q', 'model, run', 'y', 'z', CLASSES)}))")
def per_class_f1(spark, sf):
    return rounded(M.class_f1(_tps(spark, sf), "y", "z", _classes(spark), ["model", "run"]).drop("f1_or_0"))


NONE = f"{TX}, {VERDICTS}, q AS (SELECT model, run, CAST(typology AS VARCHAR) AS y, CASE WHEN pred = 1 AND pred_typology >= 0 THEN CAST(pred_typology AS VARCHAR) ELSE 'none' END AS z FROM v WHERE label = 1 AND typology >= 0)"


@query(f"WITH {NONE} SELECT model, run, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, count(*) AS classes FROM ({class_sql('q', 'model, run', 'y', 'z')}) GROUP BY model, run")
def typology_macro_f1_none(spark, sf):
    """A benign or untyped verdict counts as the class none; the mean is over all labels of either side."""
    v = verdicts(test_part(spark, sf)).where("label = 1 AND typology >= 0")
    q = v.select("model", "run", F.col("typology").cast("string").alias("y"), F.when((F.col("pred") == 1) & (F.col("pred_typology") >= 0), F.col("pred_typology").cast("string")).otherwise("none").alias("z"))
    return rounded(M.macro_f1(M.class_f1(q, "y", "z", by=["model", "run"]), ["model", "run"], present_only=False))


@query(f"WITH {TX}, {VERDICTS}, q AS (SELECT model, typology AS y, pred_typology AS z FROM v WHERE pred = 1 AND typology >= 0) SELECT model, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, count(*) AS classes FROM ({class_sql('q', 'model', 'y', 'z')}) GROUP BY model")
def typology_macro_f1_construction(spark, sf):
    q = verdicts(test_part(spark, sf)).where("pred = 1 AND typology >= 0").select("model", F.col("typology").alias("y"), F.col("pred_typology").alias("z"))
    return rounded(M.macro_f1(M.class_f1(q, "y", "z", by=["model"]), ["model"], present_only=False))


@query(f"WITH {TX}, {VERDICTS}, q AS (SELECT model, run, CASE WHEN typology >= 0 THEN typology ELSE 8 END AS y, CASE WHEN pred = 1 AND pred_typology >= 0 THEN pred_typology ELSE 8 END AS z FROM v) SELECT model, run, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS classes FROM ({class_sql('q', 'model, run', 'y', 'z', '(SELECT unnest(range(9)) AS cls)')}) GROUP BY model, run")
def typology_macro_f1_fixed9(spark, sf):
    v = verdicts(test_part(spark, sf))
    q = v.select("model", "run", F.when(F.col("typology") >= 0, F.col("typology")).otherwise(8).alias("y"), F.when((F.col("pred") == 1) & (F.col("pred_typology") >= 0), F.col("pred_typology")).otherwise(8).alias("z"))
    return rounded(M.macro_f1(M.class_f1(q, "y", "z", spark.createDataFrame([(i,) for i in range(9)], "cls int"), ["model", "run"]), ["model", "run"], present_only=False))


# ---------------------------------------------------------------- error analysis

CROSS = f"{TX}, {VERDICTS}, e AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS ml, 1.0 + row_id % 3 AS w, CASE WHEN (p >= 0.6) = (label = 1) AND pred = label THEN 'both_right' WHEN (p >= 0.6) = (label = 1) THEN 'first_only' WHEN pred = label THEN 'second_only' ELSE 'both_wrong' END AS category FROM v)"


def _cross(spark, sf):
    return verdicts(test_part(spark, sf)).withColumns({"ml": (F.col("p") >= 0.6).cast("int"), "w": 1.0 + F.col("row_id") % 3})


@query(f"WITH {CROSS} SELECT model, run, category, count(*) AS n, sum(w) AS weighted_n FROM e GROUP BY ALL")
def error_transitions(spark, sf):
    return M.transitions(_cross(spark, sf), ["model", "run"], "label", "ml", "pred", "w")


@query(f"WITH {CROSS} SELECT model, run, category, count(*) AS n, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p, round(stddev_samp(p), 6) AS sd_p, " + ", ".join(f"count(*) FILTER (typology = {i}) AS class_{i}" for i in range(8)) + " FROM e GROUP BY ALL")
def transition_deep(spark, sf):
    e = _cross(spark, sf)
    a, b = F.col("ml") == F.col("label"), F.col("pred") == F.col("label")
    kind = F.when(a & b, "both_right").when(a, "first_only").when(b, "second_only").otherwise("both_wrong")
    each = [F.count_if(F.col("typology") == i).alias(f"class_{i}") for i in range(8)]
    e = e.withColumn("category", kind)
    median = quantiles(e, "p", (0.5,), ["model", "run", "category"]).select("model", "run", "category", F.col("cuts")[0].alias("median_p"))
    got = e.groupBy("model", "run", "category").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("sd_p"), *each)
    return rounded(got.join(median, ["model", "run", "category"], "left"))


@query(f"WITH {TX}, {VERDICTS} SELECT typology, " + ", ".join(f"round(avg(pred) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS) + " FROM v WHERE label = 1 AND typology >= 0 GROUP BY typology")
def typology_recall(spark, sf):
    return rounded(verdicts(test_part(spark, sf)).where("label = 1 AND typology >= 0").groupBy("typology").pivot("model", list(MODELS)).agg(F.avg("pred")))


@query(f"WITH {CROSS}, c AS ({confusion_sql('e', 'model, run', 'w', kind='DOUBLE')}) SELECT model, run, tp AS w_tp, fp AS w_fp, fn AS w_fn, tn AS w_tn, round(fp / nullif(fp + tn, 0), 6) AS fp_rate FROM c")
def fp_fn_summary(spark, sf):
    c = M.prf(_cross(spark, sf), ["model", "run"], weight="w")
    return rounded(c.select("model", "run", *[F.col(x).alias(f"w_{x}") for x in ("tp", "fp", "fn", "tn")], ratio_null(F.col("fp"), F.col("fp") + F.col("tn")).alias("fp_rate")))


@query(f"WITH {CROSS} SELECT model, run, CAST(sum(pred) AS BIGINT) AS predicted, CAST(sum(label) AS BIGINT) AS positives, round(sum(pred) / sum(label), 6) AS over_prediction, CAST(sum(ml) AS BIGINT) AS ml_predicted FROM e GROUP BY model, run")
def prediction_counts(spark, sf):
    return rounded(_cross(spark, sf).groupBy("model", "run").agg(F.sum("pred").alias("predicted"), F.sum("label").alias("positives"), ratio_null(F.sum("pred"), F.sum("label")).alias("over_prediction"), F.sum("ml").alias("ml_predicted")))


@query(f"WITH {TX}, {VERDICTS} SELECT model, run, CAST(sum(tok) AS BIGINT) AS tokens, round(avg(tok) FILTER (tok > 0), 6) AS mean_tokens, count(*) FILTER (tok > 0) AS n_valid, round(count(*) FILTER (tok > 0) / count(*), 6) AS valid_ratio FROM (SELECT *, {sql_nibble(chr(39) + 'tok' + chr(39), 'model', 'run', 'row_id')} * 10 AS tok FROM v) GROUP BY ALL")
def token_accounting(spark, sf):
    from strataweave.plans.tx import nibble

    v = verdicts(test_part(spark, sf)).withColumn("tok", nibble("tok", F.col("model"), F.col("run"), F.col("row_id")) * 10)
    valid = F.col("tok") > 0
    return rounded(v.groupBy("model", "run").agg(F.sum("tok").alias("tokens"), F.avg(F.when(valid, F.col("tok"))).alias("mean_tokens"), F.count_if(valid).alias("n_valid"), ratio0(F.count_if(valid), F.count("*")).alias("valid_ratio")))


KINDS = ("payment_format", "reference", "outcome", "correct")
_SETS = [(), ("model",), *[(k,) for k in KINDS], *[("model", k) for k in KINDS]]


@query(f"""WITH {TX}, {VERDICTS}, g AS (SELECT *, CASE WHEN label = 0 THEN 'benign' WHEN typology >= 0 THEN 'illicit_typed' ELSE 'illicit_reference_absent' END AS reference, CASE WHEN label = 1 AND pred = 1 THEN 'tp' WHEN label = 1 THEN 'fn' WHEN pred = 1 THEN 'fp' ELSE 'tn' END AS outcome, CASE WHEN pred = label THEN 'correct' ELSE 'incorrect' END AS correct FROM v)
SELECT model, {', '.join(KINDS)}, count(*) FILTER (pred = label) AS right_k, count(*) AS right_n, round(count(*) FILTER (pred = label) / nullif(count(*), 0), 6) AS right_rate,
count(*) FILTER (pred = 1 AND reference = 'illicit_typed') AS typed_k, count(*) FILTER (reference = 'illicit_typed') AS typed_n, round(count(*) FILTER (pred = 1 AND reference = 'illicit_typed') / nullif(count(*) FILTER (reference = 'illicit_typed'), 0), 6) AS typed_rate FROM g GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(x) + ')' for x in _SETS)})""")
def group_rollups(spark, sf):
    """Overall, by model, by each of four kinds of group, and by model and kind: ten overlapping groupings in one pass, with null rates where nothing is eligible."""
    y, z = F.col("label"), F.col("pred")
    reference = F.when(y == 0, "benign").when(F.col("typology") >= 0, "illicit_typed").otherwise("illicit_reference_absent")
    outcome = F.when((y == 1) & (z == 1), "tp").when(y == 1, "fn").when(z == 1, "fp").otherwise("tn")
    v = verdicts(test_part(spark, sf)).withColumns({"reference": reference, "outcome": outcome, "correct": F.when(y == z, "correct").otherwise("incorrect")})
    return rounded(M.rates_over(v, _SETS, {"right": ("pred = label", "true"), "typed": ("pred = 1", "reference = 'illicit_typed'")}))


@query(f"WITH {TX}, c AS (SELECT *, row_id % 2 = 0 AS present FROM t), {VERDICTS} SELECT present, model, round(count(*) FILTER (label = 0 AND pred = 1) / nullif(count(*) FILTER (label = 0), 0), 6) AS benign_flag_rate, round(count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1), 0), 6) AS illicit_recall FROM (SELECT *, row_id % 2 = 0 AS present FROM v) GROUP BY ALL")
def presence_rates(spark, sf):
    v = verdicts(test_part(spark, sf)).withColumn("present", F.col("row_id") % 2 == 0)
    share = lambda y: ratio_null(F.count_if((F.col("label") == y) & (F.col("pred") == 1)), F.count_if(F.col("label") == y))
    return rounded(v.groupBy("present", "model").agg(share(0).alias("benign_flag_rate"), share(1).alias("illicit_recall")))


CURVE = f"""{TX}, d AS (SELECT p AS score, sum(label) AS pos, count(*) AS n FROM t GROUP BY p), k AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER () AS positives FROM d WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT score, tp / flagged AS pr, tp / positives AS re FROM k), z AS (SELECT *, re - coalesce(lag(re) OVER (ORDER BY score DESC), 0) AS step, coalesce(lag(pr) OVER (ORDER BY score DESC), 1) AS before FROM r)"""


@query(f"WITH {CURVE} SELECT round(sum(step * pr), 6) AS average_precision, round(sum(step * (pr + before) / 2), 6) AS pr_auc FROM z")
def average_precision(spark, sf):
    return rounded(M.average_precision(M.pr_curve(test_part(spark, sf))))


@query(f"WITH {CURVE} SELECT round(score, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(flagged - tp AS BIGINT) AS fp, round(tp / flagged, 6) AS precision, round(tp / positives, 6) AS recall FROM k")
def pr_curve(spark, sf):
    return rounded(M.pr_curve(test_part(spark, sf)).drop("positives", "pos", "neg"))


@query(f"WITH {TX} SELECT row_id, 'amlc_' || lpad(row_id::VARCHAR, greatest(5, length(row_id::VARCHAR))::INTEGER, '0') AS case_id, row_id AS number, CASE typology " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPOLOGIES)) + " END AS name FROM t")
def case_identifiers(spark, sf):
    """Case names, their numbers read back, and typology names from a dimension."""
    t = test_part(spark, sf)
    names = spark.createDataFrame(list(enumerate(TYPOLOGIES)), "typology int, name string")
    t = t.join(F.broadcast(names), "typology", "left").withColumn("case_id", case_id(F.col("row_id")))  # eight rows
    return t.select("row_id", "case_id", case_number(F.col("case_id")).alias("number"), "name")


@query("SELECT source, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def class_attach(spark, sf):
    """Left join to classes; rows without one are unknown."""
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
