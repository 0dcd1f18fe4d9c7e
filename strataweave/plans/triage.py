"""Queries: evaluation of deferral rules, outcomes and failures of verdicts, checks that reject."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import parsing as P
from strataweave.operators import checks as C
from strataweave.operators import metrics as M
from strataweave.operators import routing as U
from strataweave.plans.graphs import ROUTE, RULES, TAU, _routing
from strataweave.plans.scoring import _classes
from strataweave.plans.tx import SCORED, TX, VERDICTS, TYPOLOGIES, nibble, rounded, scorers, sql_nibble, test_part, tx, verdicts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EIGHT = "(SELECT unnest(range(8)) AS cls)"


def _evaluated(rule: str) -> str:
    return f"""WITH {ROUTE}, y AS (SELECT *, {RULES[rule]} AS asked, {sql_nibble("'head'", 'row_id')} % 8 AS ml_typology FROM x), z AS (SELECT *, CASE WHEN asked THEN pred ELSE ml END AS final, CASE WHEN asked THEN pred_typology WHEN ml = 1 THEN ml_typology END AS named FROM y),
h AS (SELECT model, run, w, CASE WHEN typology >= 0 THEN typology END AS y, CASE WHEN named >= 0 THEN named END AS z FROM z WHERE final = 1 AND label = 1), nz AS (SELECT * FROM h WHERE z IS NOT NULL),
acc AS (SELECT model, run, count(*) AS named, coalesce(sum(w) FILTER (y = z), 0) / sum(w) AS accuracy FROM nz GROUP BY model, run),
cl AS (SELECT model, run, cls, coalesce(sum(w) FILTER (y = cls AND z = cls), 0) AS tp, coalesce(sum(w) FILTER (y = cls), 0) AS sup, coalesce(sum(w) FILTER (z = cls), 0) AS prd FROM nz CROSS JOIN {EIGHT} GROUP BY model, run, cls),
ma AS (SELECT model, run, coalesce(avg(CASE WHEN sup > 0 THEN 2 * tp / (sup + prd) END), 0) AS macro FROM cl GROUP BY model, run),
ce AS (SELECT model, run, count(*) FILTER (asked) AS n_consult, count(*) FILTER (asked) / count(*) AS consult_ratio, coalesce(sum(w) FILTER (final = 1 AND label = 1), 0) AS tp, coalesce(sum(w) FILTER (final = 1 AND label = 0), 0) AS fp, coalesce(sum(w) FILTER (final = 0 AND label = 1), 0) AS fn FROM z GROUP BY model, run)
SELECT model, run, n_consult, round(consult_ratio, 6) AS consult_ratio, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(CASE WHEN named >= 3 THEN macro ELSE 0 END, 6) AS typ_macro_f1, round(CASE WHEN named >= 3 THEN accuracy ELSE 0 END, 6) AS typ_accuracy FROM ce LEFT JOIN acc USING (model, run) LEFT JOIN ma USING (model, run)"""


def _evaluate(rule: str):
    @query(_evaluated(rule))
    def run(spark, sf):
        x = _routing(spark, sf).withColumn("ml_typology", nibble("head", F.col("row_id")) % 8)
        return rounded(U.evaluate(x, rule, TAU, _classes(spark), ["model", "run"]))

    QUERIES[f"triage_{rule}"], ORACLES[f"triage_{rule}"] = QUERIES.pop("run"), ORACLES.pop("run")
    QUERIES[f"triage_{rule}"].__doc__ = f"Weighted metrics of the rule {rule} with the typology of whoever flagged a row."


for _rule in RULES:
    _evaluate(_rule)


@query(f"WITH {TX}, {VERDICTS}, nz AS (SELECT model, run, 1.0 + row_id % 3 AS w, CASE WHEN typology >= 0 THEN typology END AS y, pred_typology AS z FROM v WHERE label = 1 AND pred = 1 AND pred_typology >= 0), c AS (SELECT model, run, cls, coalesce(sum(w) FILTER (y = cls AND z = cls), 0) AS tp, coalesce(sum(w) FILTER (y = cls), 0) AS sup, coalesce(sum(w) FILTER (z = cls), 0) AS prd FROM nz CROSS JOIN {EIGHT} GROUP BY ALL), m AS (SELECT model, run, coalesce(avg(CASE WHEN sup > 0 THEN 2 * tp / (sup + prd) END), 0) AS f FROM c GROUP BY ALL), a AS (SELECT model, run, count(*) AS k, coalesce(sum(w) FILTER (y = z), 0) / sum(w) AS acc FROM nz GROUP BY ALL) SELECT model, run, round(CASE WHEN k >= 3 THEN f ELSE 0 END, 6) AS typ_macro_f1, round(CASE WHEN k >= 3 THEN acc ELSE 0 END, 6) AS typ_accuracy FROM a JOIN m USING (model, run)")
def typology_weighted(spark, sf):
    """Weighted typology macro-F1 and accuracy over the flagged illicit rows that name a class, all runs."""
    v = verdicts(test_part(spark, sf)).where("label = 1 and pred = 1").withColumns({"w": 1.0 + F.col("row_id") % 3, "y": F.when(F.col("typology") >= 0, F.col("typology")), "z": F.when(F.col("pred_typology") >= 0, F.col("pred_typology"))})
    return rounded(M.weighted_typology(v, "y", "z", _classes(spark), "w", ["model", "run"]))


# ---------------------------------------------------------------- outcomes and failures

NAMES = f"[{', '.join(repr(t) for t in TYPOLOGIES)}]"
CASES = f"ca AS (SELECT model, run, row_id, label, pred, CASE WHEN label = 1 AND typology >= 0 THEN {NAMES}[typology + 1] ELSE '' END AS truth, CASE WHEN row_id % 10 = 0 THEN 'unknown' WHEN pred_typology >= 0 AND row_id % 4 < 3 THEN {NAMES}[pred_typology % 8 + 1] WHEN pred_typology >= 0 THEN coalesce({NAMES}[typology + 1], '') END AS named FROM v)"


def _cases(spark, sf):
    names = F.array(*[F.lit(t) for t in TYPOLOGIES])
    of = lambda c: F.try_element_at(names, c + 1)
    typ, said, row = F.col("typology"), F.col("pred_typology"), F.col("row_id")
    own = F.when(typ >= 0, of(typ))
    v = verdicts(test_part(spark, sf))
    named = F.when(row % 10 == 0, "unknown").when((said >= 0) & (row % 4 < 3), of(said % 8)).when(said >= 0, F.coalesce(own, F.lit("")))
    return v.select("model", "run", "row_id", "label", "pred", F.when(F.col("label") == 1, F.coalesce(own, F.lit(""))).otherwise("").alias("truth"), named.alias("named"))


@query(f"WITH {TX}, {VERDICTS}, {CASES}, f AS (SELECT *, CASE WHEN label = 1 AND pred = 0 THEN 'under' WHEN label = 0 AND pred = 1 THEN 'over' WHEN label = 0 THEN 'correct' WHEN trim(coalesce(named, '')) IN ('', 'unknown') THEN 'format' WHEN coalesce(named = truth, false) THEN 'correct' ELSE 'typology' END AS failure FROM ca) SELECT model, run, failure, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model, run), 6) AS percent FROM f GROUP BY model, run, failure")
def failure_taxonomy(spark, sf):
    """The share of rows in each mode of failure."""
    f = _cases(spark, sf).withColumn("failure", P.failure(F.col("label"), F.col("pred"), F.col("named"), F.col("truth")))
    n = f.groupBy("model", "run", "failure").agg(F.count("*").alias("n"))
    whole = n.groupBy("model", "run").agg(F.sum("n").alias("_all"))
    return rounded(n.join(whole, ["model", "run"]).withColumn("percent", 100.0 * F.col("n") / F.col("_all")).drop("_all"))


@query(f"WITH {TX}, {VERDICTS}, {CASES}, g AS (SELECT *, CASE WHEN label <> 1 THEN 'benign' WHEN truth <> '' THEN 'illicit_typed' ELSE 'illicit_reference_absent' END AS grp, label = 1 AND truth <> '' AND pred = 1 AND coalesce(named = truth, false) AS typed FROM ca) SELECT model, grp AS reference_group, count(*) AS n, count(*) FILTER (pred = label) AS binary_correct, count(*) FILTER (grp <> 'illicit_reference_absent') AS reference_evaluable, count(*) FILTER (grp = 'illicit_typed') AS typed_eligible, count(*) FILTER (typed) AS typed_correct, count(*) FILTER ((label <> 1 AND pred = 0) OR typed) AS evaluable_correct FROM g GROUP BY model, grp")
def reference_groups(spark, sf):
    """Which rows can be judged, and how many are right under each definition."""
    c = _cases(spark, sf).withColumn("reference_group", P.reference_group(F.col("label"), F.col("truth")))
    flags = P.eligibility_flags(F.col("label"), F.col("truth"), F.col("pred") == 1, F.col("named"))
    return c.groupBy("model", "reference_group").agg(F.count("*").alias("n"), *[F.count_if(f).alias(n) for n, f in flags.items()])


@query(f"WITH {TX}, {VERDICTS}, {CASES}, o AS (SELECT CASE WHEN label = 0 AND pred = 0 THEN CASE WHEN row_id % 2 = 0 THEN 'correct_benign' ELSE 'correct_legit' END WHEN label = 0 THEN 'false_positive' WHEN pred = 0 THEN 'false_negative' WHEN coalesce(truth = named, false) THEN 'correct' ELSE 'typology_error' END AS outcome FROM ca) SELECT CASE WHEN outcome = 'correct_benign' THEN 'correct_legit' ELSE outcome END AS outcome, count(*) AS n FROM o GROUP BY 1")
def outcome_classes(spark, sf):
    """Outcomes with the former name of one of them, taken on input, under the present one."""
    c = _cases(spark, sf)
    o = P.outcome(F.col("label"), F.col("pred"), F.col("truth"), F.col("named"))
    o = F.when((o == "correct_benign") & (F.col("row_id") % 2 == 1), "correct_legit").otherwise(o)
    return c.select(P.present_outcome(o).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {TX}, {VERDICTS}, {CASES}, p AS (SELECT model, CASE WHEN row_id % 6 = 0 THEN 'legitimate' ELSE nullif(named, 'unknown') END AS said FROM ca) SELECT model, conv AS unparsed, CASE WHEN coalesce(said, '') = '' THEN conv WHEN said = 'legitimate' THEN 'benign' ELSE said END AS cls, count(*) AS n FROM p CROSS JOIN (VALUES ('benign'), ('unanswered')) z(conv) GROUP BY ALL")
def probe_classes(spark, sf):
    """Observed patterns within nine classes, under both ways to count what could not be parsed."""
    said = F.when(F.col("row_id") % 6 == 0, "legitimate").otherwise(F.nullif("named", F.lit("unknown")))
    p = _cases(spark, sf).select("model", said.alias("said"))
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unparsed"), P.probe_class(F.col("said"), u).alias("cls")) for u in ("benign", "unanswered")]))
    return p.select("model", each.alias("x")).groupBy("model", "x.unparsed", "x.cls").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- checks that reject


@query(f"WITH {TX}, a AS (SELECT dst AS node, label FROM t), b AS (SELECT src AS node, amount FROM tx) SELECT (SELECT count(*) FROM (SELECT node FROM a INTERSECT SELECT node FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT node FROM a EXCEPT SELECT node FROM b)) AS left_only, (SELECT count(*) FROM (SELECT node FROM b EXCEPT SELECT node FROM a)) AS right_only, NOT EXISTS (SELECT node FROM a EXCEPT SELECT node FROM b) AND NOT EXISTS (SELECT node FROM b EXCEPT SELECT node FROM a) AS equal")
def set_relations(spark, sf):
    """Intersection, both parts of the symmetric difference, and equality, of the receivers of a part and the senders of all."""
    return C.set_relation(test_part(spark, sf).select(F.col("dst").alias("node")), tx(spark, sf).select(F.col("src").alias("node")), ["node"])


@query(f"WITH {TX}, l AS (SELECT row_id AS id, row_id % 5 AS g FROM t), r AS (SELECT CASE WHEN row_id % 97 = 0 THEN row_id + 1 ELSE row_id END AS id FROM t), lc AS (SELECT id, count(*) AS n FROM l GROUP BY id), rc AS (SELECT id, count(*) AS n FROM r GROUP BY id) SELECT count(*) FILTER (rc.n IS NULL) AS left_only, count(*) FILTER (lc.n IS NULL) AS right_only, count(*) FILTER (lc.n > 1) AS left_repeated, count(*) FILTER (rc.n > 1) AS right_repeated, count(*) FILTER (lc.n = 1 AND rc.n = 1) AS matched FROM lc FULL JOIN rc USING (id)")
def one_to_one_report(spark, sf):
    """What keeps two tables from being joined one to one."""
    t = test_part(spark, sf)
    other = t.select(F.when(F.col("row_id") % 97 == 0, F.col("row_id") + 1).otherwise(F.col("row_id")).alias("id"))
    return C.one_to_one(t.select(F.col("row_id").alias("id")), other, ["id"])


@query(f"WITH {TX}, l AS (SELECT row_id, edge_id, label, amount FROM t), r AS (SELECT row_id, edge_id, CASE WHEN row_id % 50 = 0 THEN 1 - label ELSE label END AS label, CASE WHEN row_id % 80 = 0 THEN amount + 1 ELSE amount END AS amount FROM t WHERE row_id % 60 <> 0) SELECT count(*) FILTER (r.row_id IS NULL OR l.row_id IS NULL) AS unpaired, count(*) FILTER (l.edge_id <> r.edge_id) AS edge_id, count(*) FILTER (l.label <> r.label) AS label, count(*) FILTER (l.amount <> r.amount) AS amount FROM l FULL JOIN r USING (row_id)")
def lockstep_report(spark, sf):
    """How two codings of the same rows differ, column by column."""
    t = test_part(spark, sf).select("row_id", "edge_id", "label", "amount")
    i = F.col("row_id")
    other = t.where(i % 60 != 0).withColumns({"label": F.when(i % 50 == 0, 1 - F.col("label")).otherwise(F.col("label")), "amount": F.when(i % 80 == 0, F.col("amount") + 1).otherwise(F.col("amount"))})
    return C.lockstep(t, other, ["row_id"])


BROKEN = "CASE WHEN row_id % 61 = 0 THEN NULL WHEN row_id % 67 = 0 THEN 1 + p WHEN row_id % 71 = 0 THEN 'nan'::DOUBLE ELSE p END"


@query(f"WITH {TX}, {SCORED}, b AS (SELECT row_id, member, seed, {BROKEN} AS p FROM s), x AS (SELECT *, CASE WHEN p IS NULL THEN 'missing' WHEN isnan(p) THEN 'not a number' WHEN p < 0 OR p > 1 THEN 'out of range' END AS violation FROM b) SELECT member, seed, violation, count(*) AS n FROM x WHERE violation IS NOT NULL GROUP BY ALL")
def probability_rejects(spark, sf):
    """Members' probabilities that a strict read rejects, by reason."""
    i, p = F.col("row_id"), F.col("p")
    s = scorers(test_part(spark, sf)).withColumn("p", F.when(i % 61 == 0, None).when(i % 67 == 0, 1 + p).when(i % 71 == 0, float("nan")).otherwise(p))
    return C.probability_violations(s, "p").where("violation is not null").groupBy("member", "seed", "violation").agg(F.count("*").alias("n"))


@query(f"WITH {TX}, {VERDICTS}, f AS (SELECT model, run, CASE WHEN row_id % 40 = 0 THEN 'x' || row_id WHEN row_id % 41 = 0 THEN 'e_' || (row_id + 1) ELSE edge_id END AS case_id, CASE WHEN row_id % 53 <> 0 THEN pred END AS verdict FROM v WHERE row_id % 59 <> 0), k AS (SELECT f.*, t.edge_id IS NOT NULL AS known, count(*) OVER (PARTITION BY model, run, f.case_id) AS times FROM f LEFT JOIN t ON f.case_id = t.edge_id) SELECT model, run, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND times > 1) AS repeated, count(*) FILTER (known AND times = 1 AND verdict IS NULL) AS no_verdict, count(*) FILTER (known AND times = 1 AND verdict IS NOT NULL) AS accepted, (SELECT count(*) FROM t) - count(DISTINCT CASE WHEN known THEN case_id END) AS missing FROM k GROUP BY model, run")
def prediction_rejects(spark, sf):
    """Predictions that a strict read rejects: of unknown cases, repeated, without verdict; and cases that none covers."""
    t = test_part(spark, sf)
    t = t.repartition(max(8, min(200, t.count() // 100_000)), "row_id")  # the rows lie side by side and become six each
    i = F.col("row_id")
    case = F.when(i % 40 == 0, F.concat(F.lit("x"), i.cast("string"))).when(i % 41 == 0, F.concat(F.lit("e_"), (i + 1).cast("string"))).otherwise(F.col("edge_id"))
    found = verdicts(t).where(i % 59 != 0).select("model", "run", case.alias("case_id"), F.when(i % 53 != 0, F.col("pred")).alias("verdict"))
    return C.prediction_report(t.select(F.col("edge_id").alias("case_id")), found, ["model", "run"])
