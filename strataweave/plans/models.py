"""Queries: model features and scores, walks, searches, verification of published numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import parsing as P
from strataweave.operators import cycles as C
from strataweave.operators import graph as G
from strataweave.operators import models as L
from strataweave.plans.sampling import TAU
from strataweave.plans.scoring import confusion_sql
from strataweave.plans.tx import TX, read, rounded, sql_nibble, test_part, tx, verdicts, VERDICTS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


Z = "greatest(-10.0, least(10.0, ({c} - avg({c}) FILTER (split = 'train') OVER ()) / (stddev_pop({c}) FILTER (split = 'train') OVER () + 1e-8)))"


@query(f"WITH {TX} SELECT row_id, round({Z.format(c='amount')}, 5) AS amount, round({Z.format(c='dst')}, 5) AS dst FROM tx")
def znorm_clip(spark, sf):
    """Normalisation with statistics of the training rows only."""
    t = tx(spark, sf).withColumn("dst", F.col("dst").cast("double"))
    return rounded(L.normalised(t, ["amount", "dst"], F.col("split") == "train").select("row_id", "amount", "dst"), 5)


def _features(spark, sf):
    t = tx(spark, sf)
    wide = G.trailing(t, "src").select("row_id", "degree", "fan", "mean_amount", "max_amount")
    return t.join(wide, "row_id").withColumn("hour", (F.col("epoch_s") / 3600 % 24).cast("double"))


@query()
def gbt_detector(spark, sf):
    """Boosted trees on the training rows, scores and verdicts of the test rows by class and decile."""
    f = _features(spark, sf)
    columns = ["amount", "degree", "fan", "mean_amount", "max_amount", "hour"]
    model = L.detector(f.where("split = 'train'"), columns, rounds=5, depth=3)
    s = L.wrapped(L.scored(model, f.where("split = 'test'")), 0.5, "typology")
    return s.groupBy("label", "illicit").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(f"WITH {TX}, s AS (SELECT *, row_id % 49 + 1 AS step FROM tx WHERE label >= 0) SELECT CASE WHEN step <= 34 THEN 'train' ELSE 'test' END AS part, label, count(*) AS n FROM s GROUP BY ALL")
def temporal_split(spark, sf):
    t = tx(spark, sf).withColumn("step", F.col("row_id") % 49 + 1).where("label >= 0")
    return t.groupBy(F.when(F.col("step") <= 34, "train").otherwise("test").alias("part"), "label").agg(F.count("*").alias("n"))


@query(f"WITH {TX}, k AS (SELECT DISTINCT src AS node FROM t WHERE label = 1) SELECT row_id FROM tx WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def edges_within(spark, sf):
    """Edges with both ends in a set, by two semi joins."""
    t = tx(spark, sf)
    k = t.where("split = 'test' and label = 1").select("src").distinct()
    return t.join(k, "src", "left_semi").join(k.withColumnRenamed("src", "dst"), "dst", "left_semi").select("row_id")


@query(f"WITH {TX}, c AS (SELECT payment_format, count(*) AS n FROM t WHERE label = 1 GROUP BY ALL UNION ALL SELECT payment_format, 0 FROM (SELECT DISTINCT payment_format FROM t) WHERE payment_format NOT IN (SELECT payment_format FROM t WHERE label = 1)) SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, count(*) - 1 AS freedom FROM (SELECT n, sum(n) OVER () / count(*) OVER () AS e FROM c)")
def anchor_chi_square(spark, sf):
    """Counts of a class over categories against equal shares."""
    from pyspark.sql.window import Window

    c = test_part(spark, sf).groupBy("payment_format").agg(F.sum("label").alias("n"))
    whole = Window.partitionBy()  # a row for each category
    e = c.withColumn("e", F.sum("n").over(whole) / F.count("*").over(whole))
    return rounded(e.agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("freedom")))


@query(f"WITH {TX}, {VERDICTS} SELECT model, count(*) AS n, count(*) FILTER (typology = pred_typology) AS agree, round(count(*) FILTER (typology <> pred_typology) / count(*), 6) AS mismatch FROM v GROUP BY model")
def alignment_check(spark, sf):
    """How far two codings of the same rows differ."""
    v = verdicts(test_part(spark, sf))
    other = F.count_if(F.col("typology") != F.col("pred_typology"))
    return rounded(v.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("typology") == F.col("pred_typology")).alias("agree"), (other / F.count("*")).alias("mismatch")))


@query(f"WITH {TX}, {VERDICTS}, c AS ({confusion_sql('v', 'model, run')}), p AS (SELECT model, f1 AS published FROM c WHERE run = 0) SELECT model, round(abs(f1 - published), 6) AS off, abs(f1 - published) <= 0.06 AS ok FROM c JOIN p USING (model) WHERE run = 1")
def published_numbers(spark, sf):
    """Numbers recomputed from the second run against those of the first, within a tolerance."""
    from strataweave.operators import metrics as M

    c = M.prf(verdicts(test_part(spark, sf)), ["model", "run"]).select("model", "run", "f1")
    p = c.where("run = 0").select("model", F.col("f1").alias("published"))
    off = F.abs(F.col("f1") - F.col("published"))
    return rounded(c.where("run = 1").join(p, "model").select("model", off.alias("off"), (off <= 0.06).alias("ok")))


JUDGED = "j AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN b WHEN 1 THEN 'Scores:' || chr(10) || '```json' || chr(10) || b || chr(10) || '```' WHEN 2 THEN left(coalesce(text, ''), 20) || ' ' || b || ' so much' WHEN 3 THEN 'none given' ELSE left(b, 12) END AS said FROM (SELECT doc_id, text, '{\"parse\": ' || doc_id % 2 || ', \"recall\": ' || doc_id % 3 || '}' AS b FROM documents))"


@query(f"""WITH {JUDGED}, x AS (SELECT doc_id, regexp_extract(said, '\\{{[^{{}}]*"parse"[^{{}}]*\\}}') AS o FROM j) SELECT doc_id, TRY_CAST(regexp_extract(o, '"parse": (\\d)', 1) AS INT) AS parse, TRY_CAST(regexp_extract(o, '"recall": (\\d)', 1) AS INT) AS recall FROM x""")
def judge_json(spark, sf):
    """Scores from answers that are JSON, JSON behind a fence, JSON amid text, cut off, or absent."""
    d = read(spark, sf, "documents")
    kind = F.col("doc_id") % 5
    body = F.concat(F.lit('{"parse": '), (F.col("doc_id") % 2).cast("string"), F.lit(', "recall": '), (F.col("doc_id") % 3).cast("string"), F.lit("}"))
    fenced = F.concat(F.lit("Scores:\n```json\n"), body, F.lit("\n```"))
    amid = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 20), F.lit(" "), body, F.lit(" so much"))
    s = P.judge_scores(F.when(kind == 0, body).when(kind == 1, fenced).when(kind == 2, amid).when(kind == 3, "none given").otherwise(F.substring(body, 1, 12)))
    return d.select("doc_id", s["parse"].alias("parse"), s["recall"].alias("recall"))


@query(f"WITH {TX}, w AS (SELECT row_id, label, md5(sd || '|' || row_id) AS d, sd FROM t CROSS JOIN (VALUES (1), (2), (3)) z(sd)), r AS (SELECT w.*, t.p, row_number() OVER (PARTITION BY sd, w.label ORDER BY d) AS rk FROM w JOIN t USING (row_id)), f AS (SELECT size, sd AS seed, label, CASE WHEN p >= {TAU} THEN 1 ELSE 0 END AS pred FROM r CROSS JOIN (VALUES (20), (50), (100)) q(size) WHERE rk <= size), c AS ({confusion_sql('f', 'size, seed')}), u AS ({confusion_sql(f'(SELECT label, CASE WHEN p >= {TAU} THEN 1 ELSE 0 END AS pred FROM t)')}) SELECT size, seed, round(abs(c.f1 - u.f1), 6) AS d_f1, abs(c.f1 - u.f1) <= 0.05 AS feasible FROM c CROSS JOIN u")
def exhaustive_design_search(spark, sf):
    return rounded(L.smallest_design(test_part(spark, sf), [20, 50, 100], [1, 2, 3], TAU))


_DRAW = "CAST(('0x' || substr(md5('42|{what}|' || (s.step + 1) || '|' || s.walker), 1, 12)) AS BIGINT) % 1073741824"


@query(f"""WITH RECURSIVE {TX}, nb AS (SELECT DISTINCT src AS node, dst AS other FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst),
nr AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('42|' || node || '|' || other), other) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM nb),
s(walker, node, start, step) AS (SELECT row_id, src, src, 0 FROM t WHERE label = 1
UNION ALL SELECT s.walker, CASE WHEN {_DRAW.format(what='home')} < {int(0.15 * (1 << 30))} THEN s.start ELSE coalesce(nr.other, s.start) END, s.start, s.step + 1 FROM s LEFT JOIN nr ON nr.node = s.node AND nr.i = {_DRAW.format(what='move')} % nr.n WHERE s.step < 8)
SELECT node, count(*) AS visits FROM s GROUP BY node""")
def random_walk_nodes(spark, sf):
    """Nodes that walkers from the illicit rows reach in eight steps, with their visits."""
    t = test_part(spark, sf)
    starts = t.where("label = 1").select(F.col("row_id").alias("walker"), F.col("src").alias("node"))
    return L.random_walk(t, starts, 8).groupBy("node").agg(F.count("*").alias("visits"))


@query(f"""WITH {TX}, e AS (SELECT * FROM t WHERE src <> dst), c2 AS (SELECT a.src AS start, 2 AS hops, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src AND b.epoch_s > a.epoch_s AND b.epoch_s - a.epoch_s <= 86400 GROUP BY ALL),
c3 AS (SELECT a.src AS start, 3 AS hops, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND b.epoch_s > a.epoch_s AND b.epoch_s - a.epoch_s <= 86400 AND b.dst <> a.src JOIN e c ON c.src = b.dst AND c.dst = a.src AND c.epoch_s > b.epoch_s AND c.epoch_s - a.epoch_s <= 86400 GROUP BY ALL),
c4 AS (SELECT a.src AS start, 4 AS hops, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND b.epoch_s > a.epoch_s AND b.epoch_s - a.epoch_s <= 86400 AND b.dst <> a.src JOIN e c ON c.src = b.dst AND c.epoch_s > b.epoch_s AND c.epoch_s - a.epoch_s <= 86400 AND c.dst NOT IN (a.src, a.dst) JOIN e d ON d.src = c.dst AND d.dst = a.src AND d.epoch_s > c.epoch_s AND d.epoch_s - a.epoch_s <= 86400 GROUP BY ALL)
SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4""")
def bounded_cycles(spark, sf):
    return L.bounded_cycles(test_part(spark, sf))


@query(ORACLES["bounded_cycles"].replace("e AS (SELECT * FROM t WHERE", "e AS (SELECT * FROM tx WHERE"))
def bounded_cycles_full(spark, sf):
    return L.bounded_cycles(tx(spark, sf))


@query(f"""WITH RECURSIVE {TX}, e AS MATERIALIZED (SELECT src, dst, epoch_s FROM tx WHERE src <> dst), s(start, pos, t0, t1, seen, hops) AS (SELECT src, dst, epoch_s, epoch_s, [src, dst], 1 FROM e
UNION ALL SELECT s.start, e.dst, s.t0, e.epoch_s, list_append(s.seen, e.dst), s.hops + 1 FROM s JOIN e ON e.src = s.pos AND e.epoch_s > s.t1 AND e.epoch_s - s.t0 <= 86400 WHERE s.hops < 10 AND s.pos <> s.start AND (e.dst = s.start OR NOT list_contains(s.seen, e.dst)))
SELECT start, hops, count(*) AS n FROM s WHERE pos = start AND hops > 1 GROUP BY start, hops""")
def long_cycles(spark, sf):
    """Cycles of up to ten edges within a day, over all rows."""
    return C.long_cycles(tx(spark, sf))
