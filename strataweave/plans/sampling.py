"""Queries: strata, samples with weights, budgets, allocations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.functions.ratios import ratio0
from strataweave.operators import metrics as M
from strataweave.operators import sampling as S
from strataweave.plans.scoring import RATES
from strataweave.plans.tx import TX, read, rounded, test_part
from strataweave.session import written

QUERIES, ORACLES = {}, {}
TAU, SEED, PER = 0.8, 42, 30

STRATA = f"""{TX}, d AS (SELECT *, 1 - 2 * abs(p - 0.5) AS difficulty, label = 0 AND p >= 0.5 * {TAU} AS hard FROM t), q AS (SELECT quantile_cont(difficulty, 0.33) AS q1, quantile_cont(difficulty, 0.67) AS q2 FROM d WHERE label = 0 AND NOT hard),
st AS (SELECT d.* EXCLUDE (hard), CASE WHEN label = 1 THEN 'illicit' WHEN hard THEN 'hard_neg' WHEN difficulty < q1 THEN 'easy_t1' WHEN difficulty < q2 THEN 'easy_t2' ELSE 'easy_t3' END AS stratum FROM d CROSS JOIN q)"""


def ranked(source: str, by: str, seed="42", key: str = "row_id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}|' || {key})) AS rk, count(*) OVER ({part}) AS pool FROM {source})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def strata(spark, sf):
    return S.stratify(test_part(spark, sf), TAU)


@query(f"WITH {STRATA}, s AS (SELECT * FROM {ranked('st', 'stratum')} WHERE label = 1 OR rk <= {PER}), w AS (SELECT *, CASE WHEN label = 1 THEN 1.0 ELSE pool / least(pool, {PER}) END AS weight FROM s) SELECT stratum, count(*) AS n, max(pool) AS pool, round(sum(weight), 6) AS sum_w, round(sum(weight * CAST(label = 1 AND p >= {TAU} AS INT)), 6) AS tp, round(sum(weight * CAST(label = 0 AND p >= {TAU} AS INT)), 6) AS fp FROM w GROUP BY stratum")
def ht_weighted_confusion(spark, sf):
    st = strata(spark, sf)
    size = F.when(F.col("stratum") == "illicit", F.col("pool")).otherwise(F.lit(PER))
    s = S.sample(st, ["stratum"], size, SEED)
    flagged = F.col("p") >= TAU
    hit = lambda y: F.sum(F.when((F.col("label") == y) & flagged, F.col("weight")).otherwise(0.0))
    return rounded(s.groupBy("stratum").agg(F.count("*").alias("n"), F.max("pool").alias("pool"), F.sum("weight").alias("sum_w"), hit(1).alias("tp"), hit(0).alias("fp")))


@query(f"WITH {STRATA}, s AS (SELECT *, CASE WHEN label = 1 THEN 1.0 ELSE pool / least(pool, {PER}) END AS w FROM {ranked('st', 'stratum')} WHERE label = 1 OR rk <= {PER}) SELECT *, {RATES} FROM (SELECT coalesce(sum(w) FILTER (label = 1 AND p >= {TAU}), 0) AS tp, coalesce(sum(w) FILTER (label = 0 AND p >= {TAU}), 0) AS fp, coalesce(sum(w) FILTER (label = 1 AND p < {TAU}), 0) AS fn, coalesce(sum(w) FILTER (label = 0 AND p < {TAU}), 0) AS tn FROM s)")
def ht_prf(spark, sf):
    size = F.when(F.col("stratum") == "illicit", F.col("pool")).otherwise(F.lit(PER))
    s = S.sample(strata(spark, sf), ["stratum"], size, SEED).withColumn("pred", (F.col("p") >= TAU).cast("int"))
    return M.prf(s, weight="weight")


@query(f"WITH {STRATA} SELECT stratum, label, count(*) AS n, round(min(difficulty), 6) AS lowest, round(max(difficulty), 6) AS highest FROM st GROUP BY ALL")
def difficulty_terciles(spark, sf):
    return rounded(strata(spark, sf).groupBy("stratum", "label").agg(F.count("*").alias("n"), F.min("difficulty").alias("lowest"), F.max("difficulty").alias("highest")))


@query(f"WITH {STRATA} SELECT round(min(p) FILTER (label = 0 AND stratum = 'hard_neg'), 6) AS min_inside, round(max(p) FILTER (label = 0 AND stratum <> 'hard_neg'), 6) AS max_outside, round((min(p) FILTER (label = 0 AND stratum = 'hard_neg') + max(p) FILTER (label = 0 AND stratum <> 'hard_neg')) / 2, 6) AS cut FROM st")
def infer_hard_cut(spark, sf):
    return rounded(S.infer_hard_cut(strata(spark, sf).withColumn("inside", F.col("stratum") == "hard_neg")))


@query(f"WITH {TX} SELECT row_id, label, pool, 200::BIGINT AS n FROM {ranked('t', '')} WHERE rk <= 200")
def b1_uniform(spark, sf):
    return S.sample(test_part(spark, sf), [], 200, SEED).select("row_id", "label", "pool", "n")


@query(f"WITH {TX}, c AS (SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS ill FROM t), k AS (SELECT greatest(1, round_even(200 * ill / total, 0))::BIGINT AS k FROM c) SELECT row_id, label FROM {ranked('t', 'label')} CROSS JOIN k WHERE rk <= CASE WHEN label = 1 THEN k ELSE 200 - k END")
def b2_proportional(spark, sf):
    t = test_part(spark, sf)
    share = t.agg(F.greatest(F.lit(1), F.rint(200 * F.sum("label") / F.count("*"))).cast("bigint").alias("k"))
    sized = t.groupBy("label").count().crossJoin(F.broadcast(share)).select("label", F.when(F.col("label") == 1, F.col("k")).otherwise(200 - F.col("k")).alias("take"))  # two rows
    return S.first_ranked(t.withColumn("_d", draw(SEED, F.col("row_id"))), ["label"], "_d", sized).select("row_id", "label")


@query(f"WITH {TX} SELECT row_id, label FROM {ranked('t', 'label')} WHERE label = 1 OR rk <= 100")
def b3_keep_illicit(spark, sf):
    t = test_part(spark, sf)
    return S.sample(t, ["label"], F.when(F.col("label") == 1, F.col("pool")).otherwise(F.lit(100)), SEED).select("row_id", "label")


@query(f"WITH {TX}, d AS (SELECT *, 1 - 2 * abs(p - 0.5) AS difficulty FROM t WHERE label = 0), q AS (SELECT quantile_cont(difficulty, 0.33) AS q1, quantile_cont(difficulty, 0.67) AS q2 FROM d), b AS (SELECT d.*, CASE WHEN difficulty < q1 THEN 1 WHEN difficulty < q2 THEN 2 ELSE 3 END AS tercile FROM d CROSS JOIN q) SELECT row_id, tercile, pool / least(pool, 40) AS weight FROM {ranked('b', 'tercile')} WHERE rk <= 40")
def b4_no_hardneg(spark, sf):
    """Terciles of the whole benign pool, hard negatives not set apart."""
    b = test_part(spark, sf).where("label = 0").withColumn("difficulty", S.difficulty(F.col("p")))
    b = b.crossJoin(F.broadcast(S.quantile_cuts(b, "difficulty"))).withColumn("tercile", S.tercile(F.col("difficulty"), F.col("cuts")))  # one row
    return S.sample(b, ["tercile"], 40, SEED).select("row_id", "tercile", "weight")


NEYMAN = f"{TX}, b AS (SELECT *, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin FROM t), g AS (SELECT bin, count(*) AS pool, greatest(stddev_pop(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 1e-8) AS s FROM b GROUP BY bin), a AS (SELECT *, greatest(1, round_even(200 * pool * s / sum(pool * s) OVER (), 0))::BIGINT AS n0 FROM g), z AS (SELECT *, least(pool, CASE WHEN row_number() OVER (ORDER BY pool DESC, bin) = 1 THEN greatest(1, n0 + 200 - sum(n0) OVER ()) ELSE n0 END)::BIGINT AS n FROM a)"


@query(f"WITH {NEYMAN} SELECT bin, pool, round(s, 6) AS s, n FROM z")
def b5_neyman(spark, sf):
    """Allocation by pool times the deviation of being right, over score bins; the largest bin takes what rounding leaves."""
    b = test_part(spark, sf).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    right = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")
    g = b.groupBy("bin").agg(F.count("*").alias("pool"), F.greatest(F.stddev_pop(right), F.lit(1e-8)).alias("s"))
    whole = Window.partitionBy()  # ten rows
    n0 = F.greatest(F.lit(1), F.rint(200 * F.col("pool") * F.col("s") / F.sum(F.col("pool") * F.col("s")).over(whole))).cast("bigint")
    a = g.withColumn("n0", n0).withColumn("_sum", F.sum("n0").over(whole)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("pool"), "bin")))
    n = F.least(F.col("pool"), F.when(F.col("_r") == 1, F.greatest(F.lit(1), F.col("n0") + 200 - F.col("_sum"))).otherwise(F.col("n0")))
    return rounded(a.select("bin", "pool", "s", n.cast("bigint").alias("n")))


@query(f"""WITH {TX}, g AS (SELECT payment_format, count(*) AS pool FROM t GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY pool DESC, payment_format) AS i, greatest(1, round_even(200 * pool / sum(pool) OVER (), 0))::BIGINT AS want FROM g),
c AS (SELECT *, least(want, pool) AS w, count(*) OVER () AS k FROM o), r AS (SELECT *, greatest(200 - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest FROM c)
SELECT payment_format, pool, CAST(CASE WHEN i = k THEN least(rest, pool) ELSE least(w, rest) END AS BIGINT) AS take FROM r""")
def b7_attribute_strata(spark, sf):
    g = test_part(spark, sf).groupBy("payment_format").agg(F.count("*").alias("pool"))
    return S.proportional(g, "pool", 200, [F.desc("pool"), F.col("payment_format")])


DRAWS = f"{STRATA}, dr AS (SELECT unnest(range(8)) AS draw), r AS (SELECT *, row_number() OVER (PARTITION BY draw, stratum ORDER BY md5((42 + 7919 * draw) || '|' || row_id)) AS rk, count(*) OVER (PARTITION BY draw, stratum) AS pool FROM st CROSS JOIN dr), b AS (SELECT r.*, size FROM r CROSS JOIN (VALUES (10), (20), (40), (80)) z(size) WHERE label = 1 OR rk <= size), w AS (SELECT *, CASE WHEN label = 1 THEN 1.0 ELSE pool / least(pool, size) END AS weight FROM b), m AS (SELECT size, draw, *, {RATES} FROM (SELECT size, draw, coalesce(sum(weight) FILTER (label = 1 AND p >= {TAU}), 0) AS tp, coalesce(sum(weight) FILTER (label = 0 AND p >= {TAU}), 0) AS fp, coalesce(sum(weight) FILTER (label = 1 AND p < {TAU}), 0) AS fn, coalesce(sum(weight) FILTER (label = 0 AND p < {TAU}), 0) AS tn FROM w GROUP BY ALL))"


def draws(spark, sf):
    """All draws and sizes in one job: the seed is part of the hash, a size takes a prefix of the order."""
    st = strata(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7))))
    pools = st.where("draw = 0").groupBy("stratum").agg(F.count("*").alias("pool"))
    st = st.withColumn("_d", draw(42 + 7919 * F.col("draw"), F.col("row_id")))
    sizes = pools.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("most", F.when(F.col("stratum") == "illicit", F.col("pool")).otherwise(F.least("pool", F.lit(80))))
    near = written(S.first_ranked(st, ["draw", "stratum"], "_d", written(sizes, "sizes"), "most"), "draws").join(F.broadcast(pools), "stratum")  # five rows
    rank = F.row_number().over(Window.partitionBy("draw", "stratum").orderBy("_d"))  # at most 80 rows, or the census
    near = near.withColumn("rk", rank).withColumn("size", F.explode(F.array(*[F.lit(x) for x in (10, 20, 40, 80)]))).where("label = 1 OR rk <= size")
    near = near.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(F.col("pool") / F.least("pool", "size"))).withColumn("pred", (F.col("p") >= TAU).cast("int"))
    return M.prf(near, ["size", "draw"], weight="weight")


@query(f"WITH {DRAWS} SELECT size, draw, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def ht_draw_sweep(spark, sf):
    return rounded(draws(spark, sf).select("size", "draw", "precision", "recall", "f1"))


TRUTH = f"f AS (SELECT *, {RATES} FROM (SELECT count(*) FILTER (label = 1 AND p >= {TAU}) AS tp, count(*) FILTER (label = 0 AND p >= {TAU}) AS fp, count(*) FILTER (label = 1 AND p < {TAU}) AS fn, count(*) FILTER (label = 0 AND p < {TAU}) AS tn FROM t))"


@query(f"WITH {DRAWS}, {TRUTH} SELECT size, round(avg(abs(m.f1 - f.f1)), 6) AS d_f1, round(avg(abs(m.precision - f.precision)), 6) AS d_precision, avg(abs(m.f1 - f.f1)) <= 0.05 AND avg(abs(m.precision - f.precision)) <= 0.05 AND avg(abs(m.recall - f.recall)) <= 0.05 AS feasible FROM m CROSS JOIN f GROUP BY size")
def budget_feasible(spark, sf):
    truth = M.prf(test_part(spark, sf).withColumn("pred", (F.col("p") >= TAU).cast("int"))).select(*[F.col(c).alias(f"t_{c}") for c in ("precision", "recall", "f1")])
    off = lambda c: F.avg(F.abs(F.col(c) - F.col(f"t_{c}")))
    d = draws(spark, sf).crossJoin(F.broadcast(truth))  # one row
    return rounded(d.groupBy("size").agg(off("f1").alias("d_f1"), off("precision").alias("d_precision"), ((off("f1") <= 0.05) & (off("precision") <= 0.05) & (off("recall") <= 0.05)).alias("feasible")))


@query(f"WITH {DRAWS}, {TRUTH}, x AS (SELECT size, avg(abs(m.f1 - f.f1)) <= 0.2 AND avg(abs(m.recall - f.recall)) <= 0.2 AS feasible FROM m CROSS JOIN f GROUP BY size) SELECT min(size) FILTER (feasible) AS smallest FROM x")
def budget_feasible_min(spark, sf):
    truth = M.prf(test_part(spark, sf).withColumn("pred", (F.col("p") >= TAU).cast("int"))).select(*[F.col(c).alias(f"t_{c}") for c in ("recall", "f1")])
    off = lambda c: F.avg(F.abs(F.col(c) - F.col(f"t_{c}")))
    d = draws(spark, sf).crossJoin(F.broadcast(truth)).groupBy("size").agg(((off("f1") <= 0.2) & (off("recall") <= 0.2)).alias("feasible"))
    return d.agg(F.min(F.when(F.col("feasible"), F.col("size"))).alias("smallest"))


@query(f"WITH {DRAWS}, {TRUTH} SELECT size, round(avg(m.f1 - f.f1), 6) AS bias, round(avg(abs(m.f1 - f.f1)), 6) AS mae, round(sqrt(avg((m.f1 - f.f1) ** 2)), 6) AS rmse, round(stddev_samp(m.f1), 6) AS sd, round(stddev_samp(m.f1) / sqrt(count(*)), 6) AS mcse FROM m CROSS JOIN f GROUP BY size")
def draw_summary(spark, sf):
    truth = M.prf(test_part(spark, sf).withColumn("pred", (F.col("p") >= TAU).cast("int"))).select(F.col("f1").alias("t"))
    d = draws(spark, sf).crossJoin(F.broadcast(truth)).withColumn("e", F.col("f1") - F.col("t"))
    return rounded(d.groupBy("size").agg(F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_samp("f1").alias("sd"), (F.stddev_samp("f1") / F.sqrt(F.count("*"))).alias("mcse")))


@query(f"""WITH {STRATA}, be AS (SELECT *, md5('{SEED}|' || row_id) AS d, md5('{SEED}|fill|' || row_id) AS f, count(*) OVER (PARTITION BY stratum) AS pool FROM st WHERE label = 0),
h AS (SELECT count(*) FILTER (stratum = 'hard_neg') AS h, count(*) FILTER (stratum <> 'hard_neg') AS e FROM be), k AS (SELECT *, least(60, h) AS nh0, least(200 - least(60, h), e) AS ne FROM h), z AS (SELECT *, CASE WHEN ne < 200 - nh0 AND h > nh0 THEN least(200 - ne, h) ELSE nh0 END AS nh FROM k),
b AS (SELECT be.*, row_number() OVER (PARTITION BY stratum ORDER BY d) <= CASE WHEN 200 >= h + e THEN pool WHEN stratum = 'hard_neg' THEN nh ELSE least(greatest(1, ne // 3), pool) END AS base FROM be CROSS JOIN z),
fl AS (SELECT *, NOT base AND row_number() OVER (PARTITION BY base ORDER BY f) <= 200 - (SELECT count(*) FROM b WHERE base) AS fill FROM b)
SELECT stratum, count(*) AS taken, max(pool) AS pool, count(*) AS n, max(pool)::DOUBLE AS sum_w FROM fl WHERE base OR fill GROUP BY stratum UNION ALL SELECT 'illicit', count(*), NULL, NULL, count(*)::DOUBLE FROM st WHERE label = 1 HAVING count(*) > 0""")
def benign_budget_sample(spark, sf):
    """The full benign rule: hard share, terciles, spill-over, random fill, and weights from realised membership."""
    st = strata(spark, sf)
    s = S.with_census(st.where("label = 1"), S.benign_sample(st, 200, SEED))
    return rounded(s.groupBy("stratum").agg(F.count("*").alias("taken"), F.max("pool").alias("pool"), F.max("n").alias("n"), F.sum("weight").alias("sum_w")))


NAIVE = f"""{TX}, d AS (SELECT row_id, label, typology, 1 - 2 * abs(p - 0.5) AS difficulty FROM t), q AS (SELECT label, quantile_cont(difficulty, 0.33) AS q1, quantile_cont(difficulty, 0.67) AS q2 FROM d GROUP BY label),
k AS (SELECT row_id, label, CASE WHEN label = 1 THEN typology * 3 + 2 ELSE -4 END + CASE WHEN difficulty < q1 THEN 1 WHEN difficulty < q2 THEN 2 ELSE 3 END AS stratum FROM d JOIN q USING (label)), po AS (SELECT label, stratum, count(*) AS pool FROM k GROUP BY ALL),
ia AS (SELECT *, sum(pool) OVER () AS al, CASE WHEN sum(pool) OVER () <= 30 THEN pool ELSE least(pool, greatest(1, 30 // count(*) OVER ())) END AS base FROM po WHERE label = 1),
ib AS (SELECT label, stratum, least(al, 30)::BIGINT AS due, greatest(0, least(base, least(al, 30) - coalesce(sum(base) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM ia),
kn AS (SELECT max(al)::BIGINT AS al, max(least(al, 30))::BIGINT AS di FROM ia), ba AS (SELECT label, stratum, pool, sum(pool) OVER () AS be, al, di FROM po CROSS JOIN kn WHERE label = 0),
bb AS (SELECT label, stratum, least(floor(di / (al / (al + be))) - di, be)::BIGINT AS due, floor(least(floor(di / (al / (al + be))) - di, be) * (pool / be))::BIGINT AS take FROM ba), sz AS (SELECT * FROM ib UNION ALL SELECT * FROM bb),
fi AS (SELECT k.*, due, sum(CASE WHEN rk <= take THEN 1 ELSE 0 END) OVER (PARTITION BY k.label) AS got, rk <= take AS first FROM (SELECT *, row_number() OVER (PARTITION BY label, stratum ORDER BY md5('{SEED}|' || row_id)) AS rk FROM k) k JOIN sz USING (label, stratum))"""


@query(f"WITH {NAIVE} SELECT row_id, label, stratum FROM fi QUALIFY first OR row_number() OVER (PARTITION BY label, first ORDER BY md5('{SEED}|fill|' || row_id)) <= due - got")
def naive_stratified(spark, sf):
    """Thirty illicit rows in equal parts of typology and tercile, filled up, and benign rows at the population's ratio."""
    return S.naive_draw(test_part(spark, sf), 30, SEED).select("row_id", "label", "stratum")


@query(f"WITH {STRATA}, c AS (SELECT stratum, count(*) AS pool FROM st WHERE label = 0 GROUP BY ALL), a AS (SELECT *, 97 * pool // sum(pool) OVER () AS fl, 97 * pool % sum(pool) OVER () AS rest FROM c) SELECT stratum, pool, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 97 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM a")
def largest_remainder_allocation(spark, sf):
    c = strata(spark, sf).where("label = 0").groupBy("stratum").agg(F.count("*").alias("pool"))
    return S.largest_remainder(c, [], "pool", "stratum", 97)


@query(f"WITH {TX}, g AS (SELECT typology, count(*) AS pool FROM t WHERE label = 1 AND typology >= 0 GROUP BY typology), lv AS (SELECT max(l) AS l FROM (SELECT l, (SELECT sum(least(pool, l)) FROM g) AS s FROM range(0, 26) r(l)) WHERE s <= 25) SELECT typology, pool, least(pool, l) + CASE WHEN pool > l AND row_number() OVER (PARTITION BY pool > l ORDER BY typology) <= 25 - (SELECT sum(least(pool, l)) FROM g) THEN 1 ELSE 0 END AS take FROM g CROSS JOIN lv")
def balanced_round_robin(spark, sf):
    """Equal quotas by typology; what small ones lack goes round to the others."""
    g = test_part(spark, sf).where("label = 1 AND typology >= 0").groupBy("typology").agg(F.count("*").alias("pool"))
    return S.round_robin(g, "pool", "typology", 25)


@query(f"WITH {STRATA}, s AS (SELECT *, pool / least(pool, {PER}) AS weight FROM {ranked('st', 'stratum')} WHERE rk <= {PER}) SELECT stratum, count(*) AS n_real, max(pool) AS pool, round(min(weight), 6) AS modal_weight, true AS consistent FROM s GROUP BY stratum")
def weight_repair_check(spark, sf):
    return rounded(S.weight_report(S.sample(strata(spark, sf), ["stratum"], PER, SEED)))


@query(f"WITH {TX}, b AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM t), f AS (SELECT row_id, label, pred FROM {ranked('b', 'label, pred')} WHERE rk <= 20), rest AS (SELECT * FROM b WHERE row_id NOT IN (SELECT row_id FROM f)), u AS (SELECT row_id, label, pred FROM {ranked('rest', '', seed='top')} WHERE rk <= 10) SELECT *, 'cell' AS kind FROM f UNION ALL SELECT *, 'top_up' FROM u")
def audit_slice(spark, sf):
    """At most 20 rows of each outcome cell, topped up from the rest."""
    b = test_part(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    first = S.sample(b, ["label", "pred"], 20, SEED).select("row_id", "label", "pred")
    more = S.sample(b.join(first.select("row_id"), "row_id", "left_anti"), [], 10, "top").select("row_id", "label", "pred")
    return first.withColumn("kind", F.lit("cell")).unionByName(more.withColumn("kind", F.lit("top_up")))


@query(f"WITH {TX}, tr AS (SELECT * FROM tx WHERE split = 'train'), i AS (SELECT row_id, typology, split FROM {ranked('(SELECT * FROM tr WHERE typology >= 0)', 'typology')} WHERE rk = 1), b AS (SELECT row_id, typology, split FROM {ranked('(SELECT * FROM tr WHERE label = 0)', '')} WHERE rk <= 4) SELECT * FROM i UNION ALL SELECT * FROM b")
def demo_pool(spark, sf):
    """One training row for each typology and four benign ones."""
    from strataweave.plans.tx import tx

    train = tx(spark, sf).where("split = 'train'")
    one = S.sample(train.where("typology >= 0"), ["typology"], 1, SEED).select("row_id", "typology", "split")
    return one.unionByName(S.sample(train.where("label = 0"), [], 4, SEED).select("row_id", "typology", "split"))


@query("WITH c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id FROM c QUALIFY row_number() OVER (ORDER BY md5('9|' || doc_id)) <= 25")
def anti_join_topup(spark, sf):
    rest = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return S.sample(rest, [], 25, 9, "doc_id").select("doc_id")


@query(f"WITH {TX}, r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY md5((42 + 7919 * draw) || '|' || row_id)) AS rk FROM t CROSS JOIN (SELECT unnest(range(8))::INT AS draw)) SELECT draw, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (p >= {TAU}) AS flagged, count(*) FILTER (label = 1) = 0 AS degenerate FROM r WHERE rk <= 40 GROUP BY draw")
def degenerate_draws(spark, sf):
    """Uniform draws of 40 rows that hold no positive one and so have no defined recall."""
    t = test_part(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("_d", draw(42 + 7919 * F.col("draw"), F.col("row_id")))
    sizes = spark.range(8).select(F.col("id").cast("int").alias("draw"), F.lit(40).alias("take"))
    taken = S.first_ranked(t, ["draw"], "_d", sizes)
    positive = F.count_if(F.col("label") == 1)
    return taken.groupBy("draw").agg(F.count("*").alias("n"), positive.alias("positives"), F.count_if(F.col("p") >= TAU).alias("flagged"), (positive == 0).alias("degenerate"))


@query(f"WITH {STRATA} SELECT count(*) FILTER (label = 0 AND p >= {TAU} AND stratum = 'hard_neg') AS fp_inside, count(*) FILTER (label = 0 AND p >= {TAU} AND stratum <> 'hard_neg') AS fp_outside, round(count(*) FILTER (label = 0 AND p >= {TAU} AND stratum = 'hard_neg') / nullif(count(*) FILTER (label = 0 AND p >= {TAU}), 0), 6) AS share_inside FROM st")
def transfer_diagnostics(spark, sf):
    fp = (F.col("label") == 0) & (F.col("p") >= TAU)
    inside = F.count_if(fp & (F.col("stratum") == "hard_neg"))
    return rounded(strata(spark, sf).agg(inside.alias("fp_inside"), F.count_if(fp & (F.col("stratum") != "hard_neg")).alias("fp_outside"), ratio0(inside, F.count_if(fp)).alias("share_inside")))
