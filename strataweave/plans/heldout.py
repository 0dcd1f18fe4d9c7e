"""Queries: thresholds by seed, repaired weights, held-out designs with their draws, uncertainty of cells and of paired contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import heldout as H
from strataweave.operators import metrics as M
from strataweave.operators import sampling as S
from strataweave.operators import weights as W
from strataweave.plans.sampling import PER, SEED, STRATA, ranked, strata
from strataweave.plans.scoring import RATES, confusion_sql, grid_sql
from strataweave.plans.tx import SCORED, SCORERS, TX, VERDICTS, rounded, scorers, test_part, tx, verdicts
from strataweave.session import written

QUERIES, ORACLES = {}, {}
#: Scorers of the first seed build the designs, those of the second are held out.
BUILD, HELD, BUDGET, DRAWS = 42, 123, 60, 8
MEMBERS = sorted({m for m, _, _ in SCORERS})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TAUS = f"""{TX}, {SCORED}, vs AS (SELECT u.* EXCLUDE (p), member, seed, amount / (amount + c) AS p FROM (SELECT * FROM tx WHERE split = 'val') u CROSS JOIN (VALUES {', '.join(str(x) for x in SCORERS)}) w(member, seed, c)),
vx AS (SELECT member, seed, threshold, label, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pred FROM vs CROSS JOIN {grid_sql(M.CONSTRUCTION_GRID)}), vy AS ({confusion_sql('vx', 'member, seed, threshold')}),
tau AS (SELECT member, seed, coalesce(min(threshold) FILTER (f1 > 0 AND f1 = m), 0.5) AS threshold FROM (SELECT *, max(f1) OVER (PARTITION BY member, seed) AS m FROM vy) GROUP BY ALL)"""


def thresholds(spark, sf):
    """Each scorer's own threshold from the validation part, six rows, written."""
    by = ["member", "seed"]
    val = scorers(tx(spark, sf).where("split = 'val'"))
    return written(M.best_threshold(M.threshold_sweep(val, M.CONSTRUCTION_GRID, by), by).select("member", "seed", "threshold"), "thresholds")


@query(f"WITH {TAUS} SELECT member, seed, threshold, tp, fp, fn, tn, {RATES} FROM (SELECT member, seed, threshold, count(*) FILTER (label = 1 AND p >= threshold) AS tp, count(*) FILTER (label = 0 AND p >= threshold) AS fp, count(*) FILTER (label = 1 AND p < threshold) AS fn, count(*) FILTER (label = 0 AND p < threshold) AS tn FROM s JOIN tau USING (member, seed) GROUP BY ALL)")
def seed_thresholds(spark, sf):
    """Every scorer of every seed judged on the test part at its own threshold, which only the validation part sets."""
    s = scorers(test_part(spark, sf)).join(F.broadcast(thresholds(spark, sf)), ["member", "seed"])  # six rows
    return M.prf(s.withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int")), ["member", "seed", "threshold"])


_SUM = lambda seed: "(" + " + ".join(f"amount / (amount + {c})" for _, s, c in SCORERS if s == seed) + f") / {len(MEMBERS)}"
_THIRD = lambda a, b: f"CASE WHEN difficulty < {a} THEN '1' WHEN difficulty < {b} THEN '2' ELSE '3' END"
DESIGN = f"""{TAUS}, tc AS (SELECT avg(threshold) AS tau_c FROM tau WHERE seed = {BUILD}), con AS (SELECT row_id, {_SUM(BUILD)} AS score FROM t WHERE label = 0),
hd AS (SELECT row_id, 1 - 2 * abs(score - 0.5) AS difficulty, score >= tau_c / 2 AS hard FROM con CROSS JOIN tc), qa AS (SELECT quantile_cont(difficulty, 0.33) AS a1, quantile_cont(difficulty, 0.67) AS a2, quantile_cont(difficulty, 0.33) FILTER (NOT hard) AS e1, quantile_cont(difficulty, 0.67) FILTER (NOT hard) AS e2 FROM hd),
ls AS (SELECT row_id, 'uniform_ht' AS sampler, 'benign' AS stratum FROM hd UNION ALL SELECT row_id, 'difficulty_ht', 'difficulty_' || {_THIRD('a1', 'a2')} FROM hd CROSS JOIN qa UNION ALL SELECT row_id, 'hard_terciles_ht', CASE WHEN hard THEN 'hard' ELSE 'easy_' || {_THIRD('e1', 'e2')} END FROM hd CROSS JOIN qa),
i0 AS (SELECT sampler, stratum, count(*) AS pool, {BUDGET}::BIGINT AS b FROM ls GROUP BY ALL), i1 AS (SELECT *, count(*) FILTER (stratum LIKE 'easy%') OVER (PARTITION BY sampler) AS ne FROM i0),
i2 AS (SELECT *, coalesce(max(CASE WHEN stratum = 'hard' THEN least(pool, greatest(1, b * 3 // 10), b - ne) END) OVER (PARTITION BY sampler), 0) AS hn FROM i1),
i3 AS (SELECT *, CASE WHEN stratum = 'benign' THEN b WHEN stratum = 'hard' THEN hn WHEN stratum LIKE 'diff%' THEN least(pool, greatest(1, b // 3)) ELSE least(pool, greatest(1, (b - hn) // 3)) END AS f FROM i2),
i4 AS (SELECT *, b - sum(f) OVER (PARTITION BY sampler) AS lft, nullif(sum(pool - f) OVER (PARTITION BY sampler), 0) AS tot FROM i3),
i5 AS (SELECT *, coalesce(lft * (pool - f) // tot, 0) AS ex, coalesce(lft * (pool - f) % tot, 0) AS rm FROM i4),
ds AS (SELECT sampler, stratum, pool, CAST(f + ex + CASE WHEN row_number() OVER (PARTITION BY sampler ORDER BY rm DESC, stratum <> 'hard', stratum) <= lft - sum(ex) OVER (PARTITION BY sampler) THEN 1 ELSE 0 END AS BIGINT) AS n FROM i5)"""


def _designed(spark, sf):
    """The benign test rows with their strata, and the flags of the held-out scorers, each at its own threshold."""
    known = thresholds(spark, sf)
    taus = {r["member"]: r["threshold"] for r in known.where(f"seed = {HELD}").collect()}  # three rows
    build = known.where(f"seed = {BUILD}").agg(F.avg("threshold").alias("tau_c"))
    p = lambda seed: {m: F.col("amount") / (F.col("amount") + c) for m, s, c in SCORERS if s == seed}
    score = sum(list(p(BUILD).values())[1:], list(p(BUILD).values())[0]) / len(MEMBERS)
    flags = F.array(*[(p(HELD)[m] >= taus[m]).cast("int") for m in MEMBERS])
    t = test_part(spark, sf).select("row_id", "label", score.alias("p"), flags.alias("flags")).crossJoin(F.broadcast(build))  # one row
    return t, H.benign_strata(t, F.col("tau_c"))


@query(f"WITH {DESIGN} SELECT * FROM ds")
def heldout_design(spark, sf):
    """Three samplers of one budget: strata, pools and allocations, before any held-out scorer is looked at."""
    return H.allocate(_designed(spark, sf)[1], BUDGET)


_CHOOSE = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def intervals_sql(source: str) -> str:
    """iv (pool, n, x, parts, low, high) for the distinct (pool, n, x, parts) of a source: every number of marked rows with its two tails, term by term."""
    return f"""un AS (SELECT DISTINCT pool::BIGINT AS pool, n::BIGINT AS n, x::BIGINT AS x, parts FROM {source} WHERE n < pool), mk AS (SELECT *, unnest(range(x, pool - n + x + 1)) AS m FROM un),
tl AS (SELECT pool, n, x, parts, m, sum(pr) FILTER (i >= x) AS upper, sum(pr) FILTER (i <= x) AS lower FROM (SELECT *, exp({_CHOOSE('m', 'i')} + {_CHOOSE('(pool - m)', '(n - i)')} - {_CHOOSE('pool', 'n')}) AS pr FROM (SELECT *, unnest(range(greatest(0, n + m - pool), least(n, m) + 1)) AS i FROM mk)) GROUP BY ALL),
iv AS (SELECT pool, n, x, parts, min(m) FILTER (upper >= 0.05 / parts / 2 - 1e-12) AS low, max(m) FILTER (lower >= 0.05 / parts / 2 - 1e-12) AS high FROM tl GROUP BY ALL)"""


_PRF = lambda fp, s: f"coalesce(tp / nullif(tp + {fp}, 0), 0) AS precision_{s}, coalesce(tp / nullif(pos, 0), 0) AS recall_{s}, coalesce(2 * tp / nullif(tp + pos + {fp}, 0), 0) AS f1_{s}"
EVALUATED = f"""{DESIGN}, fl AS (SELECT row_id, member, label, CAST(p >= threshold AS INT) AS flag FROM s JOIN tau USING (member, seed) WHERE seed = {HELD}),
rk AS (SELECT ls.*, draw, row_number() OVER (PARTITION BY draw, sampler, stratum ORDER BY md5((42 + 7919 * draw) || '|' || row_id)) AS rk FROM ls CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
cn AS (SELECT draw, sampler, stratum, pool, n, member, sum(flag)::BIGINT AS x FROM rk JOIN ds USING (sampler, stratum) JOIN fl USING (row_id) WHERE rk <= n GROUP BY ALL), cp AS (SELECT sampler, greatest(1, 3 * count(*) FILTER (n < pool)) AS parts FROM ds GROUP BY sampler),
cq AS (SELECT * FROM cn JOIN cp USING (sampler)), {intervals_sql('cq')},
ev AS (SELECT draw, sampler, member, sum(cq.pool / cq.n * cq.x) AS fp, sum(coalesce(low, cq.x)) AS fl, sum(coalesce(high, cq.x)) AS fh FROM cq LEFT JOIN iv USING (pool, n, x, parts) GROUP BY ALL),
kn AS (SELECT member, sum(flag * label) AS tp, sum(label) AS pos, sum(flag * (1 - label)) AS fp_true FROM fl GROUP BY member), pt AS (SELECT draw, sampler, member, {_PRF('fp', 'e')}, {_PRF('fh', 'l')}, {_PRF('fl', 'u')}, {_PRF('fp_true', 't')} FROM ev JOIN kn USING (member)),
ml AS ({' UNION ALL '.join(f"SELECT draw, sampler, member, '{m}' AS metric, {m}_e AS e, {m}_l AS l, {m}_u AS u, {m}_t AS tr FROM pt" for m in ('precision', 'recall', 'f1'))})"""


@query(f"""WITH {EVALUATED}, sm AS (SELECT sampler, member, metric, count(*) AS draws, max(tr) AS truth, avg(e) AS mean_estimate, avg(e - tr) AS bias, avg(abs(e - tr)) AS mae, sqrt(avg((e - tr) ** 2)) AS rmse, stddev_samp(e) AS sd, avg(CAST(l <= tr + 1e-12 AND u >= tr - 1e-12 AS DOUBLE)) AS coverage, avg(u - l) AS mean_width FROM ml GROUP BY ALL)
SELECT sampler, member, metric, draws, {', '.join(f'round({c}, 6) AS {c}' for c in ('truth', 'mean_estimate', 'bias', 'mae', 'rmse', 'sd', 'coverage', 'mean_width'))}, round(sqrt(coverage * (1 - coverage) / draws), 6) AS coverage_mcse FROM sm""")
def heldout_summary(spark, sf):
    """Draws of three designs judged on scorers that took no part in them: bias, errors, coverage and width for each sampler, scorer and metric."""
    t, rows = _designed(spark, sf)
    counts = written(H.draw_counts(rows, H.allocate(rows, BUDGET), "flags", DRAWS, SEED), "heldout-counts")
    flagged = t.select("label", F.posexplode("flags").alias("scorer", "flag"))
    hit = lambda y: F.sum(F.when(F.col("label") == y, F.col("flag")).otherwise(0))
    known = flagged.groupBy("scorer").agg(hit(1).alias("tp"), F.sum("label").alias("pos"), hit(0).alias("fp"))
    names = F.element_at(F.array(*[F.lit(m) for m in MEMBERS]), F.col("scorer") + 1)
    judged = H.evaluate_counts(counts, known, len(MEMBERS)).withColumn("member", names)
    return rounded(H.summary(judged, ["sampler", "member", "metric"]))


#: A shared sample: all illicit rows and PER rows of each benign stratum, with the verdicts of each model and run.
CELLS = f"""{STRATA}, {VERDICTS}, sa AS (SELECT row_id, label, stratum, pool, CASE WHEN label = 1 THEN pool ELSE least(pool, {PER}) END AS n FROM {ranked('st', 'stratum')} WHERE label = 1 OR rk <= {PER}), lg AS (SELECT sa.*, v.model, v.run, v.pred FROM sa JOIN v USING (row_id)),
kk AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) AS total FROM t), p0 AS (SELECT model, run, sum(pred * label)::DOUBLE AS tp, sum(CASE WHEN label = 0 THEN pred * pool / n ELSE 0 END) AS fp FROM lg GROUP BY ALL), p1 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr FROM p0 CROSS JOIN kk),
gr AS (SELECT *, -coalesce(tp / nullif((tp + fp) ** 2, 0), 0) AS gp, -coalesce(2 * tp / nullif((tp + pos + fp) ** 2, 0), 0) AS gf, total / nullif(pos, 0) AS up FROM p1), z AS (SELECT row_id, stratum, pool, n, model, avg(pred * gp) AS zp, avg(pred * gf) AS zf, avg(pred * gp * up) AS zl FROM lg JOIN gr USING (model, run) WHERE label = 0 GROUP BY ALL)"""
_SE = lambda source, by: f"SELECT {by} sqrt(sum(k * coalesce(vp, 0))) AS precision, 0.0::DOUBLE AS recall, sqrt(sum(k * coalesce(vf, 0))) AS f1, sqrt(sum(k * coalesce(vl, 0))) AS lift FROM (SELECT {by} stratum, max(pool) * max(pool) * (1 - max(n) / max(pool)) / max(n) AS k, var_samp(zp) AS vp, var_samp(zf) AS vf, var_samp(zl) AS vl FROM {source} GROUP BY {by} stratum)" + (f" GROUP BY {by.rstrip(', ')}" if by else "")
_ENDS = lambda times, where="": f"""xc AS (SELECT model, run, stratum, pool, n, sum(pred)::BIGINT AS x, {times} * 2 * (SELECT count(*) FILTER (n < pool) FROM (SELECT DISTINCT stratum, pool, n FROM sa WHERE label = 0)) AS parts FROM lg WHERE label = 0 GROUP BY ALL), {intervals_sql('xc')},
en AS (SELECT model, run, sum(coalesce(low, xc.x)) AS fl, sum(coalesce(high, xc.x)) AS fh FROM xc LEFT JOIN iv USING (pool, n, x, parts) GROUP BY ALL),
pq AS (SELECT model, run, {_PRF('fp', 'e')}, {_PRF('fh', 'l')}, {_PRF('fl', 'u')}, up FROM gr JOIN en USING (model, run)), m0 AS ({' UNION ALL '.join(f"SELECT model, '{m}' AS metric, {m}_e AS e, {m}_l AS l, {m}_u AS u FROM pq" for m in ('precision', 'recall', 'f1'))} UNION ALL SELECT model, 'lift', precision_e * up, precision_l * up, precision_u * up FROM pq),
mm AS (SELECT model, metric, avg(e) AS mean, coalesce(stddev_samp(e), 0) AS run_sd, avg(l) AS low, avg(u) AS high FROM m0 GROUP BY ALL)"""  # noqa: E731


def _cells(spark, sf):
    size = F.when(F.col("stratum") == "illicit", F.col("pool")).otherwise(F.lit(PER))
    return written(verdicts(S.sample(strata(spark, sf), ["stratum"], size, SEED)).select("row_id", "label", "stratum", "pool", "n", "model", "run", "pred"), "cells")


@query(f"""WITH {CELLS}, {_ENDS(1)}, se AS (UNPIVOT ({_SE('z', 'model, ')}) ON precision, recall, f1, lift INTO NAME metric VALUE se), fr AS (UNPIVOT (SELECT pos / total AS precision, 1.0::DOUBLE AS recall, 2 * pos / (total + pos) AS f1, 1.0::DOUBLE AS lift FROM kk) ON precision, recall, f1, lift INTO NAME metric VALUE floor)
SELECT model, metric, round(mean, 6) AS mean, round(run_sd, 6) AS run_sd, round(se, 6) AS se, round(low, 6) AS low, round(high, 6) AS high, round(mean - floor, 6) AS over_floor FROM mm JOIN se USING (model, metric) JOIN fr USING (metric)""")
def cell_uncertainty(spark, sf):
    """Each model's metrics over both runs with the error of the shared sample, exact envelopes and the gap to flagging everything."""
    return rounded(H.cell_uncertainty(_cells(spark, sf), "model", "run"))


@query(f"""WITH {CELLS}, {_ENDS(2)}, zz AS (SELECT row_id, stratum, pool, n, sum(CASE model WHEN 'm1' THEN zp ELSE -zp END) AS zp, sum(CASE model WHEN 'm1' THEN zf ELSE -zf END) AS zf, sum(CASE model WHEN 'm1' THEN zl ELSE -zl END) AS zl FROM z WHERE model IN ('m1', 'm2') GROUP BY ALL),
se AS (UNPIVOT ({_SE('zz', '')}) ON precision, recall, f1, lift INTO NAME metric VALUE se) SELECT metric, round(a.mean - b.mean, 6) AS difference, round(se, 6) AS se, round(a.low - b.high, 6) AS low, round(a.high - b.low, 6) AS high FROM mm a JOIN mm b USING (metric) JOIN se USING (metric) WHERE a.model = 'm1' AND b.model = 'm2'""")
def paired_contrast(spark, sf):
    """The first model less the second on the same rows, with the covariance between their runs."""
    return rounded(H.paired_contrast(_cells(spark, sf), "model", "run", "m1", "m2"))


#: An archive as its generator left it: the hard rows whole, FEW rows of each easy stratum at pool / FEW, and up to two more that bear what the stratum had left.
FEW = 8
ARCHIVE = f"""{STRATA}, ar AS (SELECT *, CASE WHEN label = 1 OR stratum = 'hard_neg' THEN 1.0::DOUBLE WHEN rk <= {FEW} THEN pool / least(pool, {FEW}) ELSE pool::DOUBLE - {FEW} END AS archived FROM {ranked('st', 'stratum')} WHERE label = 1 OR stratum = 'hard_neg' OR rk <= {FEW} + 2),
rp AS (SELECT *, CASE WHEN label = 1 THEN 1.0 ELSE pool / count(*) OVER (PARTITION BY stratum) END AS fixed FROM ar)"""


def _repaired(spark, sf):
    st = strata(spark, sf)
    easy = st.where("stratum LIKE 'easy%'")
    some = S.sample(easy, ["stratum"], FEW, SEED)
    more = S.sample(easy, ["stratum"], FEW + 2, SEED).join(some.select("row_id"), "row_id", "left_anti").withColumn("weight", F.col("pool").cast("double") - FEW)
    whole = st.where("stratum IN ('illicit', 'hard_neg')").select("row_id", F.lit(1.0).alias("weight"))
    archive = whole.union(some.select("row_id", "weight")).union(more.select("row_id", "weight"))
    return W.recompute(test_part(spark, sf).select("row_id", "label", "p"), archive)


@query(f"WITH {ARCHIVE} SELECT row_id, stratum, round(archived, 6) AS archived, round(fixed, 6) AS fixed FROM rp")
def repaired_weights(spark, sf):
    """Each archived row with its weight as saved and as its realised stratum gives it; the cut of the hard rows comes from the saved weights alone."""
    return rounded(_repaired(spark, sf).select("row_id", "stratum", "archived", "fixed"))


@query(f"""WITH {ARCHIVE}, md AS (SELECT stratum, archived AS modal FROM rp WHERE label = 0 GROUP BY stratum, archived QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY count(*) DESC, archived) = 1),
g AS (SELECT stratum, count(*) AS members, max(pool) AS pool, count(DISTINCT archived) AS weights, max(modal) AS modal, max(pool) / count(*) FILTER (archived = modal) AS implied, count(*) FILTER (archived > modal) AS fill, count(*) FILTER (archived < modal) AS misassigned, count(*) FILTER ((archived = 1) <> (stratum = 'hard_neg')) AS census_off, count(*) FILTER (abs(archived - fixed) > 1e-9 + 1e-9 * abs(fixed)) AS changed, max(abs(archived - fixed)) AS largest_change FROM rp JOIN md USING (stratum) WHERE label = 0 GROUP BY stratum)
SELECT stratum, members, pool, weights, round(modal, 6) AS modal, round(implied, 6) AS implied, fill, misassigned, census_off, changed, round(largest_change, 6) AS largest_change, abs(modal - implied) <= 1e-9 * implied AND misassigned = 0 AND census_off = 0 AND fill <= {W.MOST_FILL} AS consistent FROM g""")
def weight_repair_report(spark, sf):
    """Whether each stratum of the archive fits its saved weights, and what the repair changes."""
    return rounded(W.report(_repaired(spark, sf)))
