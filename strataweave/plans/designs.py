"""Queries: searches for the smallest design."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import designs as D
from strataweave.plans.sampling import TAU
from strataweave.plans.tx import TX, rounded, test_part
from strataweave.session import written

QUERIES, ORACLES = {}, {}
PROBE, SCAN, CONFIRM = range(0, 4), range(4, 10), range(10, 40)
LIMITS, LEAST = D.Limits(rows=8, spread=0.05, kl_typology=0.30, kl_difficulty=0.30, f1=0.06), 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_T, _B = [f"t{i}" for i in range(D.TYPOLOGIES)], [f"b{i}" for i in range(D.BINS)]
_FLAGS = [f"CAST(typology = {i} AS BIGINT) AS t{i}" for i in range(D.TYPOLOGIES)] + [f"CAST(least(floor(difficulty * 10), 9) = {i} AS BIGINT) AS b{i}" for i in range(D.BINS)]


def _kl(names: list[str]) -> str:
    p = lambda c, pre: f"(({pre}{c} + 1e-9::DOUBLE) / ({' + '.join(pre + x for x in names)} + {len(names)} * 1e-9::DOUBLE))"
    return " + ".join(f"{p(c, '')} * ln({p(c, '')} / {p(c, 'w_')})" for c in names)


JUDGED = f"""{TX}, r AS MATERIALIZED (SELECT row_id, label, p, typology, 1 - 2 * abs(p - 0.5) AS difficulty, CAST(p >= {TAU} AS BIGINT) AS hit FROM t),
fl AS (SELECT *, {', '.join(_FLAGS)} FROM r),
wh AS (SELECT count(*) AS n, sum(label)::BIGINT AS n_ill, count(*) - sum(label)::BIGINT AS n_ben, sum(hit) FILTER (label = 1) AS w_tp, sum(hit) FILTER (label = 0) AS w_fp, {', '.join(f'coalesce(sum({c}) FILTER (label = 1), 0)::BIGINT AS w_{c}' for c in _T + _B)} FROM fl),
qc AS (SELECT label AS ql, quantile_cont(difficulty, 0.33) AS q1, quantile_cont(difficulty, 0.67) AS q2 FROM r GROUP BY label),
ea AS (SELECT fl.*, CASE WHEN difficulty < q1 THEN 1 WHEN difficulty < q2 THEN 2 ELSE 3 END AS third, s AS seed, ('0x' || substr(md5(s || '|' || row_id), 1, 12))::BIGINT AS h FROM fl JOIN qc ON ql = label CROSS JOIN (SELECT unnest(range({len(PROBE) + len(SCAN) + len(CONFIRM)})) AS s)),
ra AS (SELECT *, row_number() OVER (PARTITION BY seed, typology * 3 + third ORDER BY h) AS rk FROM ea WHERE label = 1),
pr AS (SELECT seed, row_number() OVER o AS n_illicit, sum(hit) OVER o AS tp, sum(difficulty) OVER o AS d, sum(difficulty * difficulty) OVER o AS dd, {', '.join(f'(sum({c}) OVER o)::BIGINT AS {c}' for c in _T + _B)} FROM ra WINDOW o AS (PARTITION BY seed ORDER BY rk, h ROWS UNBOUNDED PRECEDING)),
hb AS (SELECT seed, third, row_number() OVER b AS rk, sum(hit) OVER b AS fp FROM ea WHERE label = 0 WINDOW b AS (PARTITION BY seed, third ORDER BY h ROWS UNBOUNDED PRECEDING)),
po AS (SELECT count(*) FILTER (third = 1) AS p1, count(*) FILTER (third <= 2) AS p2 FROM ea WHERE label = 0 AND seed = 0),
tk AS (SELECT *, nb * p1 // n_ben AS k1, nb * p2 // n_ben - nb * p1 // n_ben AS k2, nb - nb * p2 // n_ben AS k3 FROM (SELECT *, least(n_illicit * n // n_ill - n_illicit, n_ben) AS nb FROM pr CROSS JOIN wh CROSS JOIN po)),
me AS (SELECT tk.*, coalesce(2.0 * tp / nullif(tp + coalesce(a.fp, 0) + coalesce(b.fp, 0) + coalesce(c.fp, 0) + n_illicit, 0), 0) AS f1, 2.0 * w_tp / nullif(w_tp + w_fp + n_ill, 0) AS full_f1, {_kl(_T)} AS kl_typology, {_kl(_B)} AS kl_difficulty,
  sqrt(greatest(dd / n_illicit - (d / n_illicit) ** 2, 0)) AS spread, {' + '.join(f'({c} > 0)::INT' for c in _T)} AS typologies, {' + '.join(f'(w_{c} > 0)::INT' for c in _T)} AS all_types
  FROM tk LEFT JOIN hb a ON a.seed = tk.seed AND a.third = 1 AND a.rk = k1 LEFT JOIN hb b ON b.seed = tk.seed AND b.third = 2 AND b.rk = k2 LEFT JOIN hb c ON c.seed = tk.seed AND c.third = 3 AND c.rk = k3),
j AS MATERIALIZED (SELECT seed, n_illicit, n_illicit + nb AS n_total, f1, abs(f1 - coalesce(full_f1, 0)) AS d_f1, kl_typology, kl_difficulty, spread, typologies, n_illicit >= least({LIMITS.rows}, n_ill) AND spread >= {LIMITS.spread} AND kl_typology <= {LIMITS.kl_typology} AND kl_difficulty <= {LIMITS.kl_difficulty} AND abs(f1 - coalesce(full_f1, 0)) <= {LIMITS.f1} AND typologies >= all_types AS feasible FROM me)"""


def _judged(spark, sf):
    return written(D.judged(test_part(spark, sf), [*PROBE, *SCAN, *CONFIRM], TAU, LIMITS), "judged")


@query(f"WITH {JUDGED} SELECT n_illicit, count(*) AS draws, count(*) FILTER (feasible) AS feasible, max(n_total) AS n_total, round(avg(f1), 6) AS mean_f1, round(max(d_f1), 6) AS worst_f1, round(avg(kl_typology), 6) AS kl_typology, round(avg(kl_difficulty), 6) AS kl_difficulty, round(min(spread), 6) AS least_spread, min(typologies) AS typologies FROM j GROUP BY n_illicit")
def design_sizes(spark, sf):
    """Every size of every draw against the five constraints."""
    return rounded(_judged(spark, sf).groupBy("n_illicit").agg(F.count("*").alias("draws"), F.count_if("feasible").alias("feasible"), F.max("n_total").alias("n_total"), F.avg("f1").alias("mean_f1"), F.max("d_f1").alias("worst_f1"), F.avg("kl_typology").alias("kl_typology"), F.avg("kl_difficulty").alias("kl_difficulty"), F.min("spread").alias("least_spread"), F.min("typologies").alias("typologies")))


_SETS = f"count(*) FILTER (feasible AND seed < {PROBE.stop}) AS probed, count(*) FILTER (feasible AND seed >= {SCAN.start} AND seed < {SCAN.stop}) AS scanned, count(*) FILTER (feasible AND seed >= {CONFIRM.start}) AS confirmed, coalesce(min(seed) FILTER (feasible AND seed >= {CONFIRM.start}), min(seed) FILTER (feasible AND seed >= {SCAN.start} AND seed < {SCAN.stop})) AS seed"


@query(f"""WITH RECURSIVE {JUDGED}, z AS MATERIALIZED (SELECT n_illicit, {_SETS} FROM j GROUP BY n_illicit), e AS (SELECT max(n_illicit) AS most, least({LEAST}, max(n_illicit)) AS least FROM z),
b AS (SELECT least AS low, most AS high, 0 AS probes, least, most FROM e UNION ALL SELECT CASE WHEN probed > 0 THEN low ELSE m END, CASE WHEN probed > 0 THEN m ELSE high END, probes + 1, least, most FROM (SELECT *, greatest(low + 1, least(high - 1, CAST(floor(sqrt((low * high)::DOUBLE)) AS BIGINT))) AS m FROM b WHERE high - low > greatest(2, CAST(floor((most - least) * 0.01::DOUBLE) AS BIGINT))) JOIN z ON z.n_illicit = m),
l AS (SELECT greatest(least, low * 95 // 100) AS scan_from, least(most, high * 105 // 100 + 1) AS scan_to, probes FROM b ORDER BY probes DESC LIMIT 1),
f AS (SELECT z.*, l.* FROM z CROSS JOIN l WHERE n_illicit BETWEEN scan_from AND scan_to AND scanned > 0 ORDER BY n_illicit LIMIT 1)
SELECT j.n_illicit, n_total, j.seed, round(f1, 6) AS f1, round(d_f1, 6) AS d_f1, round(kl_typology, 6) AS kl_typology, round(kl_difficulty, 6) AS kl_difficulty, round(confirmed / {len(CONFIRM)}, 6) AS p_feasible, probes, scan_from, scan_to FROM j JOIN f ON f.n_illicit = j.n_illicit AND f.seed = j.seed""")
def exhaustive_search(spark, sf):
    """Bisection, ascending scan and confirmation of the smallest feasible number of illicit rows."""
    return rounded(D.exhaustive(_judged(spark, sf), PROBE, SCAN, CONFIRM, LEAST))


@query()
def constrained_search(spark, sf):
    """Rounds of trials for the smallest subset that meets five constraints."""
    return D.constrained(_judged(spark, sf), 4, 40, [*PROBE, *SCAN, *CONFIRM], LEAST)
