"""Queries: node dictionaries, and the drawn samples of the comparison designs with their estimates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import node_id
from strataweave.operators import draws as D
from strataweave.operators import graph as G
from strataweave.operators import metrics as M
from strataweave.operators import sampling as S
from strataweave.operators.dictionary import dictionary, with_node_ids
from strataweave.plans.sampling import ORACLES as SAMPLING
from strataweave.plans.sampling import SEED, TAU, ranked
from strataweave.plans.scoring import RATES
from strataweave.plans.tx import TX, rounded, tx
from strataweave.session import written

QUERIES, ORACLES = {}, {}
BINS, STRATA, N, WALKERS = 512, 10, 400, 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- dictionaries

NAMED = f"{TX}, nm AS (SELECT row_id, src_bank || '_' || src AS a, dst_bank || '_' || dst AS b FROM tx), nd AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT a AS node FROM nm UNION SELECT b FROM nm) WHERE node IS NOT NULL)"


def _named(spark, sf):
    t = tx(spark, sf)
    return t.select("row_id", node_id(F.col("src_bank"), F.col("src")).alias("src"), node_id(F.col("dst_bank"), F.col("dst")).alias("dst"))


@query(f"WITH {NAMED} SELECT node, idx FROM nd")
def node_dictionary_text(spark, sf):
    """Numbers of nodes that are strings, by their bytes."""
    return dictionary(_named(spark, sf).select(F.explode(F.array("src", "dst")).alias("node")), "node")


@query(f"WITH {NAMED} SELECT row_id, x.idx AS src_idx, y.idx AS dst_idx FROM nm LEFT JOIN nd x ON x.node = a LEFT JOIN nd y ON y.node = b")
def edges_numbered(spark, sf):
    """All edges with the numbers of both ends: the dictionary joined back twice."""
    return with_node_ids(_named(spark, sf))[0].select("row_id", "src_idx", "dst_idx")


# ---------------------------------------------------------------- strata of scores

_COST = "(b.s2 - a.s2)::DOUBLE - (b.s1 - a.s1)::DOUBLE * (b.s1 - a.s1)::DOUBLE / (b.s0 - a.s0)::DOUBLE"
_DP = "".join(f", d{m} AS MATERIALIZED (SELECT j, c, list_append(st, i) AS st FROM (SELECT cs.j, cs.i, d.c + cs.cost AS c, d.st FROM cs JOIN d{m - 1} d ON d.j = cs.i - 1) QUALIFY row_number() OVER (PARTITION BY j ORDER BY c, i) = 1)" for m in range(2, STRATA + 1))
KMEANS = f"""{TX}, bn AS MATERIALIZED (SELECT *, greatest(0, least(CAST(floor(p * {BINS}) AS INTEGER), {BINS - 1})) AS bin FROM tx WHERE p IS NOT NULL), hb AS (SELECT bin, count(*) AS n FROM bn GROUP BY bin),
hx AS MATERIALIZED (SELECT row_number() OVER w AS j, bin, sum(n) OVER w AS s0, sum(n * bin) OVER w AS s1, sum(n * bin * bin) OVER w AS s2 FROM hb WINDOW w AS (ORDER BY bin)), pz AS (SELECT j, s0, s1, s2 FROM hx UNION ALL SELECT 0, 0, 0, 0),
cs AS MATERIALIZED (SELECT a.j + 1 AS i, b.j AS j, {_COST} AS cost FROM pz a JOIN pz b ON a.j < b.j), d1 AS MATERIALIZED (SELECT j, cost AS c, [i] AS st FROM cs WHERE i = 1){_DP},
ct AS (SELECT list(bin) AS cuts FROM hx WHERE list_contains((SELECT st FROM d{STRATA} ORDER BY j DESC LIMIT 1), j)), sk AS MATERIALIZED (SELECT bn.*, CAST(len(list_filter(cuts, lambda c: c <= bin)) AS INTEGER) AS stratum FROM bn CROSS JOIN ct),
g AS (SELECT stratum, count(*) AS pool, count(*) FILTER ((p >= 0.5) = (label = 1)) / count(*) AS q FROM sk GROUP BY stratum), gs AS (SELECT stratum, pool, greatest(sqrt(q * (1 - q)), 1e-8) AS s FROM g),
ga AS (SELECT *, greatest(1, round_even({N} * pool * s / sum(pool * s) OVER (), 0))::BIGINT AS n0 FROM gs),
nz AS MATERIALIZED (SELECT stratum, pool, s, least(pool, CASE WHEN row_number() OVER (ORDER BY pool DESC, stratum) = 1 THEN greatest(1, n0 + {N} - sum(n0) OVER ()) ELSE n0 END)::BIGINT AS take FROM ga),
sm AS (SELECT r.row_id, r.stratum, r.label, r.p, nz.pool / nz.take AS weight FROM {ranked('sk', 'stratum')} r JOIN nz USING (stratum) WHERE r.rk <= nz.take)"""


@query(f"WITH {KMEANS} SELECT stratum, pool, round(s, 6) AS s, take FROM nz")
def b5_kmeans_sizes(spark, sf):
    """Neyman sizes over exact k-means strata of the score."""
    st = written(D.score_strata(tx(spark, sf), STRATA, bins=BINS), "strata")
    return rounded(D.neyman_sizes(st, N, (F.col("p") >= 0.5) == (F.col("label") == 1)))


def _b5(spark, sf):
    return D.neyman_sample(tx(spark, sf), N, SEED, STRATA)


@query(f"WITH {KMEANS} SELECT row_id, stratum, round(weight, 6) AS weight FROM sm")
def b5_kmeans_sample(spark, sf):
    return rounded(_b5(spark, sf).select("row_id", "stratum", "weight"))


def _estimate_sql(rows: str) -> str:
    cell = lambda y, sign: f"coalesce(sum(weight) FILTER (label = {y} AND p {sign} {TAU}), 0)"
    return f"SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {RATES} FROM (SELECT {cell(1, '>=')} AS tp, {cell(0, '>=')} AS fp, {cell(1, '<')} AS fn, {cell(0, '<')} AS tn FROM {rows}))"


def _estimate(sample):
    got = M.prf(sample.withColumn("pred", (F.col("p") >= TAU).cast("int")), weight="weight")
    return rounded(got.select("precision", "recall", "f1"))


@query(f"WITH {KMEANS} {_estimate_sql('sm')}")
def b5_kmeans_estimate(spark, sf):
    """What the drawn rows and their weights say of all rows."""
    return _estimate(_b5(spark, sf))


ATTRIBUTE = f"""{TX}, ag AS (SELECT payment_format, count(*) AS pool FROM tx GROUP BY ALL), ao AS (SELECT *, row_number() OVER (ORDER BY pool DESC, payment_format) AS i, least(pool, greatest(1, round_even({N} * pool / sum(pool) OVER (), 0))::BIGINT) AS w, count(*) OVER () AS k FROM ag),
ar AS (SELECT *, greatest({N} - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest FROM ao), aw AS (SELECT payment_format, pool, CAST(CASE WHEN i = k THEN least(rest, pool) ELSE least(w, rest) END AS BIGINT) AS take FROM ar),
sm AS (SELECT r.row_id, r.payment_format, r.label, r.p, aw.pool / aw.take AS weight FROM {ranked('tx', 'payment_format')} r JOIN aw USING (payment_format) WHERE r.rk <= aw.take)"""


@query(f"WITH {ATTRIBUTE} SELECT row_id, payment_format, round(weight, 6) AS weight FROM sm")
def b7_attribute_sample(spark, sf):
    return rounded(D.attribute_sample(tx(spark, sf), "payment_format", N, SEED).select("row_id", "payment_format", "weight"))


@query(f"WITH {ATTRIBUTE} {_estimate_sql('sm')}")
def b7_attribute_estimate(spark, sf):
    return _estimate(D.attribute_sample(tx(spark, sf), "payment_format", N, SEED))


# ---------------------------------------------------------------- walks


def _number_sql(what: str, step: str, walker: str) -> str:
    return f"CAST(('0x' || substr(md5('{SEED}|{what}|' || {step} || '|' || {walker}), 1, 12)) AS BIGINT)"


def _walk_sql(aims: str, away: str, steps: int) -> str:
    """Positions of all walkers from inc (node, row_id, side, other); ``aims`` selects the nodes to jump to."""
    here = lambda what: _number_sql(what, "(s.step + 1)", "s.walker")
    jump = f"({away.format(n='(s.step + 1)', home=here('home'))} OR dg.degree IS NULL)"
    return f"""nr AS MATERIALIZED (SELECT node, row_id, other, row_number() OVER (PARTITION BY node ORDER BY row_id, side) - 1 AS i FROM inc), dg AS MATERIALIZED (SELECT node, count(*) AS degree FROM inc GROUP BY node),
am AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx, count(*) OVER () AS m FROM ({aims})), mm AS (SELECT max(m) AS m FROM am),
s(walker, node, row_id, step) AS (SELECT w, node, NULL::BIGINT, 0 FROM range({WALKERS}) r(w) CROSS JOIN mm JOIN am ON idx = {_number_sql('jump', '0', 'w')} % mm.m
UNION ALL SELECT s.walker, CASE WHEN {jump} THEN am.node ELSE nr.other END, CASE WHEN {jump} THEN NULL ELSE nr.row_id END, s.step + 1 FROM s CROSS JOIN mm LEFT JOIN dg ON dg.node = s.node
LEFT JOIN nr ON nr.node = s.node AND nr.i = {here('move')} % dg.degree LEFT JOIN am ON am.idx = {here('jump')} % mm.m WHERE s.step < {steps})"""


EDGE_WALK = _walk_sql("SELECT DISTINCT node FROM inc", "{home} % 1073741824 < " + str(int(0.15 * (1 << 30))), 60)


@query(f"""WITH RECURSIVE {TX}, inc AS (SELECT src AS node, row_id, 0 AS side, dst AS other FROM tx UNION ALL SELECT dst, row_id, 1, src FROM tx WHERE src <> dst), {EDGE_WALK},
fv AS (SELECT row_id, min(step * 1000000 + walker) AS o FROM s WHERE row_id IS NOT NULL GROUP BY row_id ORDER BY o LIMIT {N}) SELECT row_id, CAST(o // 1000000 AS INTEGER) AS step, CAST(o % 1000000 AS BIGINT) AS walker FROM fv""")
def b6_walk_sample(spark, sf):
    """Edges in the order in which a hundred walkers first cross them."""
    return D.walk_sample(tx(spark, sf), N, SEED, WALKERS).select("row_id", "step", "walker")


# ---------------------------------------------------------------- samples of nodes: rows of the table, linked along accounts

MONTH = 30 * 86_400
NODES = f"""{TX}, ne AS MATERIALIZED (SELECT row_id * 2 + is_sender AS id, prev AS src, row_id AS dst FROM (SELECT *, lag(row_id) OVER (PARTITION BY account, epoch_s // {MONTH} ORDER BY row_id, is_sender) AS prev
FROM (SELECT row_id, epoch_s, src AS account, 1 AS is_sender FROM tx UNION ALL SELECT row_id, epoch_s, dst, 0 FROM tx)) WHERE prev <> row_id),
inc AS MATERIALIZED (SELECT src AS node, id AS row_id, 0 AS side, dst AS other FROM ne UNION ALL SELECT dst, id, 1, src FROM ne),
no AS MATERIALIZED (SELECT tx.row_id AS node, label, p, row_id % 49 + 1 AS step, coalesce(degree, 0) AS degree FROM tx LEFT JOIN (SELECT node, count(*) AS degree FROM inc GROUP BY node) i ON i.node = tx.row_id), be AS (SELECT * FROM no WHERE label = 0)"""


def _node_edges(spark, sf):
    """Each row to the next one of each of its accounts in the month."""
    t = tx(spark, sf)
    ends = G.both_ends(t).join(t.select("row_id", F.floor(F.col("epoch_s") / MONTH).alias("month")), "row_id")
    before = F.lag("row_id").over(Window.partitionBy("account", "month").orderBy("row_id", "is_sender"))
    near = ends.withColumn("src", before).where("src != row_id")
    return written(near.select((F.col("row_id") * 2 + F.col("is_sender")).alias("row_id"), "src", F.col("row_id").alias("dst")), "links")


def _nodes(spark, sf, links=None):
    t = tx(spark, sf).select(F.col("row_id").alias("node"), "label", "p", (F.col("row_id") % 49 + 1).alias("step"))
    if links is None:
        return t
    degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return t.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


@query(f"WITH {NODES}, z AS (SELECT step, count(*) AS pool, least(count(*), greatest(1, round_even({N} * count(*) / sum(count(*)) OVER (), 0)))::BIGINT AS take FROM be GROUP BY step), k AS (SELECT *, least(take, {N} - coalesce(sum(take) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS kept FROM z) SELECT node, r.step, round(k.pool / k.take, 6) AS weight FROM {ranked('be', 'step', key='node')} r JOIN k USING (step) WHERE rk <= kept")
def nodes_by_time(spark, sf):
    """Benign nodes by time step in proportion, cut from the last step."""
    return rounded(D.node_time_sample(_nodes(spark, sf).where("label = 0"), N, SEED).select("node", "step", "weight"))


@query(f"WITH {NODES}, q AS (SELECT quantile_cont(degree, 0.33) AS q1, quantile_cont(degree, 0.67) AS q2 FROM be), b AS (SELECT be.*, CASE WHEN degree < q1 THEN 1 WHEN degree < q2 THEN 2 ELSE 3 END AS tercile FROM be CROSS JOIN q) SELECT node, tercile, round(pool / least(pool, {N // 3}), 6) AS weight FROM {ranked('b', 'tercile', key='node')} WHERE rk <= {N // 3}")
def nodes_by_degree(spark, sf):
    links = _node_edges(spark, sf)
    return rounded(D.node_degree_sample(_nodes(spark, sf, links).where("label = 0"), N, SEED).select("node", "tercile", "weight"))


NODE_WALK = _walk_sql(f"SELECT node FROM no WHERE label = 1 ORDER BY md5('{SEED}|' || node) LIMIT 64", "{n} % 51 = 0", 80)


@query(f"""WITH RECURSIVE {NODES}, {NODE_WALK}, fv AS (SELECT s.node, min(s.step * 1000000 + walker) AS o FROM s JOIN be ON be.node = s.node WHERE row_id IS NOT NULL GROUP BY s.node ORDER BY o LIMIT {N}),
tp AS (SELECT node FROM be WHERE node NOT IN (SELECT node FROM fv) ORDER BY md5('{SEED}|top|' || node) LIMIT greatest(0, {N} - (SELECT count(*) FROM fv))), al AS (SELECT node, CAST(o // 1000000 AS INTEGER) AS step, CAST(o % 1000000 AS BIGINT) AS walker FROM fv UNION ALL SELECT node, NULL, NULL FROM tp)
SELECT *, round((SELECT count(*) FROM be) / (SELECT count(*) FROM al), 6) AS weight FROM al""")
def nodes_by_walk(spark, sf):
    """Benign nodes in the order in which walks from illicit ones meet them."""
    return rounded(D.node_walk_sample(_nodes(spark, sf), _node_edges(spark, sf), N, SEED, walkers=WALKERS))


@query(SAMPLING["benign_budget_sample"].replace("1 - 2 * abs(p - 0.5) AS difficulty", "p AS difficulty").replace("FROM t), q AS", "FROM tx), q AS"))
def nodes_by_score(spark, sf):
    """Hard nodes and terciles of the score itself, with spill-over and fill; weights of what was taken."""
    st = S.stratify(_nodes(spark, sf).withColumnRenamed("node", "row_id"), TAU, "p")
    s = S.with_census(st.where("label = 1"), S.benign_sample(st, 200, SEED))
    return rounded(s.groupBy("stratum").agg(F.count("*").alias("taken"), F.max("pool").alias("pool"), F.max("n").alias("n"), F.sum("weight").alias("sum_w")))
