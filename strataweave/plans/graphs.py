"""Queries: graph features, line graph, neighbourhoods, rendering, routing, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import parsing as P
from strataweave.operators import cases as C
from strataweave.operators import graph as G
from strataweave.operators import metrics as M
from strataweave.operators import render as R
from strataweave.operators import routing as U
from strataweave.operators.knn import knn_graph
from strataweave.plans.scoring import confusion_sql, grid_sql
from strataweave.plans.tx import TX, VERDICTS, read, rounded, test_part, tx, verdicts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ENDS = f"{TX}, en AS (SELECT row_id, src AS account, 1 AS is_sender FROM t UNION ALL SELECT row_id, dst, 0 FROM t)"
LINE = f"""{ENDS}, o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY row_id, is_sender) AS i FROM en),
pr AS (SELECT x.row_id AS a, y.row_id AS b, ln(1 + (y.i - x.i)) AS delta, x.is_sender AS s_a, y.is_sender AS s_b FROM o x JOIN o y ON x.account = y.account AND y.i - x.i BETWEEN 1 AND 5 AND x.row_id <> y.row_id),
lg AS (SELECT * FROM pr UNION ALL SELECT b, a, delta, s_b, s_a FROM pr)"""


@query(f"WITH {LINE} SELECT a, b, round(delta, 6) AS delta, s_a, s_b FROM lg")
def line_graph_k(spark, sf):
    return rounded(G.line_graph(test_part(spark, sf)))


@query(f"WITH {LINE} SELECT b AS row_id, round(avg(delta), 6) AS mean_delta, round(avg(s_a), 6) AS mean_s_a, round(avg(s_b), 6) AS mean_s_b, round(ln(1 + count(*)), 6) AS log_degree, round(min(delta), 6) AS min_delta FROM lg GROUP BY b")
def line_graph_features(spark, sf):
    return rounded(G.line_graph_features(G.line_graph(test_part(spark, sf))))


@query(f"WITH {ENDS}, d AS (SELECT account AS node, count(*) AS degree FROM en GROUP BY account), q AS (SELECT quantile_cont(degree, 0.33) AS q1, quantile_cont(degree, 0.67) AS q2 FROM d) SELECT node, degree, CASE WHEN degree < q1 THEN 1 WHEN degree < q2 THEN 2 ELSE 3 END AS tercile FROM d CROSS JOIN q")
def degree_terciles(spark, sf):
    from strataweave.operators.sampling import quantile_cuts, tercile

    d = G.degrees(test_part(spark, sf))
    return d.crossJoin(F.broadcast(quantile_cuts(d, "degree"))).select("node", "degree", tercile(F.col("degree"), F.col("cuts")).alias("tercile"))  # one row


def _cases(spark, sf):
    """Each illicit test row is a case whose seeds are its two accounts."""
    t = test_part(spark, sf).where("label = 1")
    return t.select(F.col("row_id").alias("case_id"), F.explode(F.array("src", "dst")).alias("node"))


CAP = 3
HOP = """{near} WHERE (case_id, other) NOT IN (SELECT case_id, node FROM {seen}) QUALIFY row_number() OVER (PARTITION BY case_id, f.node ORDER BY md5('42|' || case_id || '|' || f.node || '|' || other)) <= 3"""
KHOP = f"""{TX}, nb AS (SELECT DISTINCT src AS node, dst AS other FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst),
s0 AS (SELECT DISTINCT row_id AS case_id, unnest([src, dst]) AS node, 0 AS hop FROM t WHERE label = 1),
f1 AS (SELECT DISTINCT case_id, other AS node, 1 AS hop FROM (SELECT case_id, other FROM s0 f JOIN nb USING (node) WHERE (case_id, other) NOT IN (SELECT (case_id, node) FROM s0) QUALIFY row_number() OVER (PARTITION BY case_id, node ORDER BY md5('42|' || case_id || '|' || node || '|' || other)) <= {CAP})),
s1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM f1),
f2 AS (SELECT DISTINCT case_id, other AS node, 2 AS hop FROM (SELECT case_id, other FROM f1 f JOIN nb USING (node) WHERE (case_id, other) NOT IN (SELECT (case_id, node) FROM s1) QUALIFY row_number() OVER (PARTITION BY case_id, node ORDER BY md5('42|' || case_id || '|' || node || '|' || other)) <= {CAP})),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM f2)"""
MEMBERS = f"{KHOP}, m AS (SELECT x.case_id, t.* FROM t JOIN s2 x ON t.src = x.node JOIN s2 y ON t.dst = y.node AND x.case_id = y.case_id)"


def _khop(spark, sf):
    return G.k_hop(_cases(spark, sf), test_part(spark, sf), 2, CAP)


def _members(spark, sf, *columns):
    return G.induced(_khop(spark, sf), test_part(spark, sf), *columns)


@query(f"WITH {KHOP} SELECT case_id, node, hop FROM s2")
def khop2_capped(spark, sf):
    return _khop(spark, sf)


@query(f"WITH {MEMBERS} SELECT case_id, row_id, src, dst FROM m")
def induced_subgraph(spark, sf):
    return _members(spark, sf, "row_id", "src", "dst")


@query(f"""WITH {MEMBERS}, i AS (SELECT case_id, dst AS node, count(*) AS n FROM m GROUP BY case_id, dst QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, dst) = 1), o AS (SELECT case_id, src AS node, count(*) AS n FROM m GROUP BY case_id, src QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, src) = 1),
a AS (SELECT case_id, count(DISTINCT node) AS accounts FROM (SELECT case_id, unnest([src, dst]) AS node FROM m) GROUP BY ALL)
SELECT case_id, count(*) AS n, round(sum(amount), 4) AS volume, round(avg(amount), 4) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount, max(epoch_s) - min(epoch_s) AS elapsed_s, any_value(accounts) AS accounts, any_value(i.n) AS max_in, any_value(i.node) AS max_in_node, any_value(o.n) AS max_out, any_value(o.node) AS max_out_node
FROM m JOIN a USING (case_id) JOIN i USING (case_id) JOIN o USING (case_id) GROUP BY case_id""")
def case_stats(spark, sf):
    return rounded(G.case_stats(_members(spark, sf)), 4)


@query(f"WITH {MEMBERS} SELECT case_id, row_id, row_id = case_id OR row_number() OVER (PARTITION BY case_id ORDER BY row_id = case_id, epoch_s, row_id) <= 4 AS kept FROM m")
def target_preserve(spark, sf):
    m = _members(spark, sf).withColumn("is_target", F.col("row_id") == F.col("case_id"))
    return G.with_target(m, 5).select("case_id", "row_id", "kept")


LINE_SQL = "printf('%d -> %d | %s | %.2f | %s', src, dst, strftime(ts, '%Y/%m/%d %H:%M'), amount, payment_format)"
TEXT_SQL = f"""SELECT case_id, count(*) AS n, (SELECT string_agg('account ' || node, chr(10) ORDER BY node) FROM (SELECT DISTINCT unnest([src, dst]) AS node FROM {{m}} z WHERE z.case_id = q.case_id)) || chr(10) || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY epoch_s, row_id) || chr(10) || chr(10) || printf('transfers: %d', count(*)) || chr(10) || printf('volume: %.2f', sum(amount)) AS text FROM {{m}} q GROUP BY case_id"""


@query(f"WITH {MEMBERS} " + TEXT_SQL.format(m="m"))
def typed_graph_text(spark, sf):
    return R.rendered(_members(spark, sf))


@query(f"WITH {MEMBERS}, k AS (SELECT * FROM m QUALIFY row_id = case_id OR row_number() OVER (PARTITION BY case_id ORDER BY row_id = case_id, epoch_s, row_id) <= 4) " + TEXT_SQL.format(m="k"))
def targeted_graph_text(spark, sf):
    """Cases cut to a budget that always keeps their target."""
    m = _members(spark, sf).withColumn("is_target", F.col("row_id") == F.col("case_id"))
    return R.rendered(G.with_target(m, 5).where("kept"))


def _recovered(members):
    """The transfers read back from rendered texts, with how often each stands there."""
    back = R.recovered(R.rendered(members)).select("case_id", "src", "dst", F.round("amount", 2).alias("amount"))
    return back.groupBy("case_id", "src", "dst", "amount").agg(F.count("*").alias("n"))


@query(f"WITH {MEMBERS} SELECT case_id, src, dst, printf('%.2f', amount)::DOUBLE AS amount, count(*) AS n FROM m GROUP BY ALL")
def text_recovery(spark, sf):
    """Rendered lines read back are the transactions that were rendered."""
    return _recovered(_members(spark, sf))


# The cases above follow their SQL: a cap of 3 in the graph of the test part. Those below walk the graph of all edges with the
# reference's cap, from the same seeds, and keep the case's own number of edges where no budget is given.
FULL_CAP = 50
FULL_KHOP = KHOP.replace("FROM t WHERE src <> dst", "FROM tx WHERE src <> dst").replace(f"<= {CAP})", f"<= {FULL_CAP})")
FULL_MEMBERS = MEMBERS.replace(KHOP, FULL_KHOP).replace("t.* FROM t JOIN s2 x ON t.src = x.node JOIN s2 y ON t.dst", "tx.* FROM tx JOIN s2 x ON tx.src = x.node JOIN s2 y ON tx.dst")


def _full_khop(spark, sf):
    return G.k_hop(_cases(spark, sf), tx(spark, sf), 2, FULL_CAP)


def _full_members(spark, sf, *columns):
    return G.induced(_full_khop(spark, sf), tx(spark, sf).select("row_id", "src", "dst"), *columns)


def _full_parts(spark, sf, *columns):
    """The whole cases in parts, their edges with further columns."""
    return C.parted(_full_khop(spark, sf), tx(spark, sf).select("row_id", "src", "dst", "amount", "epoch_s", *columns))


def _text_parts(spark, sf):
    return _full_parts(spark, sf, "ts", "payment_format")


@query(f"WITH {FULL_KHOP} SELECT case_id, node, hop FROM s2")
def khop2_full(spark, sf):
    return _full_khop(spark, sf)


@query(ORACLES["induced_subgraph"].replace(MEMBERS, FULL_MEMBERS))
def induced_full(spark, sf):
    return _full_members(spark, sf)


@query(ORACLES["case_stats"].replace(MEMBERS, FULL_MEMBERS))
def case_stats_full(spark, sf):
    return rounded(C.induced_stats(_full_khop(spark, sf), tx(spark, sf)), 4)


@query(f"WITH {FULL_MEMBERS} SELECT case_id, row_id, true AS kept FROM m")
def target_preserve_full(spark, sf):
    m = _full_members(spark, sf, "row_id").withColumn("is_target", F.col("row_id") == F.col("case_id"))
    return G.with_target(m).select("case_id", "row_id", "kept")


@query(ORACLES["typed_graph_text"].replace(MEMBERS, FULL_MEMBERS))
def typed_graph_text_full(spark, sf):
    return R.rendered_parts(*_text_parts(spark, sf))


@query(ORACLES["typed_graph_text"].replace(MEMBERS, FULL_MEMBERS))
def targeted_graph_text_full(spark, sf):
    """Without a budget a case keeps its number of rows, its target among them."""
    return R.rendered_parts(*_text_parts(spark, sf))


@query(ORACLES["text_recovery"].replace(MEMBERS, FULL_MEMBERS))
def text_recovery_full(spark, sf):
    return R.recovered_parts(*_text_parts(spark, sf))


@query(f"WITH {TX}, l AS (SELECT payment_format, count(*) AS left_n FROM tx WHERE row_id % 3 = 0 GROUP BY ALL), r AS (SELECT payment_format, count(*) AS right_n FROM tx WHERE row_id % 3 = 1 GROUP BY ALL) SELECT payment_format, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n FROM l FULL JOIN r USING (payment_format) WHERE coalesce(left_n, 0) <> coalesce(right_n, 0)")
def multiset_diff(spark, sf):
    t = tx(spark, sf)
    side = lambda i: t.where(F.col("row_id") % 3 == i).select("payment_format")
    return R.multiset_difference(side(0), side(1))


@query(f"WITH {TX}, l AS (SELECT src_bank AS bank, count(*) AS left_n FROM tx GROUP BY ALL), r AS (SELECT dst_bank AS bank, count(*) AS right_n FROM tx GROUP BY ALL) SELECT bank, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n FROM l FULL JOIN r USING (bank) WHERE coalesce(left_n, 0) <> coalesce(right_n, 0)")
def multiset_diff_full(spark, sf):
    """Banks that send and receive unequally often; each row is on both sides."""
    t = tx(spark, sf)
    return R.multiset_difference(t.select(F.col("src_bank").alias("bank")), t.select(F.col("dst_bank").alias("bank")))


TRAIL = "count(*) OVER w AS degree, CAST(len(list_distinct(list({other}) OVER w)) AS BIGINT) AS fan, round(sum(amount) OVER w, 4) AS sum_amount, round(avg(amount) OVER w, 4) AS mean_amount, round(var_pop(amount) OVER w, 7) AS var_amount, max(amount) OVER w AS max_amount FROM t WINDOW w AS (PARTITION BY {key} ORDER BY epoch_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"


@query(f"WITH {TX} SELECT row_id, src AS account, " + TRAIL.format(key="src", other="dst"))
def vertex_stats_1d(spark, sf):
    return G.trailing(test_part(spark, sf), "src").withColumns({c: F.round(c, d) for c, d in (("sum_amount", 4), ("mean_amount", 4), ("var_amount", 7))})


@query(f"WITH {TX}, f AS (SELECT row_id, dst AS account, " + TRAIL.format(key="dst", other="src") + ") SELECT row_id, account, degree, fan FROM f")
def fan_degree_1d(spark, sf):
    return G.trailing(test_part(spark, sf), "dst").select("row_id", "account", "degree", "fan")


# Means are those of the rounded sums: of 8 or 16 amounts the last digit is often a tie, which the order of addition would decide.
FULL_TRAIL = TRAIL.replace("FROM t WINDOW", "FROM tx WINDOW").replace("round(avg(amount) OVER w, 4)", "round(sum(amount) OVER w, 4) / count(*) OVER w")


@query(f"WITH {TX} SELECT row_id, src AS account, " + FULL_TRAIL.format(key="src", other="dst"))
def vertex_stats_1d_full(spark, sf):
    """Over all rows, so that a test row's day holds the rows of the other parts."""
    rows = G.trailing(tx(spark, sf), "src").withColumns({c: F.round(c, d) for c, d in (("sum_amount", 4), ("var_amount", 7))})
    return rows.withColumn("mean_amount", F.col("sum_amount") / F.col("degree"))


@query(f"WITH {TX}, f AS (SELECT row_id, dst AS account, " + FULL_TRAIL.format(key="dst", other="src") + ") SELECT row_id, account, degree, fan FROM f")
def fan_degree_1d_full(spark, sf):
    return G.trailing(tx(spark, sf), "dst").select("row_id", "account", "degree", "fan")


BINS = (2, 4, 8, 16, 32)


@query(f"WITH {TX}, f AS (SELECT row_id, dst AS account, " + FULL_TRAIL.format(key="dst", other="src") + f"), b AS (SELECT {' + '.join(f'(degree >= {e})::INT' for e in BINS)} AS degree_bin, {' + '.join(f'(fan >= {e})::INT' for e in BINS)} AS fan_bin FROM f) SELECT degree_bin, fan_bin, count(*) AS n FROM b GROUP BY ALL")
def fan_degree_bins(spark, sf):
    """How many rows have a receiver of each bin of degree and fan."""
    f = G.trailing(tx(spark, sf), "dst")
    return f.groupBy(G.binned(F.col("degree"), BINS).alias("degree_bin"), G.binned(F.col("fan"), BINS).alias("fan_bin")).agg(F.count("*").alias("n"))


def _moments_sql(key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY epoch_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"
    return f"""WITH {TX}, m AS (SELECT row_id, {key} AS account, amount, epoch_s, list(amount) {w} AS l, avg(epoch_s) {w} AS mt, stddev_pop(epoch_s) {w} AS st FROM tx),
c AS (SELECT *, list_avg(l) AS mean, list_avg(list_transform(l, lambda x: (x - list_avg(l)) ** 2)) AS m2, list_avg(list_transform(l, lambda x: (x - list_avg(l)) ** 3)) AS m3, list_avg(list_transform(l, lambda x: (x - list_avg(l)) ** 4)) AS m4 FROM m)
SELECT row_id, account, round(CASE WHEN m2 > 1e-18 THEN m3 / m2 ** 1.5 ELSE 0 END, 3) + 0::DOUBLE AS skewness, round(CASE WHEN m2 > 1e-18 THEN m4 / m2 ** 2 - 3 ELSE 0 END, 3) + 0::DOUBLE AS kurtosis, round(epoch_s - mt, 3) + 0::DOUBLE AS mean_age_s, round(st, 2) + 0::DOUBLE AS sd_time_s, round(coalesce(amount / nullif(mean, 0), 0), 5) + 0::DOUBLE AS ratio FROM c"""


def _moments(key: str):
    @query(_moments_sql(key))
    def run(spark, sf):
        m = G.vertex_moments(tx(spark, sf), key)
        return m.withColumns({c: F.round(c, d) + 0.0 for c, d in (("skewness", 3), ("kurtosis", 3), ("mean_age_s", 3), ("sd_time_s", 2), ("ratio", 5))})

    name = f"vertex_moments_{'sender' if key == 'src' else 'receiver'}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")
    QUERIES[name].__doc__ = "Higher moments of amounts and times over each account's day, all rows."


for _key in ("src", "dst"):
    _moments(_key)


@query(f"WITH {TX} SELECT a.src AS source, b.dst AS target, count(DISTINCT a.dst) AS n_mid FROM tx a JOIN tx b ON a.dst = b.src AND b.epoch_s - a.epoch_s BETWEEN 0 AND 21600 WHERE a.src <> b.dst AND a.dst <> a.src AND a.dst <> b.dst GROUP BY ALL HAVING n_mid >= 2")
def scatter_gather_6h(spark, sf):
    return G.scatter_gather(tx(spark, sf))


@query(f"WITH {TX} SELECT a.row_id AS e1, b.row_id AS e2, c.row_id AS e3 FROM tx a JOIN tx b ON a.dst = b.src AND b.epoch_s > a.epoch_s AND b.epoch_s - a.epoch_s <= 86400 JOIN tx c ON c.src = b.dst AND c.dst = a.src AND c.epoch_s > b.epoch_s AND c.epoch_s - a.epoch_s <= 86400 WHERE a.src <> b.dst AND a.src <> a.dst AND b.src <> b.dst")
def temporal_cycle_3(spark, sf):
    return G.temporal_cycles(tx(spark, sf))


@query("WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT vec_id, neighbour, round(similarity, 5) AS similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank FROM p QUALIFY rank <= 5")
def knn_cosine_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    return rounded(G.cosine_top_k(v, v.where("vec_id % 100 = 0")), 5)


@query("WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5), e AS (SELECT src, dst, similarity FROM k UNION ALL SELECT dst, src, similarity FROM k) SELECT src, dst, round(max(similarity), 5) AS similarity, count(*) AS times FROM e GROUP BY src, dst")
def knn_graph_symmetric(spark, sf):
    """The five nearest of every row, in both directions."""
    return rounded(knn_graph(read(spark, sf, "embeddings")), 5)


# ---------------------------------------------------------------- routing

TAU = 0.6
ROUTE = f"{TX}, {VERDICTS}, x AS (SELECT *, CASE WHEN p >= {TAU} THEN 1 ELSE 0 END AS ml, CASE WHEN row_id % 3 = 0 THEN 3.0 ELSE 1.0 END AS w FROM v)"
RULES = {"dt": "w <= 1.01 AND ml = 0", "confidence": f"w <= 1.01 AND abs(p - {TAU}) < 0.1", "disagree": "w <= 1.01 AND ml <> pred", "union": f"w <= 1.01 AND (ml = 0 OR abs(p - {TAU}) < 0.1)"}


def _routing(spark, sf):
    return verdicts(test_part(spark, sf)).withColumns({"ml": (F.col("p") >= TAU).cast("int"), "w": F.when(F.col("row_id") % 3 == 0, 3.0).otherwise(1.0)})


def _rule(rule: str, cond: str):
    def run(spark, sf):
        x = _routing(spark, sf)
        asked = U.consults(rule, F.col("w"), F.col("ml"), F.col("p"), TAU, F.col("pred"))
        pred, route = U.routed(asked, F.col("ml"), F.col("pred"))
        x = x.withColumn("route", route).withColumn("pred", pred)
        return M.prf(x, ["model", "run", "route"], weight="w").select("model", "run", "route", "tp", "fp", "fn", "tn")

    run.__name__, run.__doc__ = f"dt_{'routing' if rule == 'dt' else rule}", f"Routes and weighted confusion of the rule {rule}."
    cells = ", ".join(f"coalesce(sum(w) FILTER (label = {y} AND final = {p}), 0.0) AS {n}" for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    query(f"WITH {ROUTE}, r AS (SELECT *, CASE WHEN {cond} THEN pred ELSE ml END AS final, CASE WHEN {cond} THEN CASE WHEN pred = 1 THEN 'llm_flipped' ELSE 'llm_legit' END WHEN ml = 1 THEN 'ml_illicit' ELSE 'ml_legit' END AS route FROM x) SELECT model, run, route, {cells} FROM r GROUP BY model, run, route")(run)


for _name, _cond in RULES.items():
    _rule(_name, _cond)


def _gate_sql(kind: str) -> str:
    grid, flip = (U.RECALL_GATES, f"tau <= p AND p < {TAU} AND pred = 1") if kind == "recall" else (U.PRECISION_GATES, f"{TAU} <= p AND p < tau AND pred = 0")
    asked = f"tau <= p AND p < {TAU}" if kind == "recall" else f"{TAU} <= p AND p < tau"
    return f"WITH {ROUTE}, g AS (SELECT x.*, threshold AS tau, CASE WHEN {asked.replace('tau', 'threshold')} THEN 1 ELSE 0 END AS a, CASE WHEN {flip.replace('tau', 'threshold')} THEN 1 - ml ELSE ml END AS final FROM x CROSS JOIN {grid_sql(grid)}), h AS (SELECT model, run, tau, CAST(sum(a) AS BIGINT) AS consulted, coalesce(sum(w) FILTER (label = 1 AND final = 1), 0) AS tp, coalesce(sum(w) FILTER (label = 0 AND final = 1), 0) AS fp, coalesce(sum(w) FILTER (label = 1 AND final = 0), 0) AS fn FROM g GROUP BY ALL) SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM h"


@query(_gate_sql("recall"))
def recall_gate_sweep(spark, sf):
    return U.gate_sweep(_routing(spark, sf), "recall", U.RECALL_GATES, TAU, ["model", "run"], weight=F.col("w"))


@query(_gate_sql("precision"))
def precision_gate_sweep(spark, sf):
    return U.gate_sweep(_routing(spark, sf), "precision", U.PRECISION_GATES, TAU, ["model", "run"], weight=F.col("w"))


_ALONE = lambda c: f"coalesce(2 * sum(w) FILTER (label = 1 AND {c} = 1) / nullif(sum(w * label) + coalesce(sum(w) FILTER ({c} = 1), 0), 0), 0)"


@query(f"""WITH sw AS (SELECT 'recall' AS gate, * FROM ({_gate_sql('recall')}) UNION ALL SELECT 'precision' AS gate, * FROM ({_gate_sql('precision')})), be AS (SELECT model, run, gate, arg_min(tau, (-f1, tau)) AS tau, max(f1) AS f1, arg_min(consulted, (-f1, tau)) AS asked FROM sw GROUP BY ALL),
ba AS (WITH {ROUTE} SELECT model, run, count(*) AS n, {_ALONE('ml')} AS ml_f1, {_ALONE('pred')} AS other_f1 FROM x GROUP BY ALL) SELECT model, run, gate, tau, round(f1, 6) AS f1, round(asked / n, 6) AS consulted, round(ml_f1, 6) AS ml_f1, round(other_f1, 6) AS other_f1, round(f1 - ml_f1, 6) AS delta FROM be JOIN ba USING (model, run)""")
def best_gate(spark, sf):
    """The best gate of either kind, with its gain over the first scorer alone and the share of rows that it asks about."""
    sweeps = {"recall": recall_gate_sweep(spark, sf), "precision": precision_gate_sweep(spark, sf)}
    return rounded(U.gate_summary(sweeps, _routing(spark, sf), ["model", "run"], "w"))


@query(f"WITH {ROUTE} SELECT model, run, row_id, greatest(ml, pred) AS either, least(ml, pred) AS both, CASE WHEN p >= 0.5 AND p < 0.7 THEN pred ELSE ml END AS gate, CASE WHEN p >= 0.7 OR (p >= 0.5 AND pred = 1) THEN 1 ELSE 0 END AS doubt FROM x")
def fusion_or_and_band(spark, sf):
    x = _routing(spark, sf)
    return x.select("model", "run", "row_id", *[c.alias(n) for n, c in U.fused(F.col("p"), TAU, F.col("pred")).items()])


# ---------------------------------------------------------------- tables


@query("SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, min(greatest(1, length(text) // 4)) AS least, max(greatest(1, length(text) // 4)) AS most, round(avg(greatest(1, length(text) // 4)), 6) AS mean, median(greatest(1, length(text) // 4)) AS middle FROM documents GROUP BY source")
def token_estimate(spark, sf):
    t = P.approx_tokens(F.col("text"))
    # the buffer of a median counts distinct numbers, not rows
    return rounded(read(spark, sf, "documents").groupBy("source").agg(F.sum(t).alias("tokens"), F.min(t).alias("least"), F.max(t).alias("most"), F.avg(t).alias("mean"), F.median(t).alias("middle")))


LEVELS = (10, 20, 30, 40)
_DIGESTS = "SELECT lang, doc_id >> 10 AS cell, sha256(string_agg(sha256(text), '' ORDER BY doc_id, sha256(text))) AS h, count(*) AS n FROM documents GROUP BY ALL"
for _ in LEVELS[1:]:
    _DIGESTS = f"SELECT lang, cell >> 10 AS cell, sha256(string_agg(h, '' ORDER BY cell)) AS h, sum(n)::BIGINT AS n FROM ({_DIGESTS}) GROUP BY ALL"


@query(f"SELECT lang, sha256(string_agg(h, '' ORDER BY cell)) AS digest, sum(n)::BIGINT AS n FROM ({_DIGESTS}) GROUP BY lang")
def sha256_manifest(spark, sf):
    """Digests of texts, and one for each language over them: of 1,024 numbers of doc_id at a time, then of those digests, and so on."""
    h = read(spark, sf, "documents").select("lang", F.shiftright("doc_id", 10).alias("cell"), F.struct(F.col("doc_id").alias("at"), F.sha2("text", 256).alias("h")).alias("x"), F.lit(1).cast("long").alias("n"))
    for level in (*LEVELS[1:], None):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "")
        h = h.groupBy("lang", "cell").agg(F.sha2(joined.cast("binary"), 256).alias("h"), F.sum("n").alias("n"))
        h = h.select("lang", F.shiftright("cell", 10).alias("cell"), F.struct(F.col("cell").alias("at"), "h").alias("x"), "n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "")
    return h.groupBy("lang").agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


@query("WITH old AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), new AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 5 = 0 GROUP BY ALL) SELECT * FROM old WHERE (source, lang) NOT IN (SELECT (source, lang) FROM new) UNION ALL SELECT * FROM new")
def upsert_summary(spark, sf):
    """New rows replace those of the same key, the rest stays."""
    from strataweave.sources.writers import upserted

    d = read(spark, sf, "documents")
    count = lambda m: d.where(F.col("doc_id") % m == 0).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return upserted(count(2), count(5), ["source", "lang"])


@query("WITH d AS (SELECT source, lang, coalesce(length(text), 0) < 500 AS short FROM documents), old AS (SELECT source, lang, count(*) AS n FROM d WHERE short GROUP BY ALL), new AS (SELECT source, lang, count(*) AS n FROM d WHERE NOT short GROUP BY ALL) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source = old.source AND new.lang = old.lang) UNION ALL SELECT * FROM new")
def upsert_summary_full(spark, sf):
    """The counts of long texts replace those of short ones under the same key; each row is on one side."""
    from strataweave.sources.writers import upserted

    d = read(spark, sf, "documents").withColumn("short", F.coalesce(F.length("text"), F.lit(0)) < 500)
    count = lambda rows: rows.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return upserted(count(d.where("short")), count(d.where("not short")), ["source", "lang"])


@query("SELECT conv_id, role, count(*) FILTER (length(text) > 10) AS traced, round(count(*) FILTER (length(text) > 10) / count(*), 6) AS share, round(avg(length(text)), 4) AS mean_len, CASE WHEN count(*) FILTER (length(text) > 10) = 0 THEN 'NONE' WHEN count(*) FILTER (length(text) > 10) < 0.9 * count(*) THEN 'LOW' ELSE 'OK' END AS state FROM conversations GROUP BY ALL")
def trace_coverage(spark, sf):
    long = F.count_if(F.length("text") > 10)
    state = F.when(long == 0, "NONE").when(long < 0.9 * F.count("*"), "LOW").otherwise("OK")
    return rounded(read(spark, sf, "conversations").groupBy("conv_id", "role").agg(long.alias("traced"), F.round(long / F.count("*"), 6).alias("share"), F.round(F.avg(F.length("text")), 4).alias("mean_len"), state.alias("state")))
