"""Queries: agreement, item response, divergence, uncertainty, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.identifiers import draw
from strataweave.functions.ratios import Z95, wilson
from strataweave.operators import sampling as S
from strataweave.operators import statistics as A
from strataweave.plans.sampling import PER, SEED, STRATA, TAU, ranked, strata
from strataweave.plans.tx import SCORED, TX, nibble, read, rounded, scorers, sql_nibble, test_part, verdicts, VERDICTS

from strataweave.session import written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RATED = f"r AS (SELECT doc_id, rater, CAST({sql_nibble(chr(39) + 'rate' + chr(39), 'rater', 'doc_id')} < 8 + 2 * (doc_id % 3) AS INTEGER) AS score FROM documents CROSS JOIN (VALUES ('a'), ('b'), ('c'), ('d')) v(rater))"


def _rated(spark, sf):
    each = F.explode(F.array(*[F.lit(x) for x in "abcd"]))
    return read(spark, sf, "documents").select("doc_id", each.alias("rater")).withColumn("score", (nibble("rate", F.col("rater"), F.col("doc_id")) < 8 + 2 * (F.col("doc_id") % 3)).cast("int"))


@query(f"WITH {RATED}, c AS (SELECT x.rater AS rater_a, y.rater AS rater_b, count(*) AS n, count(*) FILTER (x.score = y.score) / count(*) AS po, avg(x.score) AS pa, avg(y.score) AS pb FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY ALL) SELECT rater_a, rater_b, n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM c")
def cohen_kappa(spark, sf):
    return rounded(A.cohen_kappa(_rated(spark, sf), "doc_id", "rater", "score"))


@query(f"WITH {RATED}, k AS (SELECT doc_id, score, count(*) AS c FROM r GROUP BY ALL), i AS (SELECT doc_id, sum(c) AS n, sum(c * (c - 1)) AS s FROM k GROUP BY ALL), p AS (SELECT count(*) AS items, avg(s / (n * (n - 1))) AS p_bar FROM i), e AS (SELECT sum(x * x) AS p_e FROM (SELECT count(*) / (SELECT count(*) FROM r) AS x FROM r GROUP BY score)) SELECT items, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round((p_bar - p_e) / (1 - p_e), 6) AS kappa FROM p CROSS JOIN e")
def fleiss_kappa(spark, sf):
    return rounded(A.fleiss_kappa(_rated(spark, sf), "doc_id", "score"))


@query(f"WITH {RATED} SELECT rater, count(*) AS n, round(avg(score), 6) AS share, avg(score) ** 2 + (1 - avg(score)) ** 2 >= 0.95 AS ceiling FROM r GROUP BY rater")
def rater_ceiling(spark, sf):
    return rounded(A.rater_ceiling(_rated(spark, sf), "rater", "score"))


W = "(k / n + {z} * {z} / (2 * n) {s} {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"


@query(f"WITH {RATED}, c AS (SELECT rater, CAST(sum(score) AS BIGINT) AS k, count(*) AS n FROM r GROUP BY rater) SELECT rater, k, n, round({W.format(z=Z95, s='-')}, 6) AS low, round({W.format(z=Z95, s='+')}, 6) AS high FROM c")
def wilson_ci(spark, sf):
    c = _rated(spark, sf).groupBy("rater").agg(F.sum("score").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(c.select("rater", "k", "n", low.alias("low"), high.alias("high")))


@query(f"WITH {RATED} SELECT count(*) FILTER (x.score = 1 AND y.score = 1) AS both, count(*) FILTER (x.score = 1 AND y.score = 0) AS first_only, count(*) FILTER (x.score = 0 AND y.score = 1) AS second_only, count(*) FILTER (x.score = 0 AND y.score = 0) AS neither FROM r x JOIN r y USING (doc_id) WHERE x.rater = 'a' AND y.rater = 'b'")
def judge_discordance(spark, sf):
    r = _rated(spark, sf)
    side = lambda name, c: r.where(F.col("rater") == name).select("doc_id", F.col("score").alias(c))
    x, y = F.col("x"), F.col("y")
    cell = lambda a, b: F.count_if((x == a) & (y == b))
    return side("a", "x").join(side("b", "y"), "doc_id").agg(cell(1, 1).alias("both"), cell(1, 0).alias("first_only"), cell(0, 1).alias("second_only"), cell(0, 0).alias("neither"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only, count(*) FILTER (l.doc_id = d.doc_id) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_join(spark, sf):
    """Full outer join that counts what either side lacks."""
    d = read(spark, sf, "documents").select("doc_id", F.lit(1).alias("a"))
    both = d.join(read(spark, sf, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


CLS8 = "(SELECT CAST(unnest(range(8)) AS INTEGER) AS cls)"


@query(f"WITH {TX}, s AS (SELECT split, cls, count(typology) + 1e-9 AS c FROM (SELECT DISTINCT split FROM tx) CROSS JOIN {CLS8} LEFT JOIN (SELECT split, typology, typology AS cls FROM tx WHERE typology >= 0) USING (split, cls) GROUP BY ALL), h AS (SELECT *, c / sum(c) OVER (PARTITION BY split) AS share FROM s) SELECT round(sum(a.share * ln(a.share / b.share)), 6) AS kl FROM h a JOIN h b USING (cls) WHERE a.split = 'test' AND b.split = 'train'")
def typology_dist_kl(spark, sf):
    from strataweave.plans.tx import tx

    t = tx(spark, sf).where("typology >= 0").groupBy("split", F.col("typology").alias("cls")).agg(F.count("*").alias("c"))
    every = spark.createDataFrame([(s, i) for s in ("train", "test") for i in range(8)], "split string, cls int")
    shares = A.smoothed(every.join(t, ["split", "cls"], "left"), ["split"])
    side = lambda s: shares.where(F.col("split") == s)
    return rounded(A.divergence(side("test"), side("train"), ["cls"]))


@query(f"WITH {TX}, s AS (SELECT split, bin, count(b) + 1e-9 AS c FROM (SELECT DISTINCT split FROM tx) CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) LEFT JOIN (SELECT split, least(CAST(floor((1 - 2 * abs(p - 0.5)) * 10) AS INTEGER), 9) AS bin, 1 AS b FROM tx) USING (split, bin) GROUP BY ALL), h AS (SELECT *, c / sum(c) OVER (PARTITION BY split) AS share FROM s) SELECT a.bin, round(a.share, 6) AS test_share, round(b.share, 6) AS train_share FROM h a JOIN h b USING (bin) WHERE a.split = 'test' AND b.split = 'train'")
def difficulty_hist(spark, sf):
    from strataweave.plans.tx import tx

    h = A.histogram_share(tx(spark, sf).withColumn("difficulty", S.difficulty(F.col("p"))), ["split"], "difficulty")
    side = lambda s: h.where(F.col("split") == s).select("bin", F.col("share").alias(f"{s}_share"))
    return rounded(side("test").join(side("train"), "bin"))


RESP = f"{TX}, {SCORED}, x AS (SELECT row_id, member || seed AS rater, CAST((p >= 0.5) = (label = 1) AS INTEGER) AS ok FROM s), ab AS (SELECT rater, avg(ok) AS ability FROM x GROUP BY rater), it AS (SELECT row_id, avg(ok) AS accuracy, ln((1 - least(greatest(avg(ok), 0.01), 0.99)) / least(greatest(avg(ok), 0.01), 0.99)) AS difficulty, coalesce(CASE WHEN stddev_pop(ok) > 0 AND stddev_pop(ability) > 0 THEN corr(ok, ability) END, 0.0) AS discrimination FROM x JOIN ab USING (rater) GROUP BY row_id)"


def _responses(spark, sf):
    s = scorers(test_part(spark, sf))
    return s.select("row_id", F.concat("member", F.col("seed").cast("string")).alias("rater"), ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int").alias("ok"))


@query(f"WITH {RESP} SELECT row_id, round(accuracy, 6) AS accuracy, round(difficulty, 6) AS difficulty, round(discrimination, 4) AS discrimination FROM it")
def item_response(spark, sf):
    return rounded(A.item_response(_responses(spark, sf), "row_id", "rater", "ok")).withColumn("discrimination", F.round("discrimination", 4))


@query(f"WITH {TX}, b AS (SELECT p AS v FROM t), c AS (SELECT quantile_cont(v, 1.0 / 3) AS q1, quantile_cont(v, 2.0 / 3) AS q2, stddev_pop(v) AS sd, count(*) AS n FROM b) SELECT max(n) AS n, round(max(sd), 6) AS sd, count(*) FILTER (v <= q1) AS low, count(*) FILTER (v >= q1 AND v <= q2) AS mid, count(*) FILTER (v >= q2) AS high, 0 AS issues, 'GOOD' AS verdict FROM b CROSS JOIN c")
def irt_eligibility(spark, sf):
    return rounded(A.eligibility(test_part(spark, sf).select("p"), 6, "p"))


@query(f"WITH {TX} SELECT round(avg(sign(a.p - b.p)), 6) AS delta FROM t a CROSS JOIN t b WHERE a.label = 1 AND b.label = 0")
def cliffs_delta(spark, sf):
    t = test_part(spark, sf)
    return rounded(A.cliffs_delta(t.where("label = 1"), t.where("label = 0"), "p"))


SAMPLE = f"{STRATA}, sm AS (SELECT *, CASE WHEN p >= {TAU} THEN 1.0 ELSE 0.0 END AS x, CASE WHEN p >= 0.7 THEN 1.0 ELSE 0.0 END AS y FROM {ranked('st', 'stratum')} WHERE rk <= {PER})"


def _sampled(spark, sf):
    return written(S.sample(strata(spark, sf), ["stratum"], PER, SEED), "sampled").withColumns({"x": (F.col("p") >= TAU).cast("double"), "y": (F.col("p") >= 0.7).cast("double")})


@query(f"WITH {SAMPLE}, g AS (SELECT stratum, max(pool) AS pool, count(*) AS n, covar_samp(x, y) AS s FROM sm GROUP BY stratum) SELECT round(sum(pool * pool * (1 - n / pool) * s / n), 6) AS covariance FROM g")
def stratified_covariance(spark, sf):
    s = _sampled(spark, sf)
    return rounded(A.stratified_covariance(s.drop("pool", "n"), s.groupBy("stratum").agg(F.max("pool").alias("pool")), [], "x", "y"))


@query(f"WITH {SAMPLE}, g AS (SELECT stratum, max(pool) AS pool, count(*) AS n, coalesce(covar_samp(z, z), 0) AS s, sum(z) / count(*) * max(pool) AS total FROM (SELECT *, CASE WHEN label = 0 THEN y ELSE 0 END AS z FROM sm) GROUP BY stratum), f AS (SELECT sum(total) AS fp, sum(pool * pool * (1 - n / pool) * s / n) AS v FROM g), dd AS (SELECT count(*) FILTER (label = 1 AND p >= 0.7) AS tp, count(*) FILTER (label = 1) AS pos FROM t) SELECT round(fp, 6) AS fp, round(sqrt(v), 6) AS se_fp, round(sqrt(v) * tp / (tp + fp) ** 2, 8) AS se_precision, round(sqrt(v) * 2 * tp / (tp + fp + pos) ** 2, 8) AS se_f1 FROM f CROSS JOIN dd")
def linearised_se(spark, sf):
    """Standard errors of precision and F1 from that of the false positives, by their gradients."""
    s = _sampled(spark, sf).withColumn("z", F.when(F.col("label") == 0, F.col("y")).otherwise(0.0))
    g = s.groupBy("stratum").agg(F.max("pool").alias("pool"), F.avg("z").alias("mean"))
    fp = g.agg(F.sum(F.col("mean") * F.col("pool")).alias("fp"))
    v = A.stratified_covariance(s.drop("pool", "n"), g.select("stratum", "pool"), [], "z", "z")
    d = test_part(spark, sf).agg(F.count_if((F.col("label") == 1) & (F.col("p") >= 0.7)).alias("tp"), F.count_if(F.col("label") == 1).alias("pos"))
    one = fp.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(d))  # one row each
    se, tp, x = F.sqrt("covariance"), F.col("tp"), F.col("fp")
    return one.select(F.round(x, 6).alias("fp"), F.round(se, 6).alias("se_fp"), F.round(se * tp / F.pow(tp + x, F.lit(2)), 8).alias("se_precision"), F.round(se * 2 * tp / F.pow(tp + x + F.col("pos"), F.lit(2)), 8).alias("se_f1"))


_CHOOSE = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
#: Each number of marked units that a stratum may have, with its two tails, summed term by term.
ENVELOPE = f"""{SAMPLE}, ct AS (SELECT stratum, max(pool)::BIGINT AS pool, count(*)::BIGINT AS n, sum(y)::BIGINT AS x FROM sm WHERE label = 0 GROUP BY stratum),
mk AS (SELECT *, unnest(range(x, pool - n + x + 1)) AS m FROM ct),
tl AS (SELECT stratum, pool, n, x, m, sum(pr) FILTER (i >= x) AS upper, sum(pr) FILTER (i <= x) AS lower FROM (SELECT *, exp({_CHOOSE('m', 'i')} + {_CHOOSE('(pool - m)', '(n - i)')} - {_CHOOSE('pool', 'n')}) AS pr FROM (SELECT *, unnest(range(greatest(0, n + m - pool), least(n, m) + 1)) AS i FROM mk)) GROUP BY ALL),
iv AS (SELECT stratum, pool, n, x, CASE WHEN n = pool THEN x ELSE min(m) FILTER (upper >= 0.05 / 4 / 2 - 1e-12) END AS low, CASE WHEN n = pool THEN x ELSE max(m) FILTER (lower >= 0.05 / 4 / 2 - 1e-12) END AS high FROM tl GROUP BY stratum, pool, n, x)"""


def _intervals(spark, sf):
    s = _sampled(spark, sf).where("label = 0")
    counts = s.groupBy("stratum").agg(F.max("pool").alias("pool"), F.max("n").alias("n"), F.sum("y").cast("bigint").alias("x"))
    return A.with_intervals(counts, F.lit(0.05) / 4).select("stratum", "pool", "n", "x", "low", "high")


@query(f"WITH {ENVELOPE} SELECT * FROM iv")
def hypergeom_envelope(spark, sf):
    """Exact intervals of the flagged rows of each stratum."""
    return _intervals(spark, sf)


_RATE = lambda fp, side: f"round(coalesce(tp / nullif(tp + {fp}, 0), 0), 6) AS precision_{side}, round(coalesce(2 * tp / nullif(tp + pos + {fp}, 0), 0), 6) AS f1_{side}, round(coalesce(tp / nullif(tp + {fp}, 0), 0) * total / nullif(pos, 0), 6) AS lift_{side}"


@query(f"WITH {ENVELOPE}, e AS (SELECT sum(low)::BIGINT AS fp_low, sum(high)::BIGINT AS fp_high FROM iv), w AS (SELECT count(*) FILTER (label = 1 AND p >= 0.7) AS tp, count(*) FILTER (label = 1) AS pos, count(*) AS total FROM t) SELECT *, {_RATE('fp_high', 'low')}, {_RATE('fp_low', 'high')} FROM e CROSS JOIN w")
def metric_envelope(spark, sf):
    """Bounds of precision, F1 and lift from the exact intervals of all strata."""
    known = test_part(spark, sf).agg(F.count_if((F.col("label") == 1) & (F.col("p") >= 0.7)).alias("tp"), F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("total"))
    return rounded(A.metric_envelope(_intervals(spark, sf).crossJoin(F.broadcast(known)), []))  # one row


@query(f"WITH {TX}, {VERDICTS}, b AS (SELECT run || payment_format AS block, model, avg(CAST(pred = label AS INT)) AS acc FROM v GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY acc) + (count(*) OVER (PARTITION BY block, acc) - 1) / 2 AS r FROM b), s AS (SELECT model, sum(r) AS r, count(*) AS n FROM k GROUP BY model) SELECT round(12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3.0 * max(n) * (count(*) + 1), 6) AS chi2, round(max(r / n) - min(r / n), 6) AS spread, count(*) AS treatments, max(n) AS blocks FROM s")
def friedman(spark, sf):
    b = verdicts(test_part(spark, sf)).groupBy(F.concat(F.col("run").cast("string"), "payment_format").alias("block"), "model").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"))
    return rounded(A.friedman(b, "block", "model", "acc"))


@query()
def wilcoxon(spark, sf):
    """Signed ranks of the difference between two models' accuracies by account."""
    v = verdicts(test_part(spark, sf)).groupBy("src", "model").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"))
    d = v.groupBy("src").pivot("model", ["m1", "m2"]).agg(F.first("acc")).select("src", (F.col("m1") - F.col("m2")).alias("d"))
    return rounded(A.wilcoxon(d, [], "d"))


@query()
def bootstrap_ci(spark, sf):
    return rounded(A.bootstrap_mean(test_part(spark, sf), "amount", "row_id"))


@query(f"""WITH {TX}, {VERDICTS}, c AS (SELECT payment_format, run, model, count(*) AS n, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM v WHERE model IN ('m1', 'm2') GROUP BY ALL), e AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, 100 * fp / n AS over, 100 * fn / n AS under FROM c),
d AS (SELECT a.payment_format, count(*) AS cells, avg(b.f1 - a.f1) * 100 AS f, avg(b.over - a.over) AS o, avg(b.under - a.under) AS u FROM e a JOIN e b USING (payment_format, run) WHERE a.model = 'm1' AND b.model = 'm2' GROUP BY ALL)
SELECT payment_format, cells, round(f, 6) AS delta_f1_pp, f >= 5 AS h1, round(o, 6) AS delta_over_pp, o <= -10 AS h2, round(u, 6) AS delta_under_pp, u <= 5 AS h3 FROM d""")
def paired_hypotheses(spark, sf):
    """Mean paired differences by dataset against the limits of the three hypotheses: F1, over-prediction, under-prediction."""
    v = verdicts(test_part(spark, sf)).where("model IN ('m1', 'm2')")
    return rounded(A.paired_hypotheses(v, ["payment_format"], ["run"], "model", "m1", "m2"))


_PAIRS = f"{TX}, {VERDICTS}, ac AS (SELECT payment_format, src_bank, model, avg(CAST(pred = label AS INT)) AS acc FROM v WHERE model IN ('m1', 'm2') GROUP BY ALL), df AS (SELECT a.payment_format, a.src_bank, a.acc - b.acc AS d FROM ac a JOIN ac b USING (payment_format, src_bank) WHERE a.model = 'm1' AND b.model = 'm2')"


def _pairs(spark, sf):
    v = verdicts(test_part(spark, sf)).groupBy("payment_format", "src_bank").pivot("model", ["m1", "m2"]).agg(F.avg((F.col("pred") == F.col("label")).cast("int")))
    return v.select("payment_format", "src_bank", (F.col("m1") - F.col("m2")).alias("d")).where("d is not null")


@query(f"""WITH {_PAIRS}, a AS (SELECT *, round(abs(d), 12) AS a FROM df), r AS (SELECT *, rank() OVER (PARTITION BY payment_format ORDER BY a) + (count(*) OVER (PARTITION BY payment_format, a) - 1) / 2 AS r, row_number() OVER (PARTITION BY payment_format ORDER BY a, src_bank) AS i, count(*) OVER (PARTITION BY payment_format) AS n FROM a),
w AS (SELECT payment_format, n, sum(CASE WHEN a = 0 THEN r / 2 WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN a = 0 THEN r / 2 WHEN d < 0 THEN r ELSE 0 END) AS w_minus, max(a) AS most FROM r GROUP BY ALL),
s AS (SELECT payment_format, k, sum(CASE WHEN a = 0 THEN r / 2 WHEN (k >> (i - 1)) & 1 = 1 THEN r ELSE 0 END) AS x FROM r CROSS JOIN (SELECT unnest(range(128)) AS k) GROUP BY ALL),
p AS (SELECT payment_format, avg((x >= w_plus)::INT) AS up, avg((x <= w_plus)::INT) AS down FROM s JOIN w USING (payment_format) GROUP BY ALL)
SELECT payment_format, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, true AS exact, CASE WHEN most > 0 THEN round(up, 6) END AS p_greater, CASE WHEN most > 0 THEN round(least(1, 2 * least(up, down)), 6) END AS p_two_sided FROM w JOIN p USING (payment_format)""")
def wilcoxon_exact(spark, sf):
    """Exact signed ranks of the difference between two models over seven banks, for each payment format; the SQL goes through all signs."""
    return rounded(A.wilcoxon_exact(_pairs(spark, sf), ["payment_format"], "d"))


@query()
def paired_bootstrap_ci(spark, sf):
    """10,000 resamples of the difference between two models' accuracies by account."""
    v = verdicts(test_part(spark, sf)).groupBy("src").pivot("model", ["m1", "m2"]).agg(F.avg((F.col("pred") == F.col("label")).cast("int")))
    return rounded(A.paired_bootstrap(v.select("src", (F.col("m2") - F.col("m1")).alias("d")), "d", "src"))
