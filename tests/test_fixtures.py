"""Small cases worked out by hand, and invariants of samples and intervals."""

import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.functions import parsing as P
from strataweave.functions.identifiers import canonical_case, case_id, numbered, retag, split_bounds
from strataweave.functions.ratios import wilson
from strataweave.operators import graph as G
from strataweave.operators import metrics as M
from strataweave.operators import routing as U
from strataweave.operators import sampling as S
from strataweave.operators import statistics as A
from strataweave.sources import readers, writers

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_weighted_rates(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (0, 3.0, 1), (0, 6.0, 0)], "label int, w double, pred int")
    weighted, plain = M.prf(df, weight="w").first(), M.prf(df).first()
    assert (weighted["precision"], weighted["recall"], weighted["f1"]) == (0.25, 1.0, 0.4)
    assert (plain["precision"], round(plain["f1"], 4)) == (0.5, 0.6667)
    assert round(M.predict_all_floor(df, weight="w").first()["f1"], 6) == round(2 / 11, 6)


def test_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0)], "label int, pred int")
    assert M.prf(df).first()["f1"] == 0.0
    assert df.select(M.rate(F.lit(0), F.lit(0)).alias("r")).first()["r"] is None


def test_none_class(spark):
    df = spark.createDataFrame([("fan-out", "fan-out"), ("cycle", "none")], "y string, z string")
    assert round(M.macro_f1(M.class_f1(df, "y", "z"), present_only=False).first()["macro_f1"], 6) == round(1 / 3, 6)


def test_routing(spark):
    df = spark.createDataFrame([(0.1, 1.0, 1), (0.9, 1.0, 0)], "p double, w double, llm int").withColumn("ml", (F.col("p") >= 0.8).cast("int"))
    pred, route = U.routed(U.consults("dt", F.col("w"), F.col("ml"), F.col("p"), 0.8, F.col("llm")), F.col("ml"), F.col("llm"))
    assert [tuple(r) for r in df.select(pred, route).collect()] == [(1, "llm_flipped"), (1, "ml_illicit")]


def test_retag(spark):
    df = spark.createDataFrame([("case v2_01210 near acct_v2_9999 and v2_1 and e_v2_00001x",)], "t string")
    r = df.select(retag(F.col("t")), canonical_case(F.lit("v2_01210")), case_id(F.lit(1234567))).first()
    assert tuple(r) == ("case amlc_01210 near acct_v2_9999 and v2_1 and e_v2_00001x", "amlc_01210", "amlc_1234567")


def test_target_is_kept(spark):
    df = spark.createDataFrame([(1, 12, 5, False), (1, 2, 5, False), (1, 7, 9, True)], "case_id long, row_id long, epoch_s long, is_target boolean")
    assert {r["row_id"]: r["kept"] for r in G.with_target(df, 2).collect()} == {12: False, 2: True, 7: True}


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("A", 1), ("B", 2)], [("A", 5)]))
    assert {r["k"]: r["v"] for r in writers.upserted(old, new, ["k"]).collect()} == {"A": 5, "B": 2}


@pytest.mark.parametrize("pool", range(1, 9))
def test_count_intervals_cover(pool):
    alpha = 0.1
    for n in range(pool + 1):
        spans = [A.count_interval(pool, n, x, alpha) for x in range(n + 1)]
        for marked in range(pool + 1):
            cover = sum(math.comb(marked, x) * math.comb(pool - marked, n - x) for x in range(n + 1) if spans[x][0] <= marked <= spans[x][1]) / math.comb(pool, n)
            assert cover >= 1 - alpha - 1e-9
    assert A.count_interval(100, 100, 64, alpha) == (64, 64) and A.count_interval(100, 0, 0, alpha) == (0, 100)


@FEW
@given(n=st.integers(1, 400), take=st.integers(1, 120), seed=st.integers(0, 5))
def test_samples_are_exact_and_repeatable(spark, n, take, seed):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    one = S.sample(df, ["g"], take, seed)
    two = S.sample(df.repartition(7), ["g"], take, seed)
    assert sorted(r["row_id"] for r in one.collect()) == sorted(r["row_id"] for r in two.collect())
    for r in one.groupBy("g").agg(F.count("*").alias("n"), F.max("pool").alias("pool"), F.sum("weight").alias("w")).collect():
        assert r["n"] == min(take, r["pool"]) and abs(r["w"] - r["pool"]) < 1e-6


@FEW
@given(sizes=st.lists(st.integers(0, 30), min_size=1, max_size=8), budget=st.integers(0, 120))
def test_round_robin(spark, sizes, budget):
    got = [r["take"] for r in S.round_robin(spark.createDataFrame(list(enumerate(sizes)), "g int, size long"), "size", "g", budget).orderBy("g").collect()]
    left, want = budget, [0] * len(sizes)
    while left and any(w < s for w, s in zip(want, sizes)):
        for i, s in enumerate(sizes):
            if left and want[i] < s:
                want[i], left = want[i] + 1, left - 1
    assert got == want


@FEW
@given(sizes=st.lists(st.integers(1, 50), min_size=1, max_size=6), budget=st.integers(1, 100))
def test_largest_remainder(spark, sizes, budget):
    got = S.largest_remainder(spark.createDataFrame(list(enumerate(sizes)), "g int, size long"), [], "size", "g", budget).agg(F.sum("share")).first()[0]
    assert got == budget


def test_benign_budget(spark):
    strata = [("hard_neg", 5), ("easy_t1", 10), ("easy_t2", 10), ("easy_t3", 3)]
    for budget in (4, 12, 20, 28, 40):
        rows = S.benign_sizes(spark.createDataFrame(strata, "stratum string, pool long"), budget).collect()
        got = {r["stratum"]: r["take"] for r in rows}
        assert sum(got.values()) + rows[0]["gap"] == max(min(budget, 28), 4 if budget >= 4 else 0)
        assert all(got[s] <= n for s, n in strata)


def test_fill_is_drawn_from_all_that_remain(spark):
    """What the strata leave of the budget comes from every stratum with rows to spare, and the weights fit what was taken."""
    rows = [(i, s) for i, s in enumerate(["hard_neg"] * 40 + ["easy_t1"] * 2 + ["easy_t2"] * 60 + ["easy_t3"] * 60)]
    df = spark.createDataFrame(rows, "row_id long, stratum string")
    for seed in range(3):
        got = S.benign_sample(df, 60, seed).collect()
        n = {s: sum(r["stratum"] == s for r in got) for s in ("hard_neg", "easy_t1", "easy_t2", "easy_t3")}
        assert len(got) == 60 == len({r["row_id"] for r in got}) and n["hard_neg"] > 18 and n["easy_t2"] > 14 and n["easy_t3"] > 14
        assert all(r["n"] == n[r["stratum"]] and abs(r["weight"] * r["n"] - r["pool"]) < 1e-9 for r in got)


def test_cliffs_delta(spark):
    a, b = [1, 2, 2, 5], [2, 3, 0]
    want = sum((x > y) - (x < y) for x, y in itertools.product(a, b)) / 12
    got = A.cliffs_delta(spark.createDataFrame([(x,) for x in a], "v int"), spark.createDataFrame([(x,) for x in b], "v int"), "v").first()["delta"]
    assert abs(got - want) < 1e-12


def test_wilson(spark):
    low, high = wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low, high).first()
    assert [round(x, 4) for x in r] == [0.4902, 0.9433]


def test_patterns_and_ids(spark):
    lines = ["BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3", "t,1,a,2,b,x", "END LAUNDERING ATTEMPT - FAN-OUT", "t,1,a,2,c,x", "BEGIN LAUNDERING ATTEMPT", "t,1,a,2,b,x"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert {r["key"]: r["typology"] for r in readers.pattern_labels(df).collect()} == {"t,1,a,2,b": "unknown"}
    got = numbered(spark.createDataFrame([(x,) for x in (9000, 3, 4097, 12)], "node long"), "node", 10).orderBy("idx").collect()
    assert [(r["node"], r["idx"]) for r in got] == [(3, 0), (12, 1), (4097, 2), (9000, 3)]
    assert split_bounds(10) == (6, 8)


def mapped(spark, f, texts):
    """``f`` of each text, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")).alias("v"), "i").orderBy("i").collect()]


def test_parsers(spark):
    t = "<think>a</think>Explanation: moves\nConclusion: **Not suspicious**"
    before, after = P.split_reasoning(F.lit(t))
    r = spark.range(1).select(before.alias("b"), after.alias("a"), P.judge_scores(F.lit('x ```{"parse": 1, "recall": 0}```'))["parse"].alias("p")).first()
    assert tuple(r) == ("a", "Explanation: moves\nConclusion: **Not suspicious**", 1)


def test_reasoning_ends_at_the_first_closing_tag(spark):
    said = ["<think>a</think>b</think>c", " <think> x <think>y \n</think>\n z ", "no tags ", "</think>"]
    assert mapped(spark, lambda t: P.split_reasoning(t)[0], said) == ["a", "x y", None, ""]
    assert mapped(spark, lambda t: P.split_reasoning(t)[1], said) == ["b</think>c", "z", "no tags ", ""]


def test_verified_write_replaces_and_keeps_nothing_aside(spark, tmp_path):
    from strataweave.sources.writers import write_verified

    path = f"file://{tmp_path}/t"
    write_verified(spark.range(5), path)
    write_verified(spark.range(7), path, force=True)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_typologies_in_text(spark):
    labels = {"Fan–Out (many).": "fan-out", "Fanout": "fan-out", "FAN IN": "fan-in", "smurfing": "", "cycle, or stack": "cycle", "Scatter gather": "scatter-gather", "gather of scatter": "gather-scatter", "Gather‑Scatter and cycle": "gather-scatter", "normal activity": "legitimate", "none": "", " bipartite;": "bipartite", "": ""}
    assert mapped(spark, P.normalised_typology, labels) == list(labels.values())
    raw = {"Observed Pattern: **Fan‑In** (hub)": "fan-in", "Final pattern cycle": "cycle", "Observed pattern: none here\nTypology: stack": "stack", "it may be a BIPARTITE graph": "bipartite", "nothing": "", "Pattern: layering": ""}
    assert mapped(spark, P.typology_in, raw) == list(raw.values())


def test_verdicts_in_text(spark):
    said = {
        "Explanation: moves\nthen on\nObserved Pattern: Cycle\nConclusion: Suspicious": (True, "moves\nthen on", "cycle", 0.8),
        "Conclusion:\n  suspicious, surely": (True, "", None, 0.6),
        "Conclusion: Not Suspicious\nObserved pattern: money mule": (False, "", "bipartite", 0.7),
        "Explanation: Fan‑out\n\nmore": (False, "Fan-out", None, 0.7),
        "": (False, "", None, 0.7),
    }
    v = lambda t: F.struct(*[c.alias(n) for n, c in P.verdict(t).items()])
    assert [tuple(r) for r in mapped(spark, v, said)] == list(said.values())
    short = {"VERDICT: Suspicious": 1, "verdict : not\nsuspicious": 0, "so\n Suspicious \nend": 1, "NOT_SUSPICIOUS": 0, "quite suspicious": 1, "it is not suspicious": 0, "": 0, None: 0}
    assert mapped(spark, P.own_line_verdict, short) == list(short.values())


def test_label_fields_leak(spark):
    texts = {"a label: 1": False, "x\n - Label = 1": True, '"is_laundering": 0': True, "'typology_id' : 3": True, "ground truth: x": True, "account <ID>": True, "a {{node}} b": True, "a labelled edge": False}
    assert mapped(spark, P.leaks_label, texts) == list(texts.values())


def test_lexical_steps(spark):
    low = "acct_12 is the hub with degree 5 and 12 transactions. it may be fan in, or a cycle; monthly, and the same amount each time"
    rows = [(low, True, "Cycle", 1, "cycle"), (low, False, None, 0, ""), ("short hub", True, None, 1, "cycle"), ("", False, None, 1, "cycle"), ("fan in and fan-in, over and over again, as it was said before", True, "stack", 1, "cycle")]
    df = spark.createDataFrame(rows, "t string, i boolean, typ string, y int, g string").coalesce(1)
    s = P.trace_scores(F.col("t"), F.col("i"), F.col("typ"), F.col("y"), F.col("g"))
    assert [tuple(r) for r in df.select(*[s[n] for n in ("parse", "recall", "match", "conclude")]).collect()] == [(1, 1, 1, 1), (1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_ordered_sums(spark):
    import numpy as np

    from strataweave.operators import ordered

    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), rng.choice([*rng.normal(size=700), 0.0, 5.0], 3000))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r["g"], r["v"]): (r["n"], r["less"]) for r in ordered.counted(df, "v", ["g"]).collect()}
    for g in range(3):
        own = np.array([v for h, v in rows if h == g])
        assert all(got[g, float(x)] == ((own == x).sum(), (own < x).sum()) for x in own)
        cuts = df.where(f"g = {g}")
        assert np.allclose(ordered.quantiles(cuts, "v", (0.0, 0.33, 0.5, 1.0)).first()["cuts"], np.quantile(own, [0, 0.33, 0.5, 1]))
    assert ordered.quantiles(df.limit(0), "v", (0.5,)).count() in (0, 1)


def test_one_difference_rejects(spark):
    from strataweave.operators import checks

    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert tuple(checks.lockstep(t, t, ["id"]).first()) == (0, 0)
    assert tuple(checks.lockstep(t, t.where("id = 1").withColumn("x", F.lit("b")), ["id"]).first()) == (1, 1)
    assert tuple(checks.set_relation(t, t, ["x"]).first()) == (2, 0, 0, True)
    assert checks.accepted(checks.one_to_one(t, t, ["id"]), ["left_only", "right_only"]).first()["matched"] == 2
    with pytest.raises(ValueError, match="rejected"):
        checks.accepted(checks.one_to_one(t, t.union(t), ["id"]), ["right_repeated"])
    judged = spark.createDataFrame([("m", "1", "1"), ("m", "2", "x"), ("m", "3", "0"), ("m", "3", "0"), (None, "4", "1")], "model string, case_id string, parse string")
    got = {(r["model"], r["case_id"]): r["violation"] for r in checks.binary_violations(judged, ["parse"], ["model", "case_id"]).collect()}
    assert got == {("m", "1"): None, ("m", "2"): "parse is not 0 or 1", ("m", "3"): "repeated key", (None, "4"): "missing key"}


def test_verified_writes_leave_nothing_behind(spark, tmp_path, monkeypatch):
    df = spark.range(10)
    writers.write_verified(df, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="exists"):
        writers.write_verified(df, f"{tmp_path}/t")
    seen = iter([df.selectExpr("1 as a").first(), df.selectExpr("2 as a").first()])
    monkeypatch.setattr(writers, "row_digest", lambda _: type("Once", (), {"first": lambda self: next(seen)})())
    with pytest.raises(ValueError, match="read back"):
        writers.write_verified(df, f"{tmp_path}/u")
    assert not (tmp_path / "u").exists() and spark.read.parquet(f"{tmp_path}/t").count() == 10


def test_cases_and_sheets_are_read(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_id": "v2_00012", "label": 1, "prompt": "case v2_00012"}\nno json\n')
    got = [tuple(r) for r in readers.cases(spark, str(tmp_path / "c.jsonl")).select("case_id", "prompt", "violation").orderBy("violation").collect()]
    assert got == [("amlc_00012", "case amlc_00012", None), (None, None, "no JSON")]
    (tmp_path / "p.json").write_text('{"model": "m", "predictions": [{"case_id": "amlc_00001", "illicit": true, "typology": null, "reasoning_content": null}]}')
    assert [tuple(r) for r in readers.traces(spark, str(tmp_path / "p.json")).collect()] == [("m", "amlc_00001", "", True, "")]
    (tmp_path / "q.csv").write_text("model,run,case_id,observed_pattern\nm,0,amlc_00001,legitimate\nm,0,amlc_00002,\n")
    assert [r["cls"] for r in readers.probes(spark, str(tmp_path / "q.csv")).orderBy("case_id").collect()] == ["benign", "benign"]
    (tmp_path / "t.json").write_text('{"best_params": {"depth": "4"}, "best_score": 0.5}')
    assert [tuple(r)[1:] for r in readers.tuned(spark, str(tmp_path / "t.json")).collect()] == [("depth", "4")]
    (tmp_path / "pat.txt").write_text("BEGIN LAUNDERING ATTEMPT - CYCLE: x\r\nt,1,a,2,b,5\r\nEND\nt,1,a,3,b,5\nBEGIN LAUNDERING ATTEMPT\nt,9,a,2,b,5\n")
    assert {r["key"]: r["typology"] for r in readers.pattern_file(spark, str(tmp_path / "pat.txt")).collect()} == {"t,1,a,2,b": "cycle", "t,9,a,2,b": "unknown"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    writers.write_verified(df, f"{tmp_path}/p")
    with pytest.raises(Exception, match="exist"):
        writers.write_parquet(df, f"{tmp_path}/p")
    writers.write_csv(df, f"{tmp_path}/c", ["v", "k"])
    writers.write_ragged([df, df.withColumn("more", F.lit(1))], f"{tmp_path}/r")
    writers.write_jsonl(df, f"{tmp_path}/j", gzip=True)
    assert spark.read.csv(f"{tmp_path}/c", header=True).columns == ["v", "k"] and spark.read.json(f"{tmp_path}/j").count() == 2
    changed, report = writers.rewritten(df, spark.createDataFrame([(1, "b")], "k long, v string"), ["k"], "v")
    assert {r["k"]: r["v"] for r in changed.collect()} == {1: "b", 2: None} and report.count() == 1
    found = readers.manifest(spark, f"{tmp_path}/p")
    assert {r["state"] for r in readers.verify_manifest(found, found).collect()} == {"ok"}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20, 010 ,8000,011,8001,3.5,US Dollar,3.5,Euro,Cheque,1\n")
    r = readers.with_row_ids(readers.transactions(spark, str(tmp_path / "t.csv"))).first()
    assert (r["row_id"], r["source"], r["target"], r["cross_currency"], str(r["ts"])) == (0, "010_8000", "011_8001", True, "2022-09-01 00:20:00")
    (tmp_path / "p.json").write_text('{"method": "m", "model": "x", "dataset": "d", "seed": 1, "n_predictions": 2, "predictions": [{"case_id": "amlc_00001", "illicit": true}, {"case_id": "amlc_00009", "illicit": null}]}')
    found = readers.predictions(spark, str(tmp_path / "p.json"))
    coreset = spark.createDataFrame([("amlc_00001",), ("amlc_00002",)], "case_id string")
    report = readers.coverage_report(coreset, found, ["model"]).first()
    assert (report["unknown"], report["duplicate"], report["no_verdict"], report["missing"]) == (1, 0, 1, 1)
    assert {r["case_id"]: r["illicit"] for r in readers.permissive(coreset, found).collect()} == {"amlc_00001": True, "amlc_00002": False}
    (tmp_path / "a.csv").write_text("model,case_id,parse\nm,1,True\nm,1,0\nm,2,maybe\n")
    bad = {r["violation"] for r in readers.annotations(spark, str(tmp_path / "a.csv"), ["model", "case_id"], ["parse"]).collect()}
    assert bad == {"duplicate key", "parse is not boolean"}


def test_wilcoxon_by_hand(spark):
    import random

    rng = random.Random(6)
    for _ in range(3):
        d = [rng.choice([-2, -1, -1, 0, 0, 1, 1, 2, 3]) * rng.choice([0.5, 1.0]) for _ in range(40)]
        size = sorted(map(abs, d))
        rank = {a: sum(i + 1 for i, x in enumerate(size) if x == a) / size.count(a) for a in set(size)}
        zero = sum(rank[0] / 2 for x in d if x == 0)
        plus, minus = (sum(rank[abs(x)] for x in d if x * sign > 0) + zero for sign in (1, -1))
        n, z = len(d), d.count(0)
        ties = sum(size.count(a) ** 3 - size.count(a) for a in set(size) if a)
        score = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24)
        got = A.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double"), [], "d").first()
        assert (got["n"], got["w_plus"], got["w_minus"]) == (n, plus, minus)
        assert abs(got["z"] - score) < 1e-9 and abs(got["p_value"] - min(1.0, math.erfc(abs(score) / math.sqrt(2)))) < 1e-9


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "k long, v double")
    a, b = (A.bootstrap_mean(df.repartition(n), "v", "k").first() for n in (1, 5))
    assert all(abs(a[c] - b[c]) < 1e-9 for c in ("mean", "low", "high"))
    error = 2.8722813 / 20
    assert abs(a["mean"] - 4.5) < error and abs(a["low"] - (4.5 - 1.96 * error)) < 0.1 and abs(a["high"] - (4.5 + 1.96 * error)) < 0.1
