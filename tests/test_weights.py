"""Repair of archived weights: what is right passes, each kind of fault is refused."""

import pytest

from strataweave.operators import weights as W

#: 40 benign rows: scores from 0.01 to 0.4; those of 0.31 and more are taken whole. 2 illicit rows.
PEOPLE = [(i, 0, (i + 1) / 100) for i in range(40)] + [(40, 1, 0.2), (41, 1, 0.9)]


def _archive():
    """10 hard rows and 2 illicit ones at weight 1; of the easy terciles 0-9, 10-19, 20-29 five each, and row 9 as fill."""
    rows = {i: 1.0 for i in range(30, 42)}
    rows |= {i: 2.0 for t in (0, 10, 20) for i in range(t, t + 5)}
    return rows | {9: 5.0}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "row_id long, label int, p double")


def repaired(spark, people, rows):
    return W.recompute(people, spark.createDataFrame([(k, v) for k, v in rows.items()], "row_id long, weight double"))


def test_weights_of_a_sound_archive(spark, people):
    got = repaired(spark, people, _archive())
    fixed = {r.row_id: r.fixed for r in got.collect()}
    assert sum(fixed.values()) == pytest.approx(42)
    assert fixed[9] == pytest.approx(fixed[0]) == pytest.approx(10 / 6) and fixed[10] == 2.0 and fixed[35] == 1.0 and fixed[40] == 1.0
    by = {r.stratum: r for r in W.report(got).collect()}
    assert all(r.consistent for r in by.values())
    assert by["easy_t1"].fill == 1 and by["easy_t1"].changed == 6 and by["easy_t1"].largest_change == pytest.approx(5 - 10 / 6)
    assert by["hard_neg"].changed == 0 and by["easy_t2"].changed == 0
    assert W.accepted(got).count() == 28


@pytest.mark.parametrize("fault, where", [({0: 1.5}, "easy_t1"), ({10: 2.5, 11: 2.5, 12: 2.5}, "easy_t2"), ({20: 1.9, 21: 1.9, 22: 1.9, 23: 1.9, 24: 1.9}, "easy_t3"), ({39: 1.5}, None)])
def test_faults_are_refused(spark, people, fault, where):
    with pytest.raises(ValueError, match=where or "apart"):
        W.accepted(repaired(spark, people, _archive() | fault))


def test_archives_that_cannot_be_placed(spark, people):
    with pytest.raises(ValueError, match="without label"):
        repaired(spark, people, _archive() | {99: 2.0})
    with pytest.raises(ValueError, match="no benign row"):
        repaired(spark, people, {0: 2.0, 40: 1.0})
    with pytest.raises(ValueError, match="repeated"):
        W.recompute(people, spark.createDataFrame([(39, 1.0), (39, 1.0)], "row_id long, weight double"))
    with pytest.raises(ValueError, match="no benign row"):
        W.recompute(people, spark.createDataFrame([], "row_id long, weight double"))
