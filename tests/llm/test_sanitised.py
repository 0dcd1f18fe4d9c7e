"""Sanitised texts go by row: null and repeated ids, equal rows, clashing names."""

from collections import Counter

import pytest

from strataweave.llm import pii


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "mail anna@example.com now", "a"), (1, "Call me anna@example.com or +49 30 1234567 soon", "b"), (1, "At 10.0.0.1 today", "c"), (1, "At 10.0.0.1 today", "c"), (2, None, "d"), (None, "", "e"), (3, "nothing here", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = Counter(tuple(r) for r in pii.sanitised(df).collect())
    assert got == Counter([(None, "mail [EMAIL] now", "a"), (1, "Call me [EMAIL] or [PHONE] soon", "b"), (1, "At [IP] today", "c"), (1, "At [IP] today", "c"), (2, None, "d"), (None, "", "e"), (3, "nothing here", "f")])
    assert pii.sanitised(df.where("doc_id = 99")).count() == 0
    with pytest.raises(ValueError):
        pii.redact(df, pii.detect(df))
    one = df.where("doc_id = 3 or doc_id = 2")
    assert {tuple(r) for r in pii.redact(one, pii.detect(one)).collect()} == {(2, None, "d"), (3, "nothing here", "f")}


def test_disclosing_terms_go_from_rows_without_ids(spark):
    rows = [(None, f"Call Rumpelstiltskin today é anna@example.com now {i}") for i in range(6)] + [(i, f"call today or now, number {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in pii.sanitised(df).where("doc_id is null").collect()]
    assert sorted(got) == [f"Call  today  [EMAIL] now {i}" for i in range(6)]
