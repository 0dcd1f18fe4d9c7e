"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataweave.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and p in (q[:2], q[1:]) for q, b in chosen.items()) if len(p) == 2 else False:
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def some_rows():
    rng = random.Random(11)
    words = ["New", "york", "CITY", "of", "the", "ﬁn", "é", "É", "don't", "a-b", "x" * 50, "東京"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und", ""]), text(rng.choice((0, 1, 2, 5, 60)))) for _ in range(120)]
    return rows + 40 * [("en", "one two three four. two three")] + [("en", None), (None, ""), ("fr", " .,\n"), ("en", text(20_000)), ("de", "no end " * 9)]


@pytest.mark.parametrize(("budget", "top"), [(1 << 17, 2000), (300, 2000), (20, 7)])
def test_brute_force(spark, monkeypatch, budget, top):
    monkeypatch.setattr(collocations, "BUDGET", budget)  # small: words and pairs that are too large prefixes
    rows = some_rows()
    df = spark.createDataFrame([(t, g, 1, 2, "x") for g, t in rows], "text string, lang string, a long, n long, phrase string").repartition(5)
    assert got(collocations.mine(df, top=top)) == brute(rows, top=top)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert got(collocations.mine(none)) == []
    assert got(collocations.mine(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string"))) == []


def test_groups_fit_their_budget():
    rng = np.random.default_rng(1)
    load = rng.integers(0, 50, 4096)
    first = collocations.borders(load, 200).astype(int)
    sums = np.add.reduceat(load, first)
    assert sums.sum() == load.sum() and sums.max() <= 200 and (sums[:-1] + sums[1:]).min() > 150


def test_words_of_pieces(monkeypatch):
    import pyarrow as pa

    from strataweave.llm.common import utf8_column

    texts = ["ab, cd ef", None, "gh", " long" * 30, "é\tü.", ""]
    whole = collocations.Words(3, checked=True)(*utf8_column(pa.array(texts)), np.arange(6, dtype=np.uint64))
    monkeypatch.setattr(collocations, "PIECE", 5)
    cut = collocations.Words(3, checked=True)(*utf8_column(pa.array(texts)), np.arange(6, dtype=np.uint64))
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert whole[-1].tolist() == [False, True, False, False] + 29 * [True] + [False, True, False]
