"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataweave.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def buckets_of(t):
    w = WORD.findall(lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(documents, target, percent=5, least=20):
    rows = [(i, *buckets_of(t)) for i, t in documents]
    s, t = Counter(b for _, _, f in rows for b in f), Counter(b for x in target for b in buckets_of(x)[1])
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.total() + 10000) / ((s[i] + 1) * (t.total() + 10000)))) for i in range(10000)]
    out = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=repr)


def test_sums_of_windows():
    rng = random.Random(3)
    for _ in range(20):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 64, 65, 300)))) for _ in "ab")
        want = zlib.crc32(a + b)
        assert int(resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == want
    words = [b"a", b"x" * 64, b"y" * 65, "é".encode() * 40]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert resampling.word_sums(data, np.append(0, ends[:-1]), ends).tolist() == [zlib.crc32(w) for w in words]


def test_odd_rows(spark):
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice(["Fox", "dog", "né", "x1", "the", "OF", "z" * 90, "東京"]) + rng.choice(["", ",", "\x00", "-"]) for _ in range(n))
    rows = [(i, some(rng.choice((0, 1, 2, 19, 20, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "?!"), (None, some(30)), (203, some(40_000)), (204, "q" * 200_000 + " tail")] + [(5, some(25)), (205, some(30))] + 30 * [(206, some(22))]
    df = spark.createDataFrame([(i, t, 7, 8, 9, "a") for i, t in rows], "doc_id long, text string, score long, rank int, id int, n_words string").repartition(5)
    target = ["fox dog the of", None, "", some(50)]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    for percent in (5, 50, 100, 0):
        assert got(resampling.resample(df, aim, percent=percent)) == brute(rows, target, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert got(resampling.resample(docs, none)) == brute([(1, "a b c")], [])


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_pieces_end_between_words(piece, monkeypatch):
    from tokenizers import Regex, pre_tokenizers

    monkeypatch.setattr(resampling, "PIECE", piece)
    text = "ab cde--f " * 9 + "long" * 30 + " é9 \x00z"
    data = np.frombuffer(text.encode(), np.uint8)
    split = pre_tokenizers.Split(Regex(resampling.WORD), "removed", invert=True)
    assert [text.encode()[a:z].decode() for a, z in resampling.offsets(split, data)] == WORD.findall(text)
