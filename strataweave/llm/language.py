"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are runs of ``GRAMS`` bytes of the text in UTF-8, with A-Z lower-cased and everything in ASCII that is not a
letter turned into a space; a hash puts each into one of ``BUCKETS``. The mean of the buckets' embeddings goes through
a linear layer with a softmax. Both are linear, so for prediction they fold into one row of logits for each bucket,
and scoring is a lookup for each byte.

Training takes a bounded sample: about ``rows`` texts and at most ``max_bytes`` bytes for each of at most
``languages`` languages (the most frequent; counted over all rows), and ``all_rows`` and ``all_bytes`` for all of them, chosen by a hash of doc_id, whole texts of up to a
sixteenth of the bytes (the shortest one if all are longer). A fifth of it calibrates
the temperature of the softmax and the least score whose predictions reach ``precision``; below it a prediction is
marked as not accepted.

Defined results: null texts and texts without a letter get ``und`` with score 0, as does everything if no row has a
language; a null doc_id is never held out. A very long text is scored whole; repeated rows get equal results, as a
score comes from the text alone, whatever rows stand beside it; ties go to the first language by name. An empty table
gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import fitting, small_batches, utf8_column, written
from strataweave.llm.quality import held_out

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (3, 4)
FOLDS, FOLD = 3, 1
STEP = 1 << 18
#: An update of a text's subwords is scaled by their number, up to this one, as larger steps of very long texts would diverge.
STEEP = 400


@dataclass
class Model:
    names: list[str]
    logits: np.ndarray  # of each bucket, the temperature included
    least: float


def grams(data: np.ndarray) -> np.ndarray:
    """The buckets of the subwords that begin at each byte, a row for each length."""
    plain = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint32)
    b = np.concatenate((plain[data], np.full(max(GRAMS), 32, np.uint32)))
    out = np.empty((len(GRAMS), len(data)), np.uint32)
    with np.errstate(over="ignore"):
        for i, n in enumerate(GRAMS):
            x = np.zeros(len(data), np.uint32)
            for j in range(n):
                x = x * np.uint32(0x01000193) + b[j : j + len(data)]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[i] = x >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return out


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that lie one behind the other, with spaces behind each so that no subword reaches into the next; and where each begins (with the end)."""
    gap = max(GRAMS) - 1
    out = np.full(len(data) + gap * (len(at) - 1), 32, np.uint8)
    out[np.arange(len(data)) + gap * np.repeat(np.arange(len(at) - 1), np.diff(at))] = data
    return out, at + gap * np.arange(len(at))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], epochs: int = 12, rate: float = 0.5, precision: float = 0.99) -> Model:
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    bags = []
    for t in texts:
        place, n = np.unique(grams(np.frombuffer(t.encode(), np.uint8)), return_counts=True)
        bags.append((place, (n / n.sum()).astype(np.float32)))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(texts))
    held, seen = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 10 else (order, order)
    share = np.bincount(y[seen], minlength=len(names)) / len(seen)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 1 / WIDTH, (WIDTH, len(names))).astype(np.float32)
    for epoch in range(epochs):
        for i in rng.permutation(seen):
            place, w = bags[i]
            mean = w @ embed[place]
            off = softmax(mean @ layer)
            off[y[i]] -= 1
            off *= rate * (1 - epoch / epochs) / (len(names) * max(share[y[i]], 1e-3))
            back = layer @ off
            layer -= np.outer(mean, off)
            embed[place] -= np.outer(w * min(len(place), STEEP), back)
    folded = (embed @ layer).astype(np.float32)
    raw = np.array([w @ folded[place] for place, w in bags])[held]
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)).mean())
    p = softmax(raw / heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    down = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision)
    return Model(names, folded / np.float32(heat), float(best[down[fine[-1]]]) if len(fine) else 1.0)


def train(documents: DataFrame, rows: int = 1500, max_bytes: int = 4 << 20, languages: int = 500, all_rows: int = 12_000, all_bytes: int = 32 << 20) -> Model | None:
    """A model of a sample by hash: at most about ``rows`` texts and ``max_bytes`` for each language, and at most about ``all_rows`` and ``all_bytes`` for all.

    With many languages, each gets its equal part of the last two. The sample is what the driver holds; its bags of
    subwords take about six times its bytes.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).toPandas()
    if counts.empty:
        return None
    rows, max_bytes = max(1, min(rows, all_rows // len(counts))), min(max_bytes, all_bytes // len(counts))
    counts["most"] = ((1 << 30) * np.minimum(1.0, rows / counts["count"])).astype("int64")
    most = documents.sparkSession.createDataFrame(counts[["lang", "most"]], "lang string, most long")
    drawn = known.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)).alias("draw"))
    sample = written(drawn.join(F.broadcast(most), "lang").where("draw < most"), "language-sample")  # ``languages`` rows at most
    sizes = sample.select("doc_id", "lang", "draw", F.octet_length("text").alias("bytes")).toPandas().sort_values(["lang", "draw", "doc_id"])
    sizes = sizes[sizes.groupby("lang")["bytes"].transform(lambda x: fitting(x.to_numpy(), max_bytes)).astype(bool)]
    texts = sample.join(F.broadcast(documents.sparkSession.createDataFrame(sizes[["doc_id"]], "doc_id long").distinct()), "doc_id", "left_semi").toPandas().sort_values(["lang", "draw", "doc_id", "text"])
    return fit(texts["text"].tolist(), texts["lang"].tolist())


def predict(documents: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each document."""

    def lettered(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        has = np.zeros(len(texts), bool)
        for i in range(len(texts)):
            own = data[at[i] : at[i + 1]]
            has[i] = bool((((own | 32) >= 97) & ((own | 32) <= 122)).any())
        for i in np.flatnonzero(~has & (at[1:] > at[:-1])):
            has[i] = any(map(str.isalpha, texts[i].as_py()))
        return has

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = pa.array(series, pa.large_string(), from_pandas=True)
            data, at = utf8_column(texts)
            has = lettered(texts, data, at) if model else np.zeros(len(texts), bool)
            total = np.zeros((len(texts), len(model.names) if model else 1))
            a = 0
            while model and a < len(texts):  # about STEP bytes at a time, or one text, in pieces if that is longer
                z = max(a + 1, int(np.searchsorted(at, at[a] + STEP, side="right")) - 1)
                if z == a + 1:  # a piece of a long text sees the first bytes of the next piece
                    for lo in range(int(at[a]), int(at[z]), STEP):
                        hi = min(lo + STEP, int(at[z]))
                        g = grams(data[lo : min(hi + max(GRAMS) - 1, int(at[z]))])[:, : hi - lo]
                        total[a] += np.add.reduceat(sum(model.logits[x] for x in g), [0], axis=0)[0]
                else:
                    wide, start = spaced(data[at[a] : at[z]], at[a : z + 1] - at[a])
                    size = np.diff(at[a : z + 1])
                    own = np.arange(int(size.sum())) + (max(GRAMS) - 1) * np.repeat(np.arange(z - a), size)
                    each = sum(model.logits[x[own]] for x in grams(wide))
                    rows = np.flatnonzero(size)
                    if len(rows):
                        total[a + rows] += np.add.reduceat(each, at[a + rows] - at[a], axis=0)
                a = z
            p = softmax(total / (len(GRAMS) * np.maximum(at[1:] - at[:-1], 1))[:, None])
            best = p.argmax(axis=1)
            score = np.where(has, p[np.arange(len(p)), best], 0.0)
            yield pd.DataFrame({"lang_pred": [model.names[b] if h else "und" for b, h in zip(best, has)], "score": score, "accepted": has & (score >= (model.least if model else 1.0))})

    small_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c not in ("held_out", "lang_pred", "score", "accepted", "_found")] if keep else ["doc_id"]
    found = F.pandas_udf(run, "lang_pred string, score double, accepted boolean")("text")
    return documents.select(*rest, held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), found.alias("_found")).select(*rest, "held_out", "_found.*")
