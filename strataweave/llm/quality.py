"""Quality by compression: how much better a text compresses with a dictionary of good text than with one of bad text.

A zstandard dictionary is built from good and one from bad labelled texts. Every text is cut into pieces of ``PIECE``
bytes, each compressed alone with either dictionary, so a long text cannot fill the window with itself and hide the
dictionary. The feature is (bad - good) / (bad + good) of the summed sizes; a logistic curve, fitted on labelled
texts that no dictionary saw and weighted to the shares of the two labels, turns it into a probability.

The model learns from a bounded sample: about ``rows`` texts and at most ``max_bytes`` bytes for each label, taken by
a hash of doc_id, whole texts of up to a sixteenth of the bytes; the shares of the labels are counted over all of them.
Scoring is one pass without a shuffle.

Defined results: null and empty texts score as texts of size 0; a null doc_id is never held out; without labels of
both kinds, the score is the share of good among the labels, 0.5 without any; a doc_id labelled twice counts twice
if the labels differ. A very long text is scored whole, piece by piece; repeated rows get equal scores, as a score comes
from the text alone; a score of exactly the threshold is predicted 1. An empty table gives an empty result. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import fitting, small_batches, written

PIECE, DICTIONARY, LEVEL = 256, 112_640, 3
FOLDS = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def held_out(key: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def dictionary(texts: list[str]) -> bytes:
    import zstandard

    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples: their plain content serves
        return b"".join(samples)[-DICTIONARY:]


def compressors(model: Model) -> list:
    import zstandard

    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]


def feature(text: str | None, good, bad) -> float:
    parts = pieces(text)
    g, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
    return (b - g) / (b + g)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression, by Newton's method with a slight pull of the slope to 0."""
    scale = max(float(np.abs(x).max()), 1e-9)
    design, beta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    pull = np.diag([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + pull, design.T @ (weight * (y - p)) - pull @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(documents: DataFrame, labels: DataFrame, rows: int = 4000, max_bytes: int = 16 << 20) -> Model | float:
    """The model, or the constant score if labels of one kind are missing."""
    labels = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    share = {q: n for q, n in labels.groupBy("quality").count().collect()}
    constant = share.get(1, 0) / sum(share.values()) if share else 0.5
    if len(share) < 2:
        return constant
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    most = F.when(F.col("quality") == 1, F.lit(int((1 << 30) * min(1.0, rows / share[1])))).otherwise(F.lit(int((1 << 30) * min(1.0, rows / share[0]))))
    chosen = labels.withColumn("draw", draw).where(F.col("draw") < most)  # about ``rows`` of each label, so a few hundred kB at most
    sample = written(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("length(text) > 0"), "quality-sample")
    sizes = sample.select("doc_id", "quality", "draw", F.octet_length("text").alias("bytes")).toPandas().sort_values(["quality", "draw", "doc_id"])
    sizes = sizes[sizes.groupby("quality")["bytes"].transform(lambda x: fitting(x.to_numpy(), max_bytes)).astype(bool)]
    kept = sample.join(F.broadcast(documents.sparkSession.createDataFrame(sizes[["doc_id", "quality", "bytes"]], "doc_id long, quality int, bytes int")), ["doc_id", "quality"], "left_semi") if len(sizes) else sample.limit(0)
    texts = kept.toPandas().sort_values(["quality", "draw", "doc_id", "text"])
    if texts["quality"].nunique() < 2:
        return constant
    turn = np.arange(len(texts)) % 3
    built, fitted = texts[turn < 2], texts[turn == 2]
    if built["quality"].nunique() < 2 or fitted["quality"].nunique() < 2:
        built = fitted = texts
    model = Model(*(dictionary(built.loc[built["quality"] == q, "text"].tolist()) for q in (1, 0)), 0.0, 0.0)
    tools, y = compressors(model), fitted["quality"].to_numpy().astype(float)
    x = np.array([feature(t, *tools) for t in fitted["text"]])
    total = sum(share.values())
    weight = np.where(y == 1, share[1] / total / max(y.sum(), 1), share[0] / total / max((1 - y).sum(), 1)) * len(y)
    model.slope, model.offset = logistic(x, y, weight)
    return model


def score(documents: DataFrame, model: Model | float, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; with ``keep`` beside the document's own columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = None if isinstance(model, float) else compressors(model)
        for texts in batches:
            if tools is None:
                yield pd.Series(np.full(len(texts), model))
            else:
                x = np.array([feature(t, *tools) for t in texts], dtype=float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30))))

    small_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c not in ("held_out", "score", "predicted")] if keep else ["doc_id"]
    scored = documents.select(*rest, held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

