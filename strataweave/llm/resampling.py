"""Importance resampling towards a target distribution, by hashed word n-grams.

An untrained pre-tokenizer of the tokenizers library, a Split by regular expression, takes the ASCII-lowered text apart
and returns words with their offsets. Texts are handed to it as Latin-1, so that its offsets are byte offsets: a byte of
a character beyond ASCII is a word character, as the character itself is. Windows of one to three neighbouring offset
pairs are the features. CRC-32 is linear, so the check sum of a window follows from those of its words and their lengths,
and no window is ever put together as a string. A feature's bucket is its check sum modulo the number of buckets.

One pass over the texts writes each document's histogram, of at most ``buckets`` entries. The histograms summed over all
documents and over all target texts are two arrays of that many counts; they give the gain of each bucket, and a second
pass over the histograms adds up each document's gains. Gumbel noise from a hash of the id turns the highest sums into a
draw without replacement; ranks come from the sums of 256 cells of the scores and windows inside each.

Defined results: a null or empty text, and one without words, has no feature and weight 0; texts are read whole, in pieces
that end between words, so memory follows a batch of texts and the words of the longest one; a null id draws as the empty
string and comes last among ties; rows that repeat an id draw the same noise, and rows that are equal in all that is returned
share their ranks out among them; an empty table gives an empty result; columns beyond id and text are not looked at. Without target texts
all t are 0, as the formula has it. Held by the driver: two counts for each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.llm.common import ALNUM, sliced, utf8_column, written
from strataweave.operators.ordered import with_cell

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that go to the pre-tokenizer at once, and rows made from one chunk of equal rows.
PIECE, CHUNK = 1 << 16, 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# ---------------------------------------------------------------- CRC-32 of windows

#: Lengths up to which the effect of following bytes is tabulated.
SHORT = 64


@cache
def _bytewise() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


@cache
def _moves() -> tuple[np.ndarray, np.ndarray]:
    """What 0 to SHORT following bytes, and what 2**k of them, do to each byte of a check sum."""
    one, moves = _bytewise(), [np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(SHORT):
        moves.append(one[moves[-1] & 255] ^ (moves[-1] >> 8))
    powers = [moves[1]]
    for _ in range(39):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.array(moves, np.uint32), np.array(powers, np.uint32)


def _apply(move: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return move[0][crc & 255] ^ move[1][(crc >> 8) & 255] ^ move[2][(crc >> 16) & 255] ^ move[3][crc >> 24]


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of the check sum of a string that its beginning with check sum ``crc`` gives, if ``by`` bytes follow; xor the check sum of those."""
    moves, powers = _moves()
    few = np.minimum(by, SHORT)
    out = moves[few, 0, crc & 255] ^ moves[few, 1, (crc >> 8) & 255] ^ moves[few, 2, (crc >> 16) & 255] ^ moves[few, 3, crc >> 24]
    for i in np.flatnonzero(by > SHORT):
        rest = int(by[i]) - SHORT
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                out[i] = _apply(powers[k], out[i])
    return out


def word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word."""
    table, length = _bytewise(), end - start
    crc, at = np.full(len(start), 0xFFFFFFFF, np.uint32), np.arange(len(start))
    for j in range(SHORT):
        at = at[length[at] > j]
        if not len(at):
            break
        crc[at] = table[(crc[at] ^ data[start[at] + j]) & 255] ^ (crc[at] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return crc


# ---------------------------------------------------------------- histograms of documents


def offsets(split, text: np.ndarray) -> np.ndarray:
    """The words of a lowered text, as rows of begin and end in bytes."""
    found, a, n = [], 0, len(text)
    while a < n:
        z = min(n, a + PIECE)
        if z < n and ALNUM[text[z - 1]] and ALNUM[text[z]]:
            gaps = np.flatnonzero(~ALNUM[text[a:z]])
            if len(gaps):
                z = a + int(gaps[-1]) + 1
            while z < n and ALNUM[text[z - 1]] and ALNUM[text[z]]:  # a word longer than the piece
                gaps = np.flatnonzero(~ALNUM[text[z : z + PIECE]])
                z = z + int(gaps[0]) if len(gaps) else min(n, z + PIECE)
        words = split.pre_tokenize_str(text[a:z].tobytes().decode("latin-1"))
        found.append(np.fromiter(chain.from_iterable(pair for _, pair in words), np.int64, 2 * len(words)) + a)
        a = z
    return np.concatenate(found).reshape(-1, 2) if found else np.zeros((0, 2), np.int64)


def features(data: np.ndarray, at: np.ndarray, split, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and the text and the bucket of each feature."""
    low = LOWER[data]
    pairs = [offsets(split, low[a:z]) + a for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
    counts = np.array([len(p) for p in pairs], np.int64)
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    owner, length = np.repeat(np.arange(len(counts)), counts), pairs[:, 1] - pairs[:, 0]
    crc = word_sums(low, pairs[:, 0], pairs[:, 1])
    spaced = moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    owners, found, window = [owner], [crc % np.uint32(buckets)], crc
    for size in range(2, longest + 1):
        n = max(0, len(crc) - size + 1)
        window = moved(window[:n], length[size - 1 :] + 1) ^ spaced[size - 1 :]  # of windows that reach into the next text, too
        inside = owner[:n] == owner[size - 1 :]
        owners.append(owner[:n][inside])
        found.append(window[inside] % np.uint32(buckets))
    return counts, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def _histograms(longest: int, buckets: int):
    """Batches of (id, text) become n_words, n_features, and the buckets of each text in ascending steps with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        for batch in batches:
            for part in sliced(batch, 1):
                words, owner, bucket = features(*utf8_column(part.column(1)), split, longest, buckets)
                key, times = np.unique(owner * buckets + bucket, return_counts=True)
                whose, bucket = key // buckets, key % buckets
                ends = np.searchsorted(whose, np.arange(part.num_rows + 1))
                step = np.diff(bucket, prepend=0)
                step[ends[:-1][np.diff(ends) > 0]] = bucket[ends[:-1][np.diff(ends) > 0]]
                cut = lambda values, kind: pa.array([values[a:z].astype(kind).tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words), pa.array(np.bincount(owner, minlength=part.num_rows).astype(np.int64)), cut(step, np.uint32 if buckets > 1 << 16 else np.uint16), cut(times, np.uint32)],
                    names=["id", "n_words", "n_features", "steps", "times"],
                )

    return run


def histograms(texts: DataFrame, id_column: str, text: str, longest: int, buckets: int, what: str) -> DataFrame:
    kind = dict(texts.dtypes)[id_column]
    rows = texts.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_histograms(longest, buckets), f"id {kind}, n_words long, n_features long, steps binary, times binary"), what)


def unpacked(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the bucket and the count of each entry of the histograms of a batch."""
    name = batch.schema.get_field_index
    steps, ends = utf8_column(batch.column(name("steps")))
    times, _ = utf8_column(batch.column(name("times")))
    steps = np.frombuffer(steps.tobytes(), np.uint32 if buckets > 1 << 16 else np.uint16).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends) // (4 if buckets > 1 << 16 else 2))
    total = np.cumsum(steps)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        total = total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(row))))
    return row, total, np.frombuffer(times.tobytes(), np.uint32).astype(np.int64)


def summed(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all histograms: added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                _, bucket, times = unpacked(batch.slice(a, 500), buckets)
                np.add.at(total, bucket, times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = found.select("steps", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down: the logarithm of its smoothed share in the target over that in the source."""
    n, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio.tolist()], np.int64)


def _weighted(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows, np.int64)
            for a in range(0, batch.num_rows, 500):
                row, bucket, times = unpacked(batch.slice(a, 500), len(gain))
                np.add.at(weight, row + a, gain[bucket] * times)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


# ---------------------------------------------------------------- the draw


def resample(documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: str = "42", longest: int = 3, buckets: int = 10000) -> DataFrame:
    """id, n_features, weight, score, rank, n_words of every document; the rank is null for documents that are not drawn."""
    kind = dict(documents.dtypes)[id_column]
    found = histograms(documents, id_column, text, longest, buckets, "resampling-documents")
    aimed = histograms(target.withColumn("_id", F.lit(0)), "_id", target_text, longest, buckets, "resampling-target")
    gain = gains(summed(found, buckets), summed(aimed, buckets))
    weighed = found.mapInArrow(_weighted(gain), f"id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "resampling-scored")

    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    due = percent * n // 100
    low = scored.where(able).agg(F.percentile_approx("score", max(0.0, 1.0 - due / max(n, 1) - 0.001), 10000)).first()[0]
    if due and scored.where(able & (F.col("score") >= low)).count() < due:  # the cut is approximate
        low = scored.where(able).agg(F.min("score")).first()[0]
    high = able & (F.col("score") >= low) if due else F.lit(False)
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))

    columns = ["id", "n_features", "weight", "score", "n_words"]
    first = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words")]
    cells = with_cell(scored.where(high).groupBy(*columns).agg(F.count("*").alias("_n")), "score")
    before = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # over the sums of 256 cells
    totals = cells.groupBy("_cell").agg(F.sum("_n").alias("_sum")).select("_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(totals, "_cell").withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    chunks = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))).hint("rebalance")
    place = F.explode(F.sequence(F.col("_chunk") * CHUNK + 1, F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK)))
    drawn = chunks.withColumn("_place", place).withColumn("rank", F.col("_from") + F.col("_place")).withColumn("rank", F.when(F.col("rank") <= due, F.col("rank")).cast("long"))
    out = rest.select(*columns, "rank").union(drawn.select(*columns, "rank"))
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank", "n_words")
