"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers the documents that fill about ``SEGMENT`` bytes of text: its sorted
distinct terms (64-bit hashes of lower-cased words) and, for each, the list of the positions where it stands.
Positions count words through the segment with a gap of ``GAP`` behind each document, so no match crosses a border.
Segments are built where the documents are read and never shuffled, and one segment is held in memory at a time.

A query is a run of terms. In each segment, queries with a term that is missing there go first. The others start
from the positions of their rarest term and intersect, in order of rarity, the other terms' lists adjusted by their
offsets; for all queries at once, in numpy. With ``slop`` 0 a match is an exact phrase. Otherwise it is a proximity
match: each term stands within ``slop`` words of its place relative to the rarest term.

Test items are read in blocks of bounded size, one pass over the index for each, so the benchmark may be large too. A
block goes to the tasks as sorted arrays of term hashes.

Defined results: null texts have no words; items without words are never found; a row with a null item_id marks words
but is not counted or named; an item that occurs twice counts once; each document row is judged by itself. Without
items nothing is hit; an empty table gives an empty result. A very long text is one document of its segment, whole.
Ties cannot occur, as marks are sets of words and items are named in order. Other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import ALNUM, hash_words, mix, small_batches, utf8_column, written

SEGMENT, GAP = 1 << 20, 64
#: Bytes of test items that one pass over the index takes.
BLOCK = 8 << 20
INDEX = "ids array<long>, known array<boolean>, counts array<int>, terms binary, sizes binary, places binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8_column(batch.column(1))
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(at, at[a] + SEGMENT, side="right")) - 1)
            ids = batch.column(0).slice(a, z - a)
            words, counts = hash_words(data[at[a] : at[z]], at[a : z + 1] - at[a], ALNUM)
            place = np.arange(len(words)) + np.repeat(np.arange(z - a) * GAP, counts)
            order = np.argsort(words, kind="stable")
            terms, sizes = np.unique(words, return_counts=True)
            place = place[order].astype(np.uint32)
            first = np.cumsum(sizes) - sizes
            steps = np.diff(place, prepend=np.uint32(0))  # gaps in each list pack better than places
            steps[first] = place[first]
            yield pa.RecordBatch.from_pydict(
                {"ids": [ids.fill_null(0).to_pylist()], "known": [ids.is_valid().to_pylist()], "counts": [counts.tolist()], "terms": [terms.tobytes()], "sizes": [sizes.astype(np.uint32).tobytes()], "places": [steps.astype(np.uint32).tobytes()]},
                schema=pa.schema([("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32())), ("terms", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())]),
            )
            a = z


def build_index(documents: DataFrame) -> DataFrame:
    """The index of whole texts, written to the shared folder."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_segments, INDEX).withColumn("segment", F.monotonically_increasing_id()), "decontaminate-index")


class Queries:
    """Runs of terms, all of a block of items: ``first`` and ``length`` of each run in the words of the items, ``of`` each word's place in the vocabulary.

    Runs that overlap share their words, and equal runs are one (by two hashes of 64 bits), so that a block takes some twenty times its bytes at most.
    """

    def __init__(self, items: pd.DataFrame, window: int):
        words, counts = hash_words(*utf8_column(pa.array(items["text"], pa.large_string(), from_pandas=True)), ALNUM)
        known: dict = {}
        number = np.array([known.setdefault(None if name is None or pd.isna(name) else name, len(known)) for name in items["item_id"]], np.int32)
        self.names: list[str | None] = list(known)
        runs = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
        first = np.repeat(np.cumsum(counts) - counts, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        length, item = np.repeat(np.minimum(counts, window), runs), np.repeat(number, runs)
        keys = []
        with np.errstate(over="ignore"):
            for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                key = length.astype(np.uint64)
                for k in range(int(length.max(initial=0))):
                    key = np.where(k < length, key * factor + words[np.minimum(first + k, max(len(words) - 1, 0))], key)
                keys.append(mix(key))
        order = np.lexsort((item, keys[1], keys[0]))
        item, run = item[order], np.ones(len(order), bool)
        run[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
        holder = run.copy()
        holder[1:] |= item[1:] != item[:-1]
        self.first, self.length = first[order][run], length[order][run].astype(np.int64)
        self.vocabulary, of = np.unique(words, return_inverse=True)
        self.of = of.astype(np.int32)
        self.held_by = item[holder]  # the items of each run, end to end
        self.borders = np.append(np.flatnonzero(run[holder]), len(self.held_by))

    def items_of(self, run: int) -> list[int]:
        return self.held_by[self.borders[run] : self.borders[run + 1]].tolist()

    def search(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(run, position) of each match in a segment; positions sorted within each term's list."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.length) or not len(terms):
            return none
        slot = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        have = terms[slot] == self.vocabulary
        held = np.where(have, sizes[slot], 0)[self.of]
        least = held[self.first]
        for k in range(1, int(self.length.max())):
            least = np.minimum(least, held[np.minimum(self.first + k, len(held) - 1)], out=least, where=k < self.length)
        alive = np.flatnonzero(least > 0)
        if not len(alive):
            return none
        start, key = np.cumsum(sizes) - sizes, (np.repeat(np.arange(len(terms)), sizes) << 32) + places
        # The offsets of each run's terms from the rarest to the most frequent, in columns.
        most = int(self.length[alive].max())
        rank = np.full((len(alive), most), -1, np.int64)
        for row, r in enumerate(alive):
            own = held[self.first[r] : self.first[r] + self.length[r]]
            rank[row, : len(own)] = np.argsort(own, kind="stable")
        anchor = slot[self.of[self.first[alive] + rank[:, 0]]]
        many = sizes[anchor]
        run = np.repeat(np.arange(len(alive)), many)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        at = places[start[anchor][run] + inside] - rank[run, 0]
        for column in range(1, most):
            offset = rank[run, column]
            term = slot[self.of[self.first[alive][run] + np.maximum(offset, 0)]].astype(np.int64)
            low = (term << 32) + np.maximum(at + offset - slop, 0)
            near = np.searchsorted(key, low)
            ok = (offset < 0) | ((near < len(key)) & (key[np.minimum(near, len(key) - 1)] <= (term << 32) + np.maximum(at + offset + slop, -1)) & (at + offset + slop >= 0))
            run, at = run[ok], at[ok]
        return alive[run], at


def _matches(shared, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            out = {"segment": [], "row": [], "doc_id": [], "n_words": [], "marks": [], "items": []}
            for s in range(batch.num_rows):
                take = lambda name, s=s: batch.column(name)[s]
                counts = np.array(take("counts").as_py(), np.int64)
                terms, sizes, steps = (np.frombuffer(take(n).as_buffer(), d) for n, d in (("terms", np.uint64), ("sizes", np.uint32), ("places", np.uint32)))
                sizes = sizes.astype(np.int64)
                first = np.cumsum(sizes) - sizes
                total = np.cumsum(steps.astype(np.int64))
                places = total - np.repeat(total[first] - steps[first], sizes) if len(steps) else total
                found, at = queries.search(terms, sizes, places, slop)
                starts = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
                row = np.searchsorted(starts, np.maximum(at, 0), side="right") - 1
                ids, known = take("ids").as_py(), take("known").as_py()
                by: dict[int, tuple[list, set]] = {}
                for f, r, p in zip(found.tolist(), row.tolist(), (at - starts[row]).tolist() if len(at) else []):
                    marks, items = by.setdefault(r, ([], set()))
                    marks.append((max(p - slop, 0), min(p + int(queries.length[f]) + slop, int(counts[r]))))
                    items.update(queries.items_of(f))
                for r, n in enumerate(counts.tolist()):
                    marks, items = by.get(r, ([], set()))
                    out["segment"].append(take("segment").as_py())
                    out["row"].append(r)
                    out["doc_id"].append(ids[r] if known[r] else None)
                    out["n_words"].append(n)
                    out["marks"].append([x for m in merged(marks) for x in m])
                    out["items"].append(sorted(queries.names[i] for i in items if queries.names[i] is not None))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("marks", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return run


def merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _united(parts: pd.Series) -> pd.Series:
    """The intervals of several passes, made disjoint."""
    return pd.Series([[x for m in merged([(int(p[i]), int(p[i + 1])) for p in each for i in range(0, len(p), 2)]) for x in m] for each in parts])


def find(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """For each document (segment, row, doc_id, n_words) the words inside matches, as from, to, from, to ..., and the items found."""
    if window + 2 * slop >= GAP:
        raise ValueError(f"window + 2 * slop must be under {GAP}")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    bytes_in_all = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-bytes_in_all // block))
    found = None
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)) == i) if passes > 1 else items
        queries = Queries(part.toPandas().sort_values(["item_id", "text"], na_position="last", ignore_index=True), window)  # ``block`` bytes or so
        one = index.mapInArrow(_matches(items.sparkSession.sparkContext.broadcast(queries), slop), "segment long, row int, doc_id long, n_words long, marks array<long>, items array<string>")
        if passes > 1:  # so that the driver holds the items of one pass at a time
            one = written(one, "decontaminate-found")
        found = one if found is None else found.union(one)
    if passes > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("marks").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("marks", F.pandas_udf(_united, "array<long>")("marks"))
    return found


def judge(documents: DataFrame, items: DataFrame, window: int = 13, least_percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document, by exact phrases of ``window`` words."""
    found = find(build_index(documents), items, window)
    hit = F.aggregate(F.transform("marks", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words")))
