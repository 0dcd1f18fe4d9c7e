"""The exact graph of nearest neighbours by cosine, of all rows, with cells left out by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.operators.sampling import first_ranked
from strataweave.session import written

#: Similarities are compared with this many digits, so that the shape of a product doesn't decide ties.
DIGITS, SLACK = 12, 1e-6
#: Blocks whose rows look through others together, and blocks that they look through in one task, about.
TILE, SLICE = 32, 64
#: Pairs that a block's rows hold before all but their k best are dropped.
MANY = 20_000


def _matrix(vectors) -> np.ndarray:
    a = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _best(q_ids: np.ndarray, q: np.ndarray, n_ids: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, similarity) of the k best of each row, ties to the smaller id; a row is not its own neighbour."""
    order = np.argsort(n_ids, kind="stable")
    s = np.round(q @ n[order].T, DIGITS)
    s[q_ids[:, None] == n_ids[order][None, :]] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    sims = np.take_along_axis(s, top, 1).ravel()
    ok = np.isfinite(sims)
    return np.repeat(np.arange(len(q_ids)), top.shape[1])[ok], n_ids[order][top].ravel()[ok], sims[ok]


def _above(q: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of n, similarity) of the pairs that reach the row's least similarity; the others are not rounded or sorted."""
    s = q @ n.T
    at = np.flatnonzero(s >= (least - 10.0**-DIGITS)[:, None])
    row, sims = at // len(n), np.round(s.ravel()[at], DIGITS)
    ok = sims >= least[row]
    return row[ok], at[ok] % len(n), sims[ok]


def _first(row: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by similarity, ties to the smaller id."""
    order = np.lexsort((n, -s, row))
    row, n, s = row[order], n[order], s[order]
    start = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    ok = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0)) < k
    return row[ok], n[ok], s[ok]


def nearest(vectors: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", pivots: int = 64, block: int = 512, seed: int | str = 42) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other rows of each row, exactly; ids are distinct integers.

    Each unit vector goes to the nearest of ``pivots`` rows, drawn by hash. A cell is cut into blocks of about ``block`` rows,
    however many it has. A row's own block bounds its k-th distance, and a cell whose pivot lies further away than that
    and the cell's radius holds none of its neighbours. Blocks are dealt into tiles of about ``TILE``, which
    meet the blocks that any of theirs asks for in slices of about ``SLICE``: a block is sent once for a tile, and a tile once for a slice. The driver holds the pivots and one radius a cell. Vectors that are null, empty or zero have no direction:
    they have no neighbours and are none.
    """
    length = F.aggregate(F.transform(F.col(vector), lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(length > 0)
    lots = rows.sparkSession.range(1).select(F.lit(pivots).cast("bigint").alias("take"))
    poles = first_ranked(rows.withColumn("_d", draw(seed, F.col("id"))), [], "_d", lots).orderBy("id").collect()
    if not poles:
        return rows.select(F.col("id").alias(id), F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    poles = _matrix([r["v"] for r in poles])

    def away(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ poles.T)))

    def placed(parts):
        for p in parts:
            if len(p):
                d = away(_matrix(p["v"]))
                yield p.assign(cell=d.argmin(axis=1), far=d.min(axis=1))

    cells = written(rows.mapInPandas(placed, "id long, v array<double>, cell int, far double"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in sizes.collect()}
    radius = np.array([sizes.get(c, (0, -np.inf))[1] for c in range(len(poles))])
    counts = F.array(*[F.lit(max(1, -(-sizes.get(c, (0, 0))[0] // block))) for c in range(len(poles))])
    part = F.pmod(F.xxhash64("id"), counts[F.col("cell")]).cast("int")
    blocks = cells.groupBy("cell", part.alias("part")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"))
    blocks = written(blocks, "blocks")

    def unpacked(ids, flat):
        ids = np.asarray(ids, dtype=np.int64)
        return ids, _matrix(np.asarray(flat, dtype=np.float64).reshape(len(ids), -1))

    def own(parts):
        for p in parts:
            for cell, part, ids, flat in zip(p["cell"], p["part"], p["ids"], p["flat"]):
                ids, v = unpacked(ids, flat)
                row, n, s = _best(ids, v, ids, v, k)
                worst = np.full(len(ids), np.inf)
                full = np.bincount(row, minlength=len(ids)) == k
                last = np.full(len(ids), np.inf)
                np.minimum.at(last, row, s)
                worst[full] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * last[full]))
                need = away(v) - radius[None, :] <= worst[:, None] + SLACK
                found = [[] for _ in ids]
                for r, other, sim in zip(row, n, s):
                    found[r].append((int(other), float(sim)))
                wants = np.flatnonzero(need.any(axis=0))
                yield pd.DataFrame({"cell": [cell], "part": [part], "q": [ids], "found": [found], "least": [np.where(full, last, -np.inf)], "wants": [wants.astype(np.int32)], "rows": [[np.flatnonzero(need[:, c]).astype(np.int32) for c in wants]]})

    first = written(blocks.mapInPandas(own, "cell int, part int, q array<long>, found array<array<struct<n: long, s: double>>>, least array<double>, wants array<int>, rows array<array<int>>"), "own")
    mine = first.select(F.explode(F.arrays_zip("q", "found")).alias("x")).select(F.col("x.q").alias("q"), F.explode("x.found").alias("f")).select("q", "f.n", "f.s")
    n_blocks = sum(max(1, -(-n // block)) for n, _ in sizes.values())
    tile = F.pmod(F.xxhash64("cell", "part"), F.lit(-(-n_blocks // max(1, min(TILE, n_blocks // 16))))).cast("int").alias("tile")
    slices = -(-n_blocks // SLICE)
    tiles = first.join(blocks.select("cell", "part", "flat"), ["cell", "part"]).select("cell", "part", tile, "q", F.col("flat").alias("qv"), "least", "wants", "rows")
    left = tiles.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = first.select(tile, F.explode("wants").alias("cell")).distinct()
    right = blocks.join(asked, "cell").select("tile", F.pmod(F.xxhash64("part", "cell"), F.lit(slices)).cast("int").alias("slice"), *[F.col(c).alias(f"n_{c}") for c in ("cell", "part", "ids", "flat")])

    def others(tile: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.array([], np.int64), "n": np.array([], np.int64), "s": np.array([], np.float64)})]
        near = [(c, p, *unpacked(ids, flat)) for c, p, ids, flat in zip(*(near[f"n_{c}"] for c in ("cell", "part", "ids", "flat")))]
        for cell, part, q, flat, least, wants, rows in zip(*(tile[c] for c in ("cell", "part", "q", "qv", "least", "wants", "rows"))):
            (q, a), least, rows = unpacked(q, flat), np.array(least, dtype=np.float64), dict(zip(wants, rows))
            found, more = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)), 0
            for c, p, ids, b in near:
                if c in rows and (c, p) != (cell, part):
                    at = np.asarray(rows[c], dtype=np.int64)
                    row, n, s = _above(a[at], b, least[at])
                    found = tuple(map(np.concatenate, zip(found, (at[row], ids[n], s))))
                    more += len(row)
                    if more > MANY:  # what lies below the k-th so far is out
                        found, more = _first(*found, k), 0
                        ends = np.flatnonzero(np.bincount(found[0], minlength=len(q)) == k)
                        np.maximum.at(least, ends, found[2][np.searchsorted(found[0], ends, side="right") - 1])
            row, n, s = _first(*found, k)
            out.append(pd.DataFrame({"q": q[row], "n": n, "s": s}))
        return pd.concat(out)

    met = left.groupBy("tile", "slice").cogroup(right.groupBy("tile", "slice")).applyInPandas(others, "q long, n long, s double")
    every = mine.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(id), F.col("n").alias("neighbour"), F.col("s").alias("similarity"), "rank")


def knn_graph(vectors: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", pivots: int = 64, block: int = 512) -> DataFrame:
    """(src, dst, similarity, times): both directions of each row's k nearest; times is 2 where each is among the other's."""
    found = written(nearest(vectors, k, id, vector, pivots, block), "nearest")
    both = found.select(F.col(id).alias("src"), F.col("neighbour").alias("dst"), "similarity").union(found.select("neighbour", id, "similarity"))
    return both.groupBy("src", "dst").agg(F.max("similarity").alias("similarity"), F.count("*").alias("times"))
