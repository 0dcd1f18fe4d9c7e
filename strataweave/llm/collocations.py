"""Phrase collocation mining over depth-truncated suffix trees, partitioned vertically as ERA does.

A suffix begins at each word of a piece and is cut after ``longest`` (3) words. Suffixes that share a prefix form a subtree;
prefixes are grouped so that each group's suffixes fit a memory budget, and each group's subtree is built by itself, in one
task, by sorting: equal suffixes are one leaf, and a node's count is the total of the leaves below it.

1. Words are counted. Words are known by two 64-bit hashes, seeded by their language, so everything below is per language.
2. A word that begins more suffixes than a quarter of the budget is too large a prefix: its suffixes are divided by their second word,
   and those pairs are counted. A pair that is still too large is divided by its third word, which is a leaf.
3. Prefixes in the order of their hashes are cut into groups of at most the budget, by the counts of cells of hashes.
4. Each task of a second pass over the texts cuts suffixes behind the first word that is too rare to be part of a candidate
   (a bit filter tells most of those; what it lets through only costs work), adds up equal ones, and deals them to the groups.
5. Subtrees give the counts of all phrases of two and three words that stand there ``least`` times. A candidate meets the
   counts of its parts in joins on hashes, its score is decimal arithmetic of 38 digits, and words get their strings in a
   third pass that looks for the words of the first ``top`` phrases and their ties only.

Defined results: null and empty texts, and pieces without words, hold nothing; null languages are ``und``, as are rows that
say so; texts are read whole, and phrases never reach over the end of a piece or a text; rows that repeat count as often as they stand there;
ties are resolved by count and then by the phrase's bytes; an empty table gives an empty result; columns beyond text and
language are not looked at.

Exactness: two words of one language with an equal first hash differ in the second one, which is compared for every word; the
hashes are then seeded anew. Bounds: the budget is ``BUDGET`` suffixes, or a millionth of all words if that is more, so at most about
2 million borders of groups and 4 million large prefixes (8 or 16 bytes each) go to the tasks; the filter has ``FILTER_BITS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.llm.common import bounded_batches, byte_class, mix, sliced, utf8_column, written

#: Suffixes in a group at least aimed at, the most groups, suffixes held by a task before they are added up, bits of the filter.
BUDGET, GROUPS, HELD, FILTER_BITS = 1 << 17, 1 << 20, 1 << 19, 1 << 26
PIECE = 1 << 19
BREAK = byte_class(lambda b: b in b".,;:!?" or 10 <= b <= 13)
WORD = byte_class(lambda b: b not in b" \t" and not BREAK[b])

# ---------------------------------------------------------------- words


def _noise(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    step = int(mix(np.array([seed * 2 + 1], np.uint64))[0]) | 5
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(n, f, np.uint64)) for f in (step, pow(step, -1, 1 << 64)))
        noise = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return noise[lower], up, down


class Words:
    """Takes texts apart: ``start``, ``end``, the hash of each word seeded by its text's language, and whether the next word follows in the same piece."""

    def __init__(self, seed: int, checked: bool = False):
        self.seeds, self.tables, self.size = [2 * seed, 2 * seed + 1][: 1 + checked], [], 0

    def _sized(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.tables = [_noise(s, n) for s in self.seeds]

    def __call__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray):
        n, a, parts = len(data), 0, []
        border = np.zeros(n + 1, bool)
        border[at] = True
        while a < n:
            z = min(n, a + PIECE)
            while z < n and WORD[data[z - 1]] and WORD[data[z]] and not border[z]:
                more = np.flatnonzero(~WORD[data[z : z + PIECE]] | border[z : min(n, z + PIECE)])
                z = z + int(more[0]) if len(more) else min(n, z + PIECE)
            self._sized(z - a)
            b, cut = data[a:z], border[a : z + 1]
            w = WORD[b]
            s = np.flatnonzero(w & (cut[:-1] | np.concatenate(([True], ~w[:-1]))))
            e = np.flatnonzero(w & (cut[1:] | np.concatenate((~w[1:], [True])))) + 1
            owner = np.searchsorted(at, s + a, side="right") - 1
            hashes = []
            with np.errstate(over="ignore"):
                for noise, up, down in self.tables:
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(noise[b] * up[: z - a])))
                    hashes.append(np.maximum(mix(((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)) ^ lang[owner]), np.uint64(1)))  # 0 stands for no word
            parts.append((s + a, e + a, owner, *hashes))
            a = z
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * len(self.seeds) + (np.zeros(0, bool),)
        out = [np.concatenate(x) for x in zip(*parts)]
        breaks = np.concatenate(([0], np.cumsum(BREAK[data])))
        follows = np.zeros(len(out[0]), bool)
        follows[:-1] = (out[2][:-1] == out[2][1:]) & (breaks[out[0][1:]] == breaks[out[1][:-1]])
        return *out, follows


def _texts(batches: Iterator[pa.RecordBatch], words: Words):
    """The words of batches of (language hash, text), a few MiB at a time."""
    for batch in batches:
        for part in sliced(batch, 1, 1 << 20):
            data, at = utf8_column(part.column(1))
            yield data, words(data, at, part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), part


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _in_pieces(columns: list[np.ndarray], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([_as_long(c[a : a + rows]) for c in columns], names=names)


class Sums:
    """Adds up the counts of equal rows of hashes in a task, and lets them go when HELD rows are there."""

    def __init__(self, keys: int):
        self.keys, self.held, self.n = keys, [], 0

    def add(self, rows: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        self.held.append((*rows, np.ones(len(rows[0]), np.int64) if counts is None else counts))
        self.n += len(rows[0])

    def taken(self, least: int) -> Iterator[list[np.ndarray]]:
        """The sorted rows with their sums, if there are at least so many; those that shrink well stay for a while."""
        if self.n and self.n >= least:
            merged = merge([np.concatenate(x) for x in zip(*self.held)])
            if least and len(merged[0]) < least // 2:
                self.held, self.n = [tuple(merged)], len(merged[0])
            else:
                self.held, self.n = [], 0
                yield merged


def merge(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The rows sorted by all columns but the last; equal ones are one, with the sum of the last."""
    *keys, counts = rows
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    first = np.flatnonzero(changes(keys))
    return [k[first] for k in keys] + [np.add.reduceat(counts[order], first) if len(first) else counts]


def changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns begin that differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _counted_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(3)
        for _, (_, _, owner, h, c, _), part in _texts(batches, Words(seed, checked=True)):
            lang = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums.add([h, lang[owner].view(np.uint64), c])
            for x in sums.taken(HELD):
                yield from _in_pieces(x, ["h", "g", "c", "f"])
        for x in sums.taken(0):
            yield from _in_pieces(x, ["h", "g", "c", "f"])

    return run


# ---------------------------------------------------------------- prefixes and their groups


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of a prefix that is extended by one word."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def within(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which x are among ``found``, which is sorted."""
    if not len(found):
        return np.zeros(len(x), bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


class Frequent:
    """A bit filter on the upper bits of hashes: false only for words that are too rare."""

    def __init__(self, hashes: DataFrame):
        place = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - (FILTER_BITS.bit_length() - 1)))
        cells = hashes.select(F.call_function("shiftright", place, F.lit(5)).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit"))
        got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 32 rows at most
        self.bits = np.zeros(FILTER_BITS // 32, np.uint32)
        self.bits[got.column("cell").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))
        return (self.bits[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def _pairs_of_large(seed: int, shared):
    """Counts of pairs whose first word is too large a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, large = shared.value
        sums = Sums(2)
        for _, (_, _, _, h, follows), _ in _texts(batches, Words(seed)):
            at = np.flatnonzero(follows)
            at = at[within(h[at], large)]
            at = at[frequent(h[at + 1])]
            sums.add([h[at], h[at + 1]])
            for x in sums.taken(HELD):
                yield from _in_pieces(x, ["h1", "h2", "f"])
        for x in sums.taken(0):
            yield from _in_pieces(x, ["h1", "h2", "f"])

    return run


def _cells(found: DataFrame, place: Column, bits: int) -> np.ndarray:
    """The sums of f by the upper bits of a place: 2**bits rows at most come to the driver."""
    cell = F.call_function("shiftrightunsigned", place, F.lit(64 - bits))
    got = found.groupBy(cell.alias("cell")).agg(F.sum("f").alias("f")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[got.column("cell").to_numpy()] = got.column("f").to_numpy()
    return out


def _with_place(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, _as_long(joint(h1, h2))], names=["h1", "h2", "f", "place"])

    return pairs.select("h1", "h2", "f").mapInArrow(run, "h1 long, h2 long, f long, place long")


def borders(load: np.ndarray, budget: int) -> np.ndarray:
    """The first cell of each group: cells in order, as many as fit the budget, at least one."""
    out, held = [0], 0
    for i, n in enumerate(load.tolist()):
        if held and held + n > budget:
            out.append(i)
            held = 0
        held += n
    return np.array(out, np.uint64)


# ---------------------------------------------------------------- suffixes and subtrees


def _dealt(seed: int, shared):
    """Suffixes of two or three words, added up and packed by group: a row for each group, its suffixes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, large, larger, firsts, shift, _ = shared.value
        sums = Sums(3)

        def packed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            place = rows[0].copy()
            for deeper, known in ((1, large), (2, larger)):
                split = within(place if deeper == 2 else rows[0], known)
                place[split] = joint(place[split], rows[deeper][split])
            group = np.searchsorted(firsts, place >> shift, side="right") - 1
            order = np.argsort(group, kind="stable")
            group = group[order]
            first = np.flatnonzero(changes([group]))
            ends = np.append(first[1:], len(group))
            columns = [c[order] for c in rows]
            for i in range(0, len(first), 128):
                blocks = [pa.array([c[a:z].tobytes() for a, z in zip(first[i : i + 128], ends[i : i + 128])], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(group[first[i : i + 128]].astype(np.int64)), *blocks], names=["group", "h1", "h2", "h3", "n"])

        for _, (_, _, _, h, follows), _ in _texts(batches, Words(seed)):
            fit = frequent(h)
            pair = follows & fit
            pair[:-1] &= fit[1:]
            at = np.flatnonzero(pair)  # neither the last word nor one before a rare one
            three = pair[at + 1]
            third = np.where(three, h[np.minimum(at + 2, len(h) - 1)] if len(h) else h, np.uint64(0))
            sums.add([h[at], h[at + 1], third])
            for x in sums.taken(HELD):
                yield from packed(x)
        for x in sums.taken(0):
            yield from packed(x)

    return run


def _subtree(least: int, shared):
    """The nodes of a group's subtree that count ``least`` at least: pairs (h3 null), and triples with their pair's count."""

    def run(table: pa.Table) -> pa.Table:
        larger, known = shared.value[2], shared.value[5]
        h1, h2, h3, n = merge([np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64 if c == "n" else np.uint64) for c in ("h1", "h2", "h3", "n")])  # the leaves in order
        first = np.flatnonzero(changes([h1, h2]))
        total = np.add.reduceat(n, first)
        place = joint(h1[first], h2[first])
        elsewhere = within(place, larger)  # has leaves in other groups, too
        total[elsewhere] = known[np.searchsorted(larger, place[elsewhere])]
        leaf = np.flatnonzero((n >= least) & (h3 != 0))
        of = np.searchsorted(first, leaf, side="right") - 1
        pair = first[(total >= least) & ~elsewhere]
        both = np.concatenate((pair, leaf))
        triple = np.arange(len(both)) >= len(pair)
        a = np.concatenate((total[(total >= least) & ~elsewhere], n[leaf]))
        parent = np.concatenate((np.zeros(len(pair), np.int64), total[of]))
        return pa.table([_as_long(h1[both]), _as_long(h2[both]), pa.array(h3[both].view(np.int64), mask=~triple), pa.array(a), pa.array(parent, mask=~triple)], names=["h1", "h2", "h3", "a", "parent"])

    return run


# ---------------------------------------------------------------- strings of words


def _spelled(seed: int, shared):
    """(h, word) for the words that a filter lets through, each once or so in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, np.zeros(0, np.uint64)
        for data, (start, end, _, h, _), _ in _texts(batches, Words(seed)):
            at = np.flatnonzero(wanted(h))
            found, once = np.unique(h[at], return_index=True)
            new = ~within(found, seen)
            at = at[once[new]]
            seen = np.union1d(seen if len(seen) < HELD else seen[:0], found)
            low = [data[a:z].tobytes().lower() for a, z in zip(start[at].tolist(), end[at].tolist())]  # bytes: ASCII letters only
            yield pa.RecordBatch.from_arrays([_as_long(h[at]), pa.array(low, pa.binary())], names=["h", "word"])

    return run


# ---------------------------------------------------------------- the operator


def mine(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    with bounded_batches(documents.sparkSession):  # every pass ends in a written table
        return _mined_exactly(documents, text, lang, least, covered_percent, top)


def _mined_exactly(documents: DataFrame, text: str, lang: str, least: int, covered_percent: int, top: int) -> DataFrame:
    for seed in range(1, 9):
        g = F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.lit(seed)).alias("g")
        texts = documents.select(g, F.col(text).alias("text"))
        words = texts.mapInArrow(_counted_words(seed), "h long, g long, c long, f long").groupBy("h")
        words = written(words.agg(F.sum("f").alias("f"), F.min("g").alias("g"), ((F.min("g") < F.max("g")) | (F.min("c") < F.max("c"))).alias("clash")), "collocations-words")
        langs = written(documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), g).distinct(), "collocations-languages")
        if words.where("clash").isEmpty() and langs.groupBy("g").count().where("count > 1").isEmpty():
            return _mined(texts, words, langs, seed, least, covered_percent, top)
    raise RuntimeError("words share both hashes under eight seeds")


def _mined(texts: DataFrame, words: DataFrame, langs: DataFrame, seed: int, least: int, covered_percent: int, top: int) -> DataFrame:
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    held = lambda rows, column: np.sort(rows.select(column).toArrow().column(0).to_numpy().view(np.uint64))
    often = words.where(F.col("f") >= least).select("h", "f")
    n = words.agg(F.sum("f")).first()[0] or 0
    budget = max(BUDGET, n // GROUPS)
    most = budget // 4  # suffixes of one prefix, so that groups come near their budget
    frequent = Frequent(often)
    large = held(often.where(F.col("f") > most), "h")  # n / most of them at most
    if len(large):
        pairs = texts.mapInArrow(_pairs_of_large(seed, share((frequent, large))), "h1 long, h2 long, f long").groupBy("h1", "h2").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        pairs = written(_with_place(pairs), "collocations-pairs")
    else:
        pairs = spark.createDataFrame([], "h1 long, h2 long, f long, place long")
    divided = pairs.where(F.col("f") > most)
    top_pairs = divided.select("place", "f").toArrow()  # n / most of them at most
    larger, known = top_pairs.column(0).to_numpy().view(np.uint64), top_pairs.column(1).to_numpy()
    order = np.argsort(larger)
    larger, known = larger[order], known[order]
    bits = min(21, max(4, (16 * n // budget).bit_length()))
    load = _cells(often.where(F.col("f") <= most), F.col("h"), bits) + _cells(pairs.where(F.col("f") <= most), F.col("place"), bits) + int(known.sum()) // (1 << bits)
    shared = share((frequent, large, larger, borders(load, budget), np.uint64(64 - bits), known))
    dealt = texts.mapInArrow(_dealt(seed, shared), "group long, h1 binary, h2 binary, h3 binary, n binary")
    nodes = dealt.groupBy("group").applyInArrow(_subtree(least, shared), "h1 long, h2 long, h3 long, a long, parent long")
    nodes = written(nodes.union(divided.select("h1", "h2", F.lit(None).cast("long"), F.col("f"), F.lit(None).cast("long"))), "collocations-nodes")

    two, three = nodes.where("h3 is null"), nodes.where("h3 is not null")
    inside = three.select(F.explode(F.array(F.struct("h1", "h2", "a"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))).alias("p")).select("p.*")
    inside = inside.groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    kept = two.join(inside, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))).select("h1", "h2", "h3", "a", "parent", F.lit(None).cast("long").alias("rest"))
    kept = kept.union(three.join(two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("rest")), ["h2", "h3"]).select("h1", "h2", "h3", "a", "parent", "rest"))
    one = words.where(F.col("f") >= least)
    scored = kept.withColumn("last", F.coalesce("h3", "h2")).join(one.select(F.col("h").alias("h1"), "g", F.col("f").alias("begin")), "h1").join(one.select(F.col("h").alias("last"), F.col("f").alias("end")), "last")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "begin", "end", "parent", "rest")}
    scored = scored.withColumns({f"_{c}": v for c, v in wide.items()})
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * _a * _a) div (_{l} * _{r})")  # noqa: E731, E741
    scored = scored.withColumns({"_first": F.when(F.col("h3").isNull(), score("begin", "end")).otherwise(score("begin", "rest")), "_second": F.when(F.col("h3").isNotNull(), score("parent", "end"))})
    later = F.col("h3").isNotNull() & (F.col("_second") < F.col("_first"))
    scored = scored.select("h1", "h2", "h3", "g", "a", F.when(later, F.col("parent")).otherwise(F.col("begin")).alias("l"), F.when(F.col("h3").isNull() | later, F.col("end")).otherwise(F.col("rest")).alias("r"), F.when(later, F.col("_second")).otherwise(F.col("_first")).alias("score"))
    place = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"))
    best = written(scored.withColumn("_place", F.rank().over(place)).where(F.col("_place") <= top).drop("_place"), "collocations-best")  # with all ties

    wanted = best.select(F.explode(F.array("h1", "h2", "h3")).alias("h")).where("h is not null").distinct()
    spelled = texts.mapInArrow(_spelled(seed, share(Frequent(wanted))), "h long, word binary").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("word").alias("word"))
    spelled = written(spelled, "collocations-spelled")
    for i in (1, 2, 3):
        best = best.join(spelled.select(F.col("h").alias(f"h{i}"), F.col("word").cast("string").alias(f"w{i}")), f"h{i}", "left")
    sums = words.groupBy("g").agg(F.sum("f").alias("n"))
    out = best.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).join(sums, "g").join(langs, "g")
    by = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return out.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
