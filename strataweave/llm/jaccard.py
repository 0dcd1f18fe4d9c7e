"""Exact n-gram Jaccard join with PartEnum signatures.

Two sets of sizes a and b with a Jaccard similarity of at least t differ in at most (a + b)(1 - t)/(1 + t) elements,
which is at most k(n) = floor(n (1 - t) / t) for a set of n elements and whatever partner (n/4 at 0.8). Sets whose
sizes fall into one band share a hash partition of the element domain on two levels: F first-level parts with 2F > k
for the band's largest set, and SECOND = 3 second-level parts in each. All subsets of two of the three second-level
parts of each first-level part are enumerated; a signature is such a subset with what the set holds in it, so 3F for a
set. One differing second-level part leaves one of a first-level part's three subsets alike, two leave none: k
differences spoil min(2k, F + k) of the 3F signatures at most, and one is always shared. In one fixed order of
signatures (most elements first, then by hash) the first min(2k, F + k) + 1 of both sets must therefore share one, and
only these are kept, which drops those of few elements or none. A set near the upper end of its band also belongs to
the next one, so that no pair is split by a border. Nothing is lost whatever the contents.

How pairs are found without writing down all pairs of a group:

1. Documents with the same set form a class at once, by fingerprint; one of them signs.
2. Rows (signature, id) are dealt by signature, once. Signatures that a sample of documents shows to be hot are dealt
   by id too, and their parts combined afterwards; this only balances the load.
3. In each group of a signature, all members are compared with the smallest of them (a star). The links found give
   components.
4. Groups whose members still fall into different components are searched further: members outside the component of
   the group's smallest with each other and with that component, in blocks of at most ``BLOCK`` members, by histograms
   of their elements: the histograms' L1 distance never exceeds the sets' difference, so it excludes pairs safely. What
   remains is compared exactly.

The similarity is always that of the whole sets. Fingerprints and elements are hashes of 128 and 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.llm.common import SPACED, fixed_width, hash_words, mix, shingle_sets, sliced, small_batches, utf8_column, written

#: Sizes of a band reach from its lower end to BAND times that; each first-level part has SECOND second-level ones.
BAND, SECOND, NEXT = 1.953125, 3, [1, 2, 0]
#: Bins of the histogram (folded to COARSE for a first look), members of a block, parts of a hub's groups, bits of a filter of ids.
BINS, COARSE, BLOCK, PARTS, FILTER_BITS = 256, 64, 512, 8, 1 << 24
#: One document in SAMPLE shows which signatures are hot, HOT at most; their rows are dealt into SALTS parts.
SAMPLE, HOT, SALTS = 64, 50_000, 16


def band_starts(n: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= n:
        starts.append(int(starts[-1] * BAND) + 1)
    return np.array(starts)


def signatures(elements: np.ndarray, percent: int, starts: np.ndarray) -> list[np.ndarray]:
    """The signatures of one set, for each band that it belongs to. ``starts`` must reach beyond the set's size."""
    n, out = len(elements), []
    k = n * (100 - percent) // percent
    band = int(np.searchsorted(starts, n, side="right")) - 1
    last = int(starts[band + 1]) - 1
    with np.errstate(over="ignore"):
        for b in (band, band + 1) if n * 100 >= last * percent - 100 else (band,):
            top = int(starts[b + 1]) - 1 if b + 1 < len(starts) else int(last * BAND) + 1
            first = top * (100 - percent) // percent // 2 + 1
            salt = np.uint64(b * 0x9E3779B9 + 0x51ED27)
            mixed = mix(elements ^ salt)
            part = (mixed % np.uint64(SECOND * first)).astype(np.int64)
            held = np.bincount(part, minlength=SECOND * first)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(mixed + salt)[np.argsort(part, kind="stable")])))
            ends = np.cumsum(held)
            content = mix(total[ends] - total[ends - held] + (np.arange(len(held), dtype=np.uint64) << np.uint64(8)) + np.uint64(b)).reshape(first, SECOND)
            pairs = mix(content + mix(content[:, NEXT])).ravel()
            held = held.reshape(first, SECOND)
            both = (held + held[:, NEXT]).ravel()
            out.append(pairs[np.lexsort((pairs, -both))[: min(2 * k, first + k) + 1]])
    return out


def histogram(elements: np.ndarray) -> bytes:
    """How many elements fall in each bin, 255 at most: the L1 distance of two is a lower bound of the sets' difference."""
    return np.minimum(np.bincount((elements & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def sets_of(batch: pa.RecordBatch, column: int, size: int) -> list[np.ndarray]:
    data, at = utf8_column(batch.column(column))
    return shingle_sets(*hash_words(data, at, SPACED), size)


def fingerprint(elements: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix(elements).sum(), mix(elements ^ np.uint64(0xA5A5A5A5)).sum() + np.uint64(len(elements))], np.uint64).tobytes()


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 1)):
            prints, bins, counts = [], [], []
            for s in sets_of(batch, 1, size):
                prints.append(fingerprint(s) if len(s) else None)
                bins.append(histogram(s))
                counts.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bins, pa.binary())], ["id", "n", "print", "bins"])

    return run


DESCRIBED = "id long, n long, print binary, bins binary"


def place_of(id: str) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(FILTER_BITS)).cast("int")


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size: for each of the ids, the bit at its place is set."""
    place = place_of("id")
    words = ids.select(F.floor(place / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place % 32).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(FILTER_BITS // 32, np.uint32)  # FILTER_BITS at most come to the driver, whatever the input
    got = words.toArrow()
    filled[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return filled


def _where_bit(batch: pa.RecordBatch, filled: np.ndarray, value: bool) -> pa.RecordBatch:
    """The rows (id, text, place) whose bit is set, or is not."""
    at = batch.column(2).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(((filled[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) != 0) == value))


def _signed(size: int, percent: int, skip: np.ndarray | None, hot: np.ndarray | None = None):
    """(sig, id, part) for each text's signatures; part is -1, or for the ``hot`` signatures (sorted) one of SALTS by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, seen = band_starts(1 << 16), set()
        for batch in (x for b in batches for x in sliced(b, 1)):
            if skip is not None:
                batch = _where_bit(batch, skip, False)
            ids, found, owners = batch.column(0), [], []
            for i, s in enumerate(sets_of(batch, 1, size)):
                if not len(s) or not ids[i].is_valid:
                    continue
                mark = fingerprint(s)
                if mark in seen:  # a copy within the task: the class has it already
                    continue
                if len(seen) < 50_000:
                    seen.add(mark)
                if len(s) * 2 >= starts[-2]:
                    starts = band_starts(len(s) * 4)
                for x in signatures(s, percent, starts):
                    found.append(x)
                    owners.append(np.full(len(x), ids[i].as_py(), np.int64))
            sig, own = (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            sig, part = sig.view(np.int64), np.full(len(sig), -1, np.int32)
            if hot is not None and len(hot):
                known = hot[np.minimum(np.searchsorted(hot, sig), len(hot) - 1)] == sig
                part[known] = (mix(own[known].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
            for a in range(0, max(len(sig), 1), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (sig, own, part)], ["sig", "id", "part"])

    return run


SIGNED = "sig long, id long, part int"


def _hot(sample: DataFrame) -> np.ndarray:
    """The signatures that hold more than one in HOT of the sample's rows, and eight rows at least: HOT of them at most."""
    counts = written(sample.groupBy("sig").count(), "jaccard-sample")
    rows = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return np.sort(counts.where(F.col("count") >= max(8, -(-rows // HOT))).select("sig").toArrow().column("sig").to_numpy().astype(np.int64))


def _groups(signed: DataFrame) -> DataFrame:
    """(sig, id, hub) of the signatures that several documents have; the hub is the smallest id.

    One exchange by signature and part. The parts of hot signatures, each with its smallest and largest id, then meet
    in an aggregate of HOT * SALTS rows at most. An id that signs twice alike stays twice, which later steps take as once.
    """
    w = Window.partitionBy("sig", "part")
    dealt = signed.select("sig", "id", "part", F.min("id").over(w).alias("hub"), F.max("id").over(w).alias("last"))
    dealt = written(dealt.where("hub != last or part >= 0"), "jaccard-groups")
    cold, hot = dealt.where("part < 0").select("sig", "id", "hub"), dealt.where("part >= 0")
    hubs = written(hot.groupBy("sig").agg(F.min("hub").alias("hub"), F.max("last").alias("last")).where("hub != last").select("sig", "hub"), "jaccard-hubs")
    return cold.union(hot.select("sig", "id").join(F.broadcast(hubs), "sig").select("sig", "id", "hub"))  # HOT rows at most


def _excluded(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) * (100 + percent) > (100 - percent) * sizes


def _pairs_of(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each block from different components that sizes and histograms don't exclude, each once."""
    hub, low, high, sig, id, part, size, block = (batch.column(c).to_numpy() for c in ("hub", "low", "high", "sig", "id", "component", "n", "own"))
    bins = fixed_width(batch.column("bins"), BINS)
    ids, one, own = np.unique(id, return_index=True, return_inverse=True)
    part, size, bins = part[one], size[one], bins[one]
    coarse = bins.reshape(len(ids), COARSE, -1).sum(axis=2, dtype=np.uint16)
    first = np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (sig[1:] != sig[:-1]))))
    later = np.repeat(np.append(first[1:], len(sig)), np.diff(np.append(first, len(sig)))) - np.arange(len(sig)) - 1  # each row meets the later ones of its block
    done, found, a = np.concatenate(([0], np.cumsum(later))), [np.zeros(0, np.int64)], 0
    while a < len(sig):
        z = max(a + 1, int(np.searchsorted(done, done[a] + 1_000_000, side="right")) - 1)
        left = np.repeat(np.arange(a, z), later[a:z])
        right = left + 1 + np.arange(len(left)) - (done[left] - done[a])
        cross = (low[left] == high[left]) | (block[left] != block[right])
        left, right = own[left[cross]], own[right[cross]]
        ok = (part[left] != part[right]) & (100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right]))
        code = np.unique(np.minimum(left[ok], right[ok]) * len(ids) + np.maximum(left[ok], right[ok]))
        for i in range(0, len(code), 50_000):
            c = code[i : i + 50_000]
            for table in (coarse, bins):
                x, y = c // len(ids), c % len(ids)
                c = c[~_excluded(table[x], table[y], size[x] + size[y], percent)]
            found.append(c)
        if len(found) > 50:
            found = [np.unique(np.concatenate(found))]
        a = z
    code = np.unique(np.concatenate(found))
    for i in range(0, len(code), 100_000):
        c = code[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[c // len(ids)]), pa.array(ids[c % len(ids)])], ["a", "b"])


def _near(percent: int):
    """The pairs of rows sorted by hub, low, high and sig, a run of whole blocks of about 20,000 rows at a time."""
    keys = ("hub", "low", "high", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in (b.slice(i, 10_000) for b in batches for i in range(0, b.num_rows, 10_000)):
            if rows >= 20_000:  # up to the last row of the block that the held rows end in
                ends, same = [held[-1].column(k)[-1].as_py() for k in keys], np.ones(batch.num_rows, bool)
                for k, v in zip(keys, ends):
                    same &= batch.column(k).to_numpy() == v
                cut = batch.num_rows if same.all() else int(np.argmin(same))
                held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield from _pairs_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], percent)
                    held, rows = [], 0
                batch = batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield from _pairs_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], percent)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return run


def links(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough.

    The texts whose sets are needed are found by a bit filter of fixed size, then exactly by a join.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    filled = bit_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(_where_bit(b, filled, True), 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets_of(batch, 1, size)], pa.binary())], ["id", "elements"])

    texts = documents.where("id is not null and text is not null").select("id", "text", place_of("id").alias("place"))
    sets = written(texts.mapInArrow(run, "id long, elements binary").where("length(elements) > 0").join(ids, "id", "left_semi"), "jaccard-sets")
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of the edges (a, b): the smallest id that the links reach.

    Alternating large-star and small-star steps: each round halves the depth of the trees, links never multiply, and
    both steps aggregate before they move rows.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-links")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "jaccard-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        mark = now


def _apart(documents: DataFrame, described: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, members, named): the rows with one text for each id, what describes those with words, and the pairs (id, number) of the texts that got a number of their own.

    A text gets one, above all ids, if its id has others with other sets. So the search never meets an id with several
    sets, and the numbers are linked with their ids, which stay the smallest of a component. Only texts of such ids move.
    """
    members = described.where("print is not null and id is not null")
    mixed = written(members.groupBy("id").agg((F.min("print") != F.max("print")).alias("mixed")).where("mixed").select("id"), "jaccard-mixed")
    if mixed.isEmpty():
        return documents, members, None
    filled, placed = bit_filter(mixed), documents.where("id is not null and text is not null").withColumn("place", place_of("id"))

    def where(bit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _where_bit(batch, filled, bit).select(["id", "text"])

        return placed.mapInArrow(run, "id long, text string")

    top = described.agg(F.max("id")).first()[0]
    own = where(True).join(mixed, "id", "left_semi").distinct()
    own = written(own.select("id", "text", (F.lit(top).cast("long") + 1 + F.monotonically_increasing_id()).alias("own")), "jaccard-own")
    alone = own.select(F.col("own").alias("id"), "text")
    about = written(alone.mapInArrow(_described(size), DESCRIBED).where("print is not null"), "jaccard-rows")
    rest = where(False).union(where(True).join(mixed, "id", "left_anti"))
    return rest.union(alone), members.join(mixed, "id", "left_anti").unionByName(about), own.select(F.col("id").alias("a"), F.col("own").alias("b"))


def join(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id_column, n_shingles, component_id) for each row of ``documents``.

    Words are runs of characters other than space and 09 to 0D, lower-cased from A to Z; the set of a text is that of
    its runs of ``size`` words, one shorter run if it has fewer, none without words or text. Rows link when
    ``100 * intersection >= percent * union``; component_id is the smallest id reachable.

    Defined results: rows without words link with nothing and are their own component. Rows that share an id are one
    node of the graph: a link of any of their texts holds for it (such ids must stay some billions below the largest long). A row without id links with nothing and has
    component null. Rows equal in id and text give equal rows. A very long text is whole: it is one set, however large.
    Ties cannot matter, as components are named by their smallest id. Other columns, whatever their names, are not
    looked at. An empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    documents = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    described = written(documents.mapInArrow(_described(size), DESCRIBED), "jaccard-rows")
    documents, members, named = _apart(documents, described, size)
    same = members.groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("print", "first")
    copies = members.join(same, "print").select(F.col("first").alias("a"), F.col("id").alias("b")).where("a != b")

    # Only one document of each class signs. The others are set apart by a bit filter, which may hold a few too many:
    # those, and only those, take an exact join.
    shape = members.groupBy("id").agg(F.min("n").alias("n"), F.min("bins").alias("bins"))
    skip = written(copies.select(F.col("b").alias("id")), "jaccard-skip")
    filled, placed = bit_filter(skip), documents.where("id is not null and text is not null").withColumn("place", place_of("id"))

    def maybe_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _where_bit(batch, filled, True).select(["id", "text"])

    doubtful = placed.mapInArrow(maybe_copies, "id long, text string").join(skip, "id", "left_anti")
    shown = placed.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    hot = _hot(shown.mapInArrow(_signed(size, percent, filled), SIGNED))
    signed = placed.mapInArrow(_signed(size, percent, filled, hot), SIGNED).union(doubtful.mapInArrow(_signed(size, percent, None, hot), SIGNED))
    groups = _groups(signed)
    star = groups.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = _possible(star, shape, percent)
    found = copies.union(links(near, documents, size, percent))
    found = written(found if named is None else found.union(named), "jaccard-found")
    first = components(found)

    # The groups that the star left torn: their members with their components, and how many lie outside the hub's one.
    placed = groups.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main"))
    whole = written(whole.where("low != high").select("sig", "main"), "jaccard-torn")
    torn = written(placed.join(whole, "sig"), "jaccard-members")
    outside = F.col("component") != F.col("main")
    blocks = written(torn.groupBy("sig").agg(F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(~outside) / BLOCK).cast("int").alias("main_blocks")), "jaccard-blocks")
    # Blocks of members outside come first, then those of the main component, which meet only the former.
    laid = torn.join(blocks, "sig").withColumn("own", F.when(outside, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("main_blocks"))).cast("int"))
    rest = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("blocks") + F.col("main_blocks")).otherwise(F.col("blocks")) - 1)))
    rest = rest.join(shape, "id").select("hub", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig", "id", "component", "n", "bins")
    # The groups of near copies mostly share their smallest member: dealt by it, in a few parts, a pair meets in few tasks and is kept once in each.
    dealt = rest.repartition("hub", F.pmod(F.xxhash64("sig"), F.lit(PARTS)), "low", "high").sortWithinPartitions("hub", "low", "high", "sig")
    pairs = dealt.mapInArrow(_near(percent), "a long, b long").distinct()
    pairs = written(pairs, "jaccard-pairs")
    more = links(pairs, documents, size, percent)
    whole = components(found.union(more))
    return described.join(whole, "id", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _possible(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Drops pairs that sizes and histograms exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 5000) for b in batches for i in range(0, b.num_rows, 5000)):
            x, y = (fixed_width(batch.column(c), BINS) for c in ("x", "y"))
            apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(apart * (100 + percent) <= (100 - percent) * n)).select(["a", "b"])

    side = lambda id, n, bins: shape.select(F.col("id").alias(id), F.col("n").alias(f"n{n}"), F.col("bins").alias(bins))
    met = pairs.join(side("a", 1, "x"), "a").join(side("b", 2, "y"), "b")
    met = met.where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    return met.select("a", "b", "x", "y", F.expr("n1 + n2").alias("n")).mapInArrow(run, "a long, b long")
