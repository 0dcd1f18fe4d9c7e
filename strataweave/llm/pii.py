"""Personal data: patterns for direct identifiers, and terms of the corpus that disclose them.

The base patterns find e-mail addresses, IP addresses, card and telephone numbers. Each value found is a protected
entity. The unit of co-occurrence is the passage, ``PASSAGE`` words of a text: over all passages of the corpus, p(t),
p(e) and p(t, e) are the shares that hold a term, an entity and both. The point-wise mutual information
log p(t, e) / (p(t) p(e)) says how much of the entity's information -log p(e) the term gives away. Terms that give
away at least ``disclosure`` of it become spans of their own in the passages that they share with the entity, if so
many meetings are no chance: by Chernoff's bound for a Poisson number of meetings, at level ``alpha`` divided by the
number of pairs looked at, so that the bar rises with the corpus. ``redact`` generalises entities to their kind and
removes disclosing terms.

The corpus is read twice: for the entities (texts that hold any are kept in a table), and for the passage counts of
all terms. Bit filters of fixed size pick entities and pairs before any row moves; they let some through too much,
which exact joins remove. Counts are summed before they are shuffled, so a very common entity or term is no hot key,
and pairs are bounded by the words of a passage, whatever the length of a text.

Defined results: null counts as empty text; every row is judged by itself, so repeated rows repeat results (and count
in the shares); a very long text is whole, as its passages; matches that begin at the same place (ties) are spans of
each kind; a term span never overlaps a base span; an empty table gives an empty result. Columns other than doc_id and
text, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import ALNUM, hash_words, mix, sliced, small_batches, utf8_column, written

KINDS = ("email", "ip", "card", "phone")
#: Words of a passage, bits of a filter.
PASSAGE, FILTER_BITS = 64, 1 << 22
# Fixed patterns of the four kinds. The e-mail's local part is looked up backwards from its @, as in any run of its
# characters the leftmost match begins at the run's first one; likewise an IP address begins at the start of its digits.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            out.append((start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in characters, the end exclusive."""
    out = [(0, a, z) for a, z in emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def hashes(values: list[str]) -> np.ndarray:
    """The same hashes of terms as ``hash_words`` gives for whole texts."""
    words, counts = hash_words(*utf8_column(pa.array(values, pa.large_string())), ALNUM)
    assert (counts == 1).all()
    return words.view(np.int64)


class Passages:
    """A text's terms in order, their places in characters, and which passage each span begins in."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        places = np.array([m.span() for m in TERM.finditer(text)], np.int64).reshape(-1, 2)
        self.start, self.end = places[:, 0], places[:, 1]
        self.of_span = np.searchsorted(self.end, [a for _, a, _ in spans], side="right") // PASSAGE
        covered = np.array(sorted((a, z) for _, a, z in spans), np.int64).reshape(-1, 2)
        last = np.maximum.accumulate(covered[:, 1]) if len(covered) else covered[:, 1]
        before = np.searchsorted(covered[:, 0], self.end) - 1  # the last span that begins before a term's end
        self.free = (before < 0) | (last[np.maximum(before, 0)] <= self.start) if len(covered) else np.ones(len(places), bool)

    def terms(self, passage: int) -> np.ndarray:
        """The places, in the order of the text, of the passage's terms that overlap no span."""
        lo = passage * PASSAGE
        return lo + np.flatnonzero(self.free[lo : lo + PASSAGE])


FOUND = "email int, ip int, card int, phone int, base string, spans array<int>, entities array<long>, passages array<int>, kept string"


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The base spans, for each its entity and passage, and the text itself where it has any."""
    for texts in batches:
        rows = []
        for text in texts:
            spans = base_spans(text) if text else []
            counts, entities, at = [sum(k == i for k, _, _ in spans) for i in range(4)], [], []
            if spans:
                # The characters of an entity that no term holds are spelt out, so that one term stands for it.
                entities = hashes([KINDS[k] + "".join(c if c.isalnum() else f"0x{ord(c):x}" for c in text[a:z].lower()) for k, a, z in spans]).tolist()
                at = Passages(text, spans).of_span.tolist()
            rows.append((*counts, ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans), [x for s in spans for x in s], entities, at, text if spans else None))
        yield pd.DataFrame(rows, columns=["email", "ip", "card", "phone", "base", "spans", "entities", "passages", "kept"])


def bit_filter(places: DataFrame) -> np.ndarray:
    """A filter of fixed size with the bit at each ``place`` set; FILTER_BITS at most come to the driver, whatever the input."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 32).cast("int"))
    words = places.select(F.floor(F.col("place") / 32).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return filled


def passes(filled: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (filled[place // 32] >> (place % 32).astype(np.uint32)) & np.uint32(1) != 0


def pair_place(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    return (mix(mix(entity.view(np.uint64)) ^ term.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def meetings_of(batch: pa.RecordBatch, repeated: np.ndarray) -> Iterator[tuple[int, Passages, np.ndarray, np.ndarray]]:
    """(row of the batch, its passages, entity and place of the term, for each distinct pair of entity and passage) of a batch (spans, entities, passages, kept)."""
    for i, (flat, entities, at, text) in enumerate(zip(*(batch.column(c) for c in ("spans", "entities", "passages", "kept")))):
        entity, at = np.array(entities.as_py(), np.int64), np.array(at.as_py(), np.int64)
        known = passes(repeated, entity % FILTER_BITS)
        if known.any():
            flat = flat.as_py()
            laid = Passages(text.as_py(), list(zip(flat[0::3], flat[1::3], flat[2::3])))
            met = [(e, laid.terms(p)) for e, p in sorted(set(zip(entity[known].tolist(), at[known].tolist())))]
            yield i, laid, np.repeat([e for e, _ in met], [len(t) for _, t in met]).astype(np.int64), np.concatenate([t for _, t in met])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from sliced(batch, batch.schema.get_field_index("kept"))


def _words(batch: pa.RecordBatch) -> list[np.ndarray]:
    words, counts = hash_words(*utf8_column(batch.column("kept")), ALNUM)
    return np.split(words.view(np.int64), np.cumsum(counts)[:-1])


def meetings(rows: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(entity, term, n_both): in how many passages both stand, for entities that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            words, found = _words(batch), [np.zeros((0, 2), np.int64)]
            for i, _, entity, place in meetings_of(batch, repeated):
                found.append(np.unique(np.stack((entity, words[i][place], place // PASSAGE), axis=1), axis=0)[:, :2])
            pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], ["entity", "term", "n"])

    held = rows.where("kept is not null").select("spans", "entities", "passages", "kept")
    return held.mapInArrow(run, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both"))


def passage_counts(documents: DataFrame) -> DataFrame:
    """(term, n_term): in how many passages each term stands, over whole texts; the null term counts all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 0)):
            term, counts = hash_words(*utf8_column(batch.column(0)), ALNUM)
            each = -(-counts // PASSAGE)
            passage = np.repeat(np.cumsum(each) - each, counts) + (np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)) // PASSAGE
            order = np.argsort(term, kind="stable")  # passages ascend within each term
            passage, term = passage[order], term[order]
            new = np.concatenate(([True], (term[1:] != term[:-1]) | (passage[1:] != passage[:-1]))) if len(term) else np.zeros(0, bool)
            values, n = np.unique(term[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(each.sum())], pa.int64())], ["term", "n"])

    return documents.where("text is not null").select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def term_spans(rows: DataFrame, telling: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(row, start, end) of the terms that disclose an entity of their passage; ``telling`` (entity, term) is a written table."""

    @F.pandas_udf("int")
    def place(entity: pd.Series, term: pd.Series) -> pd.Series:
        return pd.Series(pair_place(entity.to_numpy(), term.to_numpy()))

    wanted = bit_filter(telling.select(place("entity", "term").alias("place")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            words, found = _words(batch), [[np.zeros(0, np.int64)] * 5]
            names = batch.column("row").to_numpy()
            for i, laid, entity, at in meetings_of(batch, repeated):
                ok = passes(wanted, pair_place(entity, words[i][at]))
                entity, at = entity[ok], at[ok]
                found.append([np.full(len(at), names[i]), entity, words[i][at], laid.start[at], laid.end[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["row", "entity", "term", "start", "end"])

    held = rows.where("kept is not null").select("row", "spans", "entities", "passages", "kept")
    return held.mapInArrow(run, "row long, entity long, term long, start long, end long").join(telling, ["entity", "term"]).select("row", "start", "end").distinct()


def detect(documents: DataFrame, disclosure: float = 0.9, support: int = 3, alpha: float = 0.01) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each document; spans of terms follow the base ones."""
    small_batches(documents.sparkSession)
    found = documents.select("doc_id", F.pandas_udf(_found, FOUND)("text").alias("f")).select("doc_id", "f.*")
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    each = rows.select(F.explode(F.array_distinct(F.arrays_zip("entities", "passages"))).alias("x")).select("x.entities")
    entities = written(each.groupBy(F.col("entities").alias("entity")).agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "pii-entities")
    repeated = bit_filter(entities.select(F.pmod("entity", F.lit(FILTER_BITS)).alias("place")))
    both = written(meetings(rows, repeated).where(F.col("n_both") >= support), "pii-meetings")
    counted = written(passage_counts(documents), "pii-terms")  # written before the join, which else would meet the rows before they are summed
    total, tested = float(counted.where("term is null").agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0] or 1), float(max(both.count(), 1))
    known = both.join(entities, "entity").join(counted.where("term is not null"), "term")
    chance = F.col("n_term") * F.col("n_entity") / F.lit(total)
    gain, whole = F.log(F.col("n_both") / chance), F.log(F.lit(total) / F.col("n_entity"))
    sure = F.col("n_both") * (gain - 1) + chance >= float(np.log(tested / alpha))
    telling = written(known.where((whole > 0) & (gain >= disclosure * whole) & sure).select("entity", "term"), "pii-telling")
    extra = term_spans(rows, telling, repeated)
    extra = extra.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), ",").alias("terms"))
    out = rows.select("row", "doc_id", "base", *KINDS).join(extra, "row", "left")
    counts = [F.col(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), "terms").alias("spans"))


def _cleaned(texts: pd.Series, marks: pd.Series) -> pd.Series:
    out = []
    for text, mark in zip(texts, marks):
        last, parts = 0, []
        for a, z, kind in sorted((int(a), int(z), k) for k, a, z in (m.split(":") for m in (mark or "").split(",") if m)):
            if text is not None and z > last:
                parts += [text[last : max(a, last)], "" if kind == "term" else f"[{kind.upper()}]"]
                last = z
        out.append(text if text is None else "".join(parts) + text[last:])
    return pd.Series(out, dtype=object)


def redact(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with their entities generalised to [KIND] and disclosing terms removed; ``spans`` from ``detect``.

    Spans are found by doc_id, so each must stand in one row and none may be null, else this raises; ``sanitised`` takes any rows.
    """
    doubtful = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count()
    if doubtful:
        raise ValueError("a doc_id is null or repeated: its spans are not known from it; use sanitised()")
    rows = documents.select("doc_id", F.struct("*").alias("row")).join(spans.select("doc_id", "spans"), "doc_id", "left")
    return _with_clean(rows, documents.columns)


def _with_clean(rows: DataFrame, columns: list[str]) -> DataFrame:
    both = rows.select("row", F.pandas_udf(_cleaned, "string")("row.text", "spans").alias("clean"))
    return both.select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])


def sanitised(documents: DataFrame, disclosure: float = 0.9, support: int = 3, alpha: float = 0.01) -> DataFrame:
    """``detect`` and ``redact`` in one: every row comes back once, each text cleaned by its own spans, whatever its doc_id.

    Rows are numbered and written first, and spans go by that number, so null and repeated ids and equal rows are safe. Null and empty
    texts stay; other columns stay whatever their names.
    """
    rows = written(documents.select(F.monotonically_increasing_id().alias("doc_id"), F.struct("*").alias("row")), "pii-documents")
    spans = written(detect(rows.select("doc_id", F.col("row.text").alias("text")), disclosure, support, alpha).select("doc_id", "spans"), "pii-spans")
    return _with_clean(rows.join(spans, "doc_id"), documents.columns)
