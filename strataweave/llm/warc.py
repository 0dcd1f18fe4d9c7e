"""A deterministic sharded WARC 1.1 writer and its reader.

Records are range-sorted by page_id into shards of about ``shard_bytes`` bytes of payload. The borders come from exact
histograms of page_id, refined where a cell holds more than a shard; a page_id that alone fills more than a shard (as
do rows without one) is cut further by payload digest. So borders depend on the rows alone and not on how Spark dealt
them, and so do the names and bytes of all files. Within a shard, a file is closed once its compressed members reach
``roll`` bytes. Headers and digests are made anew for each record: content length, block and payload digest, record
id, and for a payload that occurs more than once a revisit that refers to its response.

Payloads move once, compressed, to the shard that writes them. Which records are revisits is found on a narrow table of
ids, digests and sizes: its digests are counted before they are shuffled, those that occur more than once are joined
back to their ids (where Spark splits a hot one), and the marks that result meet the records in the same sort.

A task writes each file under a name of its own attempt and renames it when it is complete, to a name that any
attempt would use for the same bytes. The rows that the tasks return form the manifest, which Spark commits as a
table; files that it does not name are not part of the archive. Reading goes by the manifest, file by file as a stream.

Defined results: a null html is an empty payload; a null url becomes "about:blank"; rows without page_id are written as
records of their own without a number, never as the response of others, sorted first; a repeated page_id gives a record
for each row, and where it is the largest of equal payloads, each of its records is a response. Rows equal in page_id,
url and html give as many equal records. A payload of any length is one record, held whole by one task at a time and
never cut; a file holds one record at least. An empty table gives an archive without files. Other columns, whatever
their names, are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import shared_folder, written

#: Payload bytes of a shard, compressed bytes after which a file is closed, least payload that may become a revisit.
SHARD_BYTES, ROLL, LEAST = 16 << 20, 8 << 20, 1000
#: Cells of a histogram for each span that it refines; shards at most, so that larger inputs get larger ones.
CELLS, SHARDS = 4096, 100_000
#: Into how many cells a cell over the limit is cut at least.
FINER = 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, first_page long, last_page long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page_id: int | None, seed: str = "") -> str:
    """A version 8 UUID that holds the page's 64-bit number, or for a page without one a version 5 UUID of its content."""
    if page_id is None:
        return f"<{uuid.uuid5(uuid.NAMESPACE_URL, seed).urn}>"
    n = page_id & (1 << 64) - 1
    return f"<{uuid.UUID(int=(n >> 62) << 64 | 8 << 76 | 2 << 62 | n & (1 << 62) - 1).urn}>"


def page_of(record: str) -> int | None:
    x = uuid.UUID(record.strip("<>")).int
    if x >> 76 & 15 != 8:
        return None
    n = (x >> 64 & 3) << 62 | x & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(page_id: int | None, url: str | None, digest: bytes, size: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One gzip member with the whole record: a response with its payload or, without one, a revisit that refers to another page."""
    url = "".join(c for c in (url or "") if c > " ") or "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if payload is None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, url + digest.hex())}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    if payload is None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {base32(digest)}", f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def records(stream) -> Iterator[tuple]:
    """(page_id, payload_bytes, digest, type, refers_to, url, payload or None) of each record; its digests are checked."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while line := lines.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                head[name.lower()] = value.decode()
            block = lines.read(int(head[b"content-length"]))
            if lines.read(4) != b"\r\n\r\n" or base32(hashlib.sha1(block).digest()) != head[b"warc-block-digest"]:
                raise ValueError(f"record {head[b'warc-record-id']} is damaged")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            kind = head[b"warc-type"]
            if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != head[b"warc-payload-digest"]):
                raise ValueError(f"payload of {head[b'warc-record-id']} is damaged")
            digest = base64.b32decode(head[b"warc-payload-digest"].removeprefix("sha1:")).hex()
            refers = page_of(head[b"warc-refers-to"]) if kind == "revisit" else None
            yield page_of(head[b"warc-record-id"]), size, digest, kind, refers, head[b"warc-target-uri"], payload if kind == "response" else None


class Shards:
    """Where each record goes: ascending first page_ids of spans, for each span its first shard and into how many it is cut by digest."""

    def __init__(self, rows: DataFrame, limit: int):
        """From (page_id, bytes), by one aggregate for each level; cells over ``limit`` bytes are cut into smaller ones at the next, four for each shard that they fill, FINER at least.

        What comes to the driver is a number for each cell of a level: CELLS at the first one, and FINER for each shard at most after it.
        """
        low, high, unnumbered, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))), F.sum("bytes")).first()
        limit = max(limit, -(-(total or 0) // SHARDS))
        spans, cells = [(low, high, CELLS)] if low is not None else [], []
        while spans:
            lows, highs, _ = (np.array(x, np.int64) for x in zip(*spans))
            steps = np.array([(z - a) // k + 1 for a, z, k in spans], np.uint64)

            @F.pandas_udf("long")
            def cell(values: pd.Series) -> pd.Series:
                x = values.to_numpy()
                i = np.maximum(np.searchsorted(lows, x, side="right") - 1, 0)
                behind = (x.view(np.uint64) - lows[i].view(np.uint64)) // steps[i] * steps[i]
                return pd.Series((lows[i].view(np.uint64) + behind).view(np.int64), dtype="Int64").where((x >= lows[i]) & (x <= highs[i]))

            counted = rows.where(F.col("page_id").isNotNull()).select(cell("page_id").alias("at"), "bytes").where("at is not null").groupBy("at").agg(F.sum("bytes")).collect()
            last, spans = spans, []
            for at, n in sorted(counted):
                i = int(np.searchsorted(lows, at, side="right")) - 1
                if n > limit and steps[i] > 1:
                    spans.append((at, min(at + int(steps[i]) - 1, last[i][1]), min(CELLS, max(FINER, -(-4 * n // limit)))))
                else:
                    cells.append((at, n))
        self.unnumbered = max(1, -(-(unnumbered or 0) // limit))
        first, parts, held = [], [], limit + 1
        for at, n in sorted(cells):
            if held + n > limit:
                first.append(at)
                parts.append(max(1, -(-n // limit)))
                held = 0 if n <= limit else limit  # a page_id that fills more than a shard has its shards for itself
            held += n
        self.first, self.parts = np.array(first, np.int64), np.array([self.unnumbered, *parts], np.int64)
        self.base = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def of(self, page_id: int | None, digest: bytes) -> int:
        i = 0 if page_id is None else int(np.searchsorted(self.first, page_id, side="right"))
        return int(self.base[i]) + (int.from_bytes(digest[:4], "big") * int(self.parts[i]) >> 32)


PACKED = "shard int, page_id long, digest binary, refers_to long, url string, size long, copies long, record binary"
PACKED_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _packed(shards: Shards):
    """Each row's record as a response, compressed where the page was read; equal rows that lie in one batch go once with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows: dict[tuple, list] = {}
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                page, url, payload = page.as_py(), url.as_py(), html.as_py() or b""
                digest = hashlib.sha1(payload).digest()
                if known := rows.get((page, url, digest)):
                    known[6] += 1
                else:
                    rows[page, url, digest] = [shards.of(page, digest), page, digest, None, url, len(payload), 1, member(page, url, digest, len(payload), payload)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows.values()), PACKED_KINDS)] if rows else [pa.array([], kind) for kind in PACKED_KINDS], [x.split()[0] for x in PACKED.split(", ")])

    return run


def _marks(shards: Shards):
    """A row without record for each page that is a revisit, which the sort puts before the records that it marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, digests, n = batch.column("page_id").to_pylist(), batch.column("digest").to_pylist(), batch.num_rows
            columns = [[shards.of(p, d) for p, d in zip(pages, digests)], pages, digests, batch.column("refers_to").to_pylist(), [None] * n, [None] * n, [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, PACKED_KINDS)], [x.split()[0] for x in PACKED.split(", ")])

    return run


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().stageId()}-{TaskContext.get().taskAttemptId()}"
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        done, out, shard, part, mark = [], None, None, 0, (None, None, None)

        def close():
            nonlocal out
            if out is not None:
                out["stream"].close()
                name = f"pages-{shard:06d}-{part:05d}.warc.gz"
                files.move(out["path"], f"{path}/{name}")
                done.append((shard, name, out["records"], out["bytes"], out["first"], out["last"], out["sha"].hexdigest()))
                out = None

        for batch in batches:
            for row in zip(*batch.columns):
                s, page, digest, refers_to, url, size, copies, record = (x.as_py() for x in row)
                if record is None:
                    mark = page, digest, refers_to
                    continue
                if mark[:2] == (page, digest):
                    record = member(page, url, digest, size, None, mark[2])
                for _ in range(copies):
                    if s != shard or (out and out["bytes"] >= roll):
                        close()
                        shard, part = s, part + 1 if s == shard else 0
                    if out is None:
                        temporary = f"{path}/_{attempt}-{s:06d}-{part:05d}"
                        out = {"path": temporary, "stream": files.open_output_stream(temporary), "records": 0, "bytes": 0, "first": page, "sha": hashlib.sha256()}
                    out["stream"].write(record)
                    out["sha"].update(record)
                    out["records"] += 1
                    out["bytes"] += len(record)
                    out["last"] = page
        close()
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names)

    return run


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Writes the archive into ``folder`` (a URI that all executors reach) and returns its manifest, read back from there."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    narrow = written(pages.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")), "warc-digests")
    shards = Shards(narrow, shard_bytes)
    seen = narrow.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    many = seen.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least")).where("response != least").drop("least")
    revisits = seen.join(written(many, "warc-repeated"), "digest").where("page_id != response").select("page_id", "digest", F.col("response").alias("refers_to"))
    ready = pages.mapInArrow(_packed(shards), PACKED).union(revisits.mapInArrow(_marks(shards), PACKED))
    placed = ready.repartitionById(shards.count, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("record").isNotNull(), "url")
    placed.mapInArrow(_writer(folder, roll), MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all files that the manifest names, each checked against its digests and the manifest's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, count = [], 0

                def packed(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for r in records(stream):
                        rows.append(r if payloads else (*r[:6], None))
                        count += 1
                        if len(rows) == 500:
                            yield packed(rows)
                            rows = []
                if count != expected:
                    raise ValueError(f"{name} has {count} records; the manifest says {expected}")
                yield packed(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    return manifest.repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(run, RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Writes an archive of the pages into the shared folder and reads it back."""
    import pyarrow.fs

    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/strataweave/warc-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    write(pages, folder)
    return read(spark, folder)
