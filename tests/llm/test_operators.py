"""The text operators against brute force on small tables with nulls, ties, empty and repeated rows."""

import bisect
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataweave.llm import decontaminate, jaccard, language, mixing, pii, quality, search, sharding, token_counts, warc
from strataweave.llm.common import ALNUM, SPACED, hash_words, shingle_sets, utf8_column

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, repeated rows."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    base = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", None), (3, base, "a"), (3, base, "a"), (4, base.upper(), "b"), (5, base + " z", "b"), (6, long, None), (7, long + " end", "c"), (None, base, "a"), (8, "one two", "a"), (9, "One  TWO", "a"), (10, "two one", "é"), (11, " \t\n", "a")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_hash_words_matches_regex():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbZé1 \t-_%€\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    import pyarrow as pa

    for kind, pattern in ((ALNUM, WORD), (SPACED, re.compile("[^\x20\x09-\x0d]+"))):
        words, counts = hash_words(*utf8_column(pa.array([*texts, None])), kind)
        want = [pattern.findall(lower(t)) for t in texts] + [[]]
        assert counts.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(flat, words.tolist())) and len(set(seen.values())) == len(seen)


def test_hash_words_in_pieces(monkeypatch):
    import pyarrow as pa

    from strataweave.llm import common

    texts = [" ".join(f"word{i}" for i in range(50)), "x" * 200, "", "a b " * 30]
    whole = hash_words(*utf8_column(pa.array(texts)), SPACED)
    monkeypatch.setattr(common, "PIECE", 16)
    parts = hash_words(*utf8_column(pa.array(texts)), SPACED)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# ---------------------------------------------------------------- 1


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    rows = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect()]
    assert sum((s >= 0.3) == (q == 1) for q, s in rows) / len(rows) > 0.85
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    same = quality.train(docs, labels)
    assert (same.good, same.bad, same.slope, same.offset) == (model.good, model.bad, model.slope, model.offset)


def test_quality_scores_by_hand(spark, docs, odd):
    """Scores are those of plain compression of pieces, for odd rows too and under clashing names; labels are learnt, on held-out rows as well."""
    import zstandard

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]

    def brute(text):
        data = (text or "").encode()
        cut = [data[i : i + 256] for i in range(0, max(len(data), 1), 256)]
        good, bad = (sum(len(p.compress(c)) for c in cut) for p in packers)
        return 1 / (1 + math.exp(-(model.slope * (bad - good) / (bad + good) + model.offset)))

    for df in (docs, odd.withColumn("score", F.lit("x")).withColumn("quality", F.lit(9))):
        want = Counter((r["doc_id"], round(brute(r["text"]), 9)) for r in df.collect())
        assert Counter((r["doc_id"], round(r["score"], 9)) for r in quality.score(df, model).collect()) == want
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) >= 10 and sum(a == b for a, b in held) / len(held) > 0.8


def test_one_huge_text_leaves_the_sample_whole():
    import numpy as np

    from strataweave.llm.common import fitting

    assert fitting(np.array([1000, 5, 5, 5]), 100).tolist() == [False, True, True, True]
    assert fitting(np.array([6] * 20), 100).sum() == 16
    assert fitting(np.array([900, 700]), 100).tolist() == [False, True] and fitting(np.array([], dtype=int), 5).tolist() == []


# ---------------------------------------------------------------- 2


def brute_targets(sizes, weights):
    total, open_, out, left = sum(sizes.values()), set(sizes), {}, float(sum(sizes.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left = total - sum(out.values())
        open_ -= over
    return out


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix(df, keep=False).collect()
        texts = df.select("doc_id", "source", "text").collect()
        sizes = defaultdict(int)
        for r in texts:
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = brute_targets(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
        assert len(got) == len(texts)
        taken = defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and (r["moment"] is None) == (r["taken"] == 0)
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        again = mixing.mix(df.repartition(5), keep=False).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(none, keep=False).count() == 0


def test_curriculum_follows_the_schedule(spark):
    df = documents(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(400)])
    schedule = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 0.5, 1.0), ("b", 1.0, 1.0)], "source string, moment double, weight double")
    plan = mixing.integrated(schedule)
    order = mixing.training_order(mixing.mix(df, schedule, keep=True).join(plan.select("source", "knots"), "source")).toPandas()
    a, b = (order[order["source"] == s] for s in "ab")
    assert abs(a["used"].sum() / b["used"].sum() - 1 / 0.75) < 0.02
    assert abs((a["moment"] < 0.5).mean() - 0.75) < 0.02 and abs((b["moment"] < 0.5).mean() - 1 / 3) < 0.02


# ---------------------------------------------------------------- 3


def brute_components(rows, size=5):
    sets = []
    for i, t in rows:
        w = lower(t).encode().split()
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                inverted[x].append(k)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for other, n in Counter(j for x in s for j in inverted[x] if j < k).items():
                if 100 * n >= 80 * (len(s) + len(sets[other][1]) - n):
                    a, b = find(i), find(sets[other][0])
                    parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(spark):
    rng, rows = random.Random(11), []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 60)}" for _ in range(rng.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(w + [f"t{rng.randint(0, 9)}"] * rng.randint(0, 1)), "a"))
    return documents(spark, rows)


@pytest.mark.parametrize("which", ["docs", "odd", "near"])
def test_jaccard(spark, docs, odd, which, monkeypatch):
    df = {"docs": docs, "odd": odd}.get(which) if which != "near" else near_copies(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # so that small tables have hot signatures
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_jaccard_of_ids_with_several_texts(spark, monkeypatch):
    """Texts that share an id are searched each for itself: as many pairs as for ids of their own, and the links hold for the id."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base + [f"x{i}", f"y{k}"]), "a") for i in range(150) for k in range(2)]  # all near, two texts each
    rows += [(1000 + i, t, "a") for i in range(40) for t in (" ".join(f"{i}p{j}" for j in range(9)), " ".join(f"{i + 1}p{j}" for j in range(9)))]  # a chain through ids
    rows += [(2000, None, "a"), (2000, "", "a"), (2000, " ".join(base), "a"), (None, " ".join(base), "a"), (-7, "one two", "a"), (-7, "one  two", "a"), (-8, "one two", "a"), (-8, "three", "a")]
    rng.shuffle(rows)
    df, sizes, real = documents(spark, rows), {}, jaccard.written

    def written(table, what):
        out = real(table, what)
        sizes[what] = max(sizes.get(what, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == brute_components([(i, t) for i, t, _ in rows])
    assert sizes["jaccard-mixed"] == 191 and sizes["jaccard-pairs"] < 1000 and sizes["jaccard-found"] < 5 * len(rows)


def test_groups_of_a_hot_signature(spark):
    rows = [(7, i, i % 5) for i in range(5000)] + [(7, 3, 1), (8, 1, -1), (8, 1, -1), (9, 2, -1), (9, 4, -1), (10, 5, 0), (11, 6, 0), (11, 7, 3)]
    df = spark.createDataFrame(rows, "sig long, id long, part int").repartition(8)
    got = jaccard._groups(df)
    assert set(map(tuple, got.collect())) == {(7, i, 0) for i in range(5000)} | {(9, 2, 2), (9, 4, 2), (11, 6, 6), (11, 7, 6)}
    assert jaccard._hot(df).tolist() == [7]


def test_jaccard_empty(none):
    assert jaccard.join(none).count() == 0


def test_signatures_lose_no_pair():
    """Each pair at the threshold shares a signature, over many sizes and border cases of the bands."""
    import numpy as np

    rng = np.random.default_rng(3)
    starts = jaccard.band_starts(4000)
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 17, 25, 38, 60, 99, 150, 301, 900]:
        for _ in range(6):
            both = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            for a_only in range(0, n // 4 + 1, max(1, n // 12)):
                b_only = (100 * n // 80 - n) - a_only
                if b_only < 0:
                    continue
                a, b = np.unique(both[: n + a_only]), np.unique(np.concatenate((both[:n], both[n + a_only : n + a_only + b_only])))
                if 100 * n >= 80 * (n + a_only + b_only):
                    x, y = (set(np.concatenate(jaccard.signatures(s, 80, starts)).tolist()) for s in (a, b))
                    assert x & y


# ---------------------------------------------------------------- 4


def brute_hits(rows, items, n=13):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for j in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[j : j + n])].add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if (k := windows.get(tuple(w[j : j + size]))) is not None:
                    hit.update(range(j, j + size))
                    found |= k
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate(spark, docs, odd, none):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    small = spark.createDataFrame([(1, "a3 A4 a5"), (12, " ".join(f"a{i}" for i in range(20))), (2, None), (3, ""), (12, "one-two"), (None, "a7 a8"), (4, "absent words")], "item_id long, text string")
    for df, items in ((docs, benchmark), (odd, small)):
        got = sorted((tuple(r) for r in decontaminate.judge(df, items).collect()), key=str)
        assert got == brute_hits([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert decontaminate.judge(none, benchmark).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.judge(odd, small.limit(0)).collect())


def test_decontaminate_passes_and_proximity(spark):
    df = documents(spark, [(1, "a b x c d", "s"), (2, "b c d", "s"), (3, "d c b", "s")])
    items = spark.createDataFrame([(7, "b c d"), (8, "a b")], "item_id long, text string")
    index = decontaminate.build_index(df)
    rows = lambda **k: {r["doc_id"]: (list(r["marks"]), list(r["items"])) for r in decontaminate.find(index, items, 3, **k).collect()}
    assert rows() == rows(block=1) == {1: ([0, 2], ["8"]), 2: ([0, 3], ["7"]), 3: ([], [])}
    assert rows(slop=1)[1][1] == ["7", "8"] and "7" not in rows(slop=1)[3][1]


# ---------------------------------------------------------------- 5


def test_token_counts(docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for df in (docs, odd):
        texts = df.collect()
        want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(whole.encode(r["text"] or "", add_special_tokens=False))) for r in texts if r["doc_id"] is not None)
        for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (300, 40)):
            got = token_counts.count(df, path, chunk=chunk, overlap=overlap).collect()
            assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == want
            assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count(none, path).count() == 0


def test_resynchronisation_on_hostile_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(2)
    parts = [" ", "  ", "\n", "a", "bc", "<|endoftext|>", "<|endo", "é", "１", "　", "\t", "'s", "!", "12", "漢字", "xyzw" * 5, "a" * 300, " " * 200, "😀", "\x85", "\xa0"]
    short, chunked = (token_counts.counter("x.json", open(path, "rb").read(), c, 16) for c in (1 << 16, 64))
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert short(text) == chunked(text) == len(whole.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_other_tokenizers(odd, name):
    import public_tokenizers

    assert token_counts.count(odd, public_tokenizers.path(name)).where("n_tokens > 0").count() > 3


# ---------------------------------------------------------------- 6


def test_warc(spark, tmp_path):
    big, long = "x" * 1500, "é<p>" * 20_000
    rows = [(i, f"http://a/{i}", big if i % 3 else "small") for i in range(-5, 60)] + [(None, None, None), (7, "u", big), (2**62, "z y", big + "é"), (2**62 + 1, "z", big + "é"), (100, "e", "")]
    rows += [(None, f"n{i}", f"{i} {big}") for i in range(30)] + [(55, f"r{i}", f"{i % 7} {big}") for i in range(40)] + [(8, "twin", big)] * 3 + [(70, "l", long), (71, "l", long), (None, "l", long)]
    rows = [(*r, "payload", 5) for r in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string, shard int")
    made = []
    for name, part in (("a", 1), ("b", 6)):
        (tmp_path / name).mkdir()
        made.append(warc.write(df.repartition(part), f"file://{tmp_path}/{name}", shard_bytes=9000, roll=2000).orderBy("file").collect())
    assert made[0] == made[1] and len({r["shard"] for r in made[0]}) > 10
    for r in made[0]:
        data = (tmp_path / "a" / r["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["bytes"]
        assert len(list(warc.records(io.BytesIO(data)))) == r["records"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert sorted(p.name for p in (tmp_path / "a").glob("pages-*")) == [r["file"] for r in made[0]] and not list((tmp_path / "a").glob("_[0-9]*"))
    # Hot keys: rows without page_id and those of one page_id lie in several shards; otherwise shards ascend by page_id.
    assert len({r["shard"] for r in made[0] if r["first_page"] is None}) > 3 and len({r["shard"] for r in made[0] if r["first_page"] == 55 == r["last_page"]}) > 3
    numbered = sorted((r["shard"], r["first_page"], r["last_page"]) for r in made[0] if r["first_page"] is not None)
    assert all(x[2] <= y[1] for x, y in zip(numbered, numbered[1:]) if x[0] != y[0])
    got = warc.read(spark, f"file://{tmp_path}/a", payloads=True).collect()
    largest = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(i, largest.get(html, i))
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), str(None if i is None or largest.get(h, i) == i else largest[h])) for i, _, h, *_ in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], str(r["refers_to"])) for r in got) == want
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    assert Counter(bytes(r["payload"]) for r in got if r["payload"] is not None) == Counter((h or "").encode() for i, _, h, *_ in rows if i is None or largest.get(h, i) == i)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_detects_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}")
    (file,) = tmp_path.glob("pages-*")
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"text\r\n\r\n", b"tExt\r\n\r\n")))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, f"file://{tmp_path}").count()


# ---------------------------------------------------------------- 7

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) & -1:
            if (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base(docs):
    rng = random.Random(3)
    parts = list("a1.@-+ 9(%é4") + ["4111111111111111", "1.2.3.4", "300.1.1.1", "a@b.c", "+12 (345) 678"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [(pii.KINDS[k], a, z) for k, a, z in pii.base_spans(t)] == brute_spans(t)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.detect(docs).collect():
        want = brute_spans(texts[r["doc_id"]])
        joined = ",".join("%s:%d:%d" % x for x in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


def brute_terms(texts, disclosure=0.9, support=3, alpha=0.01):
    """Spans of disclosing terms for each text, by plain counting of passages."""
    laid, n_term, n_entity, n_both = [], Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        spans = brute_spans(t)
        words = [(m.group(), *m.span()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t)]
        entities = defaultdict(set)
        for kind, a, z in spans:
            entities[bisect.bisect_right([e for _, _, e in words], a) // pii.PASSAGE].add(kind + ":" + lower(t[a:z]))
        parts = []
        inside = [False] * (len(t) + 1)
        for _, a, z in spans:
            inside[a:z] = [True] * (z - a)
        for p in range(-(-len(words) // pii.PASSAGE)):
            own = words[p * pii.PASSAGE : (p + 1) * pii.PASSAGE]
            free = [(lower(w), s, e) for w, s, e in own if not any(inside[s:e])]
            n_term.update({lower(w) for w, _, _ in own})
            n_entity.update(entities[p])
            n_both.update({(e, w) for e in entities[p] for w, _, _ in free})
            parts.append((entities[p], free))
        laid.append(parts)
    total = sum(len(x) for x in laid)
    pairs = {k: n for k, n in n_both.items() if n >= support and n_entity[k[0]] >= support}
    telling = set()
    for (e, w), n in pairs.items():
        chance = n_term[w] * n_entity[e] / total
        whole, gain = math.log(total / n_entity[e]), math.log(n / chance)
        if whole > 0 and gain >= disclosure * whole and n * (gain - 1) + chance >= math.log(max(len(pairs), 1) / alpha):
            telling.add((e, w))
    return [sorted({(s, z) for es, free in parts for w, s, z in free for e in es if (e, w) in telling}) for parts in laid]


def test_pii_discloses(spark, docs, odd, none):
    rows = [(i, f"Call Rumpelstiltskin today é anna@example.com now {i}", "s") for i in range(6)] + [(10 + i, f"call today or now, number {i}", "s") for i in range(40)] + [(98, None, "s"), (99, "", "s")]
    df = documents(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(df, disclosure=0.9).collect()}
    assert got[0] == "email:29:45,term:5:20,term:27:28" and got[98] == got[99] == "" and not any(got[i] for i in range(10, 50))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.detect(df)).collect()}
    assert clean[0] == "Call  today  [EMAIL] now 0" and clean[10] == rows[6][1] and clean[98] is None
    assert pii.detect(none).count() == 0
    # Against plain counting: the given texts, odd rows, and a very long text with many addresses and clashing columns.
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "anna@example.com", "10.0.0.1", f"secret{i % 9}", f"w{i}"]) for i in range(3_000))
    planted = [(i, f"{rng.choice(['alpha', 'beta'])} codename kestrel{i % 3} writes to k{i % 3}@spy.org {i}", "s") for i in range(60)]
    more = documents(spark, [*planted, (71, long, "s"), (72, long, "s"), (None, planted[0][1], "s"), planted[1]])
    for table in (docs, odd.union(more).withColumn("entity", F.lit("x")).withColumn("row", F.lit(1)).withColumn("term", F.lit(2))):
        texts = table.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], ",".join(["%s:%d:%d" % x for x in brute_spans(r["text"] or "")] + ["term:%d:%d" % x for x in t])) for r, t in zip(texts, brute_terms([r["text"] for r in texts])))
        assert Counter((r["doc_id"], r["spans"]) for r in pii.detect(table).collect()) == want
    assert any("term:" in k[1] for k in want)


# ---------------------------------------------------------------- 8


def brute_search(rows, queries, k):
    bags = [(i, Counter(WORD.findall(lower(t)))) for i, t in rows if i is not None and t is not None]
    lengths = [sum(c.values()) for _, c in bags]
    mean, df = max(sum(lengths) / max(len(bags), 1), 1e-9), Counter(w for _, c in bags for w in c)
    out = {}
    for q, t in queries:
        scored = []
        for (i, c), n in zip(bags, lengths):
            s = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in set(WORD.findall(lower(t))) if w in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        out[q] = sorted(scored)[:k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("at_once", [search.TERMS, 50])
def test_search(spark, docs, odd, at_once, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 20_000)
    monkeypatch.setattr(search, "SEED", 3)
    monkeypatch.setattr(search, "BLOCK", 4)
    for df in (docs.where("doc_id < 120"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        queries = df.where("doc_id % 20 = 0 or doc_id in (4, 9)").dropDuplicates(["doc_id"])
        got = defaultdict(list)
        for r in search.search(search.build_index(df), queries, 7, terms_at_once=at_once).orderBy("query", "rank").collect():
            got[r["query"]].append((-round(r["score"], 6), r["doc_id"]))
        want = brute_search(rows, [(r["doc_id"], r["text"]) for r in queries.collect()], 7)
        assert got.keys() == want.keys()
        for q in want:
            assert all(abs(a[0] - b[0]) < 3e-6 for a, b in zip(got[q], want[q])) and len(got[q]) == len(want[q])


def test_search_counts_beyond_16_bits(spark):
    """Term counts are exact, however often a term stands in a document; columns with clashing names don't matter."""
    rows = [(1, "alpha " * 70_000, "s"), (2, "alpha " * 65_535 + "beta " * 4_465, "s"), (3, "alpha gamma", "s"), (4, "delta", "s")]
    df = documents(spark, rows).withColumn("query", F.lit("x")).withColumn("segment", F.lit(1)).withColumn("score", F.lit(2.0))
    got = search.search(search.build_index(df), df.where("doc_id = 3"), 3).orderBy("rank").collect()
    want = brute_search([r[:2] for r in rows], [(3, "alpha gamma")], 3)[3]
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [(i, -s) for s, i in want] and got[1]["doc_id"] == 1 and got[1]["score"] > got[2]["score"]


def test_search_empty(none):
    assert search.search(search.build_index(none), none).count() == 0


# ---------------------------------------------------------------- 9


def test_sharding(spark, docs, odd, none):
    for df in (docs, odd):
        got = sharding.shard(df, [1.0] * 24, grown=[1.0] * 25).collect()
        assert len(got) == df.count() and {r["law"] for r in got} == {"key"}
        slots = defaultdict(list)
        for r in got:
            body = (r["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
            assert r["grown_shard"] in (r["shard"], 24)
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            draws = [math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) for i in range(25)]
            assert r["shard"] == draws.index(max(draws[:24])) and r["grown_shard"] == draws.index(max(draws))
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(none, [1.0]).count() == 0
    share = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = Counter(r["shard"] for r in sharding.shard(share, [1.0, 3.0]).collect())
    assert abs(counts[1] / 4000 - 0.75) < 0.03


# ---------------------------------------------------------------- 10


def test_language(spark, docs, odd, none):
    model = language.train(docs)
    got = language.predict(docs, model, keep=True).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    marks = documents(spark, [(1, None, "s"), (2, "", "s"), (3, "12 !? ·", "s"), (4, "ß", "s"), (5, "the", "s"), (6, "漢", "s")])
    assert [r["lang_pred"] == "und" for r in language.predict(marks, model).orderBy("doc_id").collect()] == [True, True, True, False, False, False]
    assert language.predict(none, model).count() == 0 and language.predict(odd, model).count() == odd.count()
    assert {r["lang_pred"] for r in language.predict(odd, language.train(none)).collect()} == {"und"}


def brute_language(model, text):
    """The best language of one text and its score, gram by gram."""
    data = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    plain = [b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in data] + [32] * 3
    total = [0.0] * len(model.names)
    for n in (3, 4):
        for i in range(len(data)):
            x = 0
            for b in plain[i : i + n]:
                x = (x * 0x01000193 + b) % 2**32
            x = ((x ^ (x >> 15)) * 0x85EBCA6B) % 2**32
            for j, v in enumerate(model.logits[x >> 17].tolist()):
                total[j] += v
    mean = [t / (2 * len(data)) for t in total]
    weights = [math.exp(m - max(mean)) for m in mean]
    best = max(range(len(mean)), key=lambda j: (mean[j], -j))
    return model.names[best], weights[best] / sum(weights)


@pytest.mark.parametrize("step", [language.STEP, 1 << 10])
def test_language_scores_by_hand(spark, docs, odd, step, monkeypatch):
    """Predictions and scores are those of a plain sum over each text, in any order of rows and size of pieces, under clashing names."""
    monkeypatch.setattr(language, "STEP", step)
    model = language.train(docs)
    for df in (docs.limit(60), odd.where("doc_id != 7").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))):
        want = Counter((r["doc_id"], brute[0], round(brute[1], 5)) for r in df.collect() for brute in [brute_language(model, r["text"])])
        for rows in (df, df.orderBy(F.desc("doc_id")).coalesce(1)):
            assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in language.predict(rows, model).collect()) == want


def test_language_scores_do_not_depend_on_neighbours(docs, spark):
    model = language.train(docs)
    texts = ["the", "a", "", None, "ß", "hello", "der Hund", "漢字", "le chat", "x" * 50, *[r["text"] for r in docs.limit(5).collect()]]
    alone = [tuple(language.predict(documents(spark, [(1, t, "s")]), model).select("lang_pred", "score").first()) for t in texts]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        together = language.predict(documents(spark, [(i, texts[i], "s") for i in order]).coalesce(1), model).collect()
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in together} == dict(enumerate(alone))


def test_shingles_of_short_texts():
    import pyarrow as pa

    words, counts = hash_words(*utf8_column(pa.array(["a b", "a b", "b a", "", "a b c d e f"])), SPACED)
    sets = shingle_sets(words, counts, 5)
    assert sets[0].tolist() == sets[1].tolist() != sets[2].tolist() and [len(s) for s in sets] == [1, 1, 1, 0, 2]
