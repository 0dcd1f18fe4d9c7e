"""The queries of the operators of this subpackage, over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import collocations, decontaminate, extraction, jaccard, language, mixing, pii, quality, resampling, search, sharding, token_counts, warc
from strataweave.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("moment", 9).alias("moment"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return search.search(search.build_index(documents), documents.where("doc_id % 100 = 0"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 24, grown=[1.0] * 25)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.train(documents))


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_jaccard_join, op4_decontaminate, op5_token_counts, op6_warc, op7_pii, op8_search, op9_sharding, op10_language, op11_extraction, op12_resampling, op13_collocations)}
ORDER = "cap / weight, source IS NULL, source"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL where it can express a query; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_mixing": rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, (i % 3 + 1)::DOUBLE AS weight, CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS lean, 3::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS level, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY {ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
t AS (SELECT *, CASE WHEN share < level THEN weight * max(CASE WHEN share < level THEN share END) OVER () ELSE cap END AS target FROM l),
q AS (SELECT *, least(floor(target + 0.5::DOUBLE), cap)::BIGINT AS quota FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota, q.weight, q.lean, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, (size * (quota // greatest(source_size, 1)) + greatest(least(quota - (quota // greatest(source_size, 1)) * source_size - off, size), 0))::BIGINT AS taken, weight * (1 - lean) AS w0, 2 * weight * lean AS rise, off / greatest(quota, 1) * weight AS due FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(least(2 * due / (w0 + sqrt(w0 * w0 + 2 * rise * due)), 1), 9) END AS moment FROM k""",
    "op4_decontaminate": f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {TOKENS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, j, j + least(13, len(w)) - 1), ' ') AS run FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS j FROM b WHERE len(w) > 0)),
n AS (SELECT doc_id, size, j, array_to_string(list_slice(w, j, j + size - 1), ' ') AS run FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d CROSS JOIN (SELECT DISTINCT size FROM g))),
m AS (SELECT doc_id, item, j, n.size FROM n JOIN g ON n.run = g.run AND n.size = g.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(html) >= 1000 AND last <> page_id THEN last END AS refers_to FROM p""",
    "op12_resampling": f"""WITH k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))),
w AS (SELECT 0 AS part, row_number() OVER () AS r, doc_id, {TOKENS} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {TOKENS} FROM benchmark),
g AS (SELECT part, r, array_to_string(list_slice(w, i, i + n - 1), ' ') AS f, count(*) AS c FROM (SELECT part, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)) GROUP BY ALL),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(f) + 1), lambda j: ('0x' || substr(hex(f), 2 * j - 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, k[xor(a & 255, x) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM g) CROSS JOIN k),
s AS (SELECT b, coalesce(sum(c) FILTER (part = 0), 0) AS s, coalesce(sum(c) FILTER (part = 1), 0) AS t FROM g JOIN b USING (f) GROUP BY b),
z AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (S0 + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T0 + 10000)::DOUBLE)))::BIGINT AS gain FROM s CROSS JOIN (SELECT sum(s) AS S0, sum(t) AS T0 FROM s)),
d AS (SELECT r, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS weight FROM g JOIN b USING (f) JOIN z USING (b) WHERE part = 0 GROUP BY r),
o AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (r) WHERE part = 0),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
q AS (SELECT doc_id, n_features, weight, score, n_words::BIGINT AS n_words, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS due FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= due THEN place END AS rank, n_words FROM q""",
    "op13_collocations": r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, list_slice(w, i, i + k - 1) AS ws, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT c.lang, c.k, c.phrase, c.f AS a, h, l.f AS l, r.f AS r, (1000000 * c.f::HUGEINT * c.f::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c JOIN f l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, h) JOIN f r ON r.lang = c.lang AND r.ws = list_slice(c.ws, h + 1, c.k)),
m AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(list_slice(ws, i, i + 1), ' ') AS phrase FROM c CROSS JOIN (SELECT unnest([1, 2]) AS i) WHERE k = 3) GROUP BY ALL),
s AS (SELECT u.lang, u.phrase, a, l, r, score FROM u LEFT JOIN m ON m.lang = u.lang AND m.phrase = u.phrase AND u.k = 2 WHERE coalesce(100 * longer < 50 * a, true) QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, h) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang) QUALIFY rank <= 2000""",
}
