"""Queries: lexical scores of traces, labels and verdicts in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import parsing as P
from strataweave.functions.identifiers import canonical_case, retag, retag_count
from strataweave.plans.tx import read, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- lexical scores: verdicts and references by number of the document

TRACE = "d AS (SELECT doc_id, text, lower(coalesce(text, '')) AS low, doc_id % 2 AS illicit, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 5 < 2 THEN 'Cycle' WHEN doc_id % 5 < 4 THEN 'stack' END AS typ FROM documents)"


def hits(patterns, low: str = "low") -> str:
    return " + ".join(f"CASE WHEN regexp_matches({low}, {quoted(p)}) THEN 1 ELSE 0 END" for p in patterns)


def names_sql(low: str = "low") -> str:
    same: dict[str, list[str]] = {}
    for name in P.NAMES:
        same.setdefault(name.replace(" ", "-"), []).append(name)
    return " + ".join("CASE WHEN " + " OR ".join(f"contains({low}, {quoted(n)})" for n in names) + " THEN 1 ELSE 0 END" for names in same.values())


def _traces(spark, sf):
    i = F.col("doc_id")
    d = read(spark, sf, "documents").select(i, "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return d.withColumns({"illicit": i % 2 == 1, "label": F.when(i % 3 == 0, 0).otherwise(1), "typ": F.when(i % 5 < 2, "Cycle").when(i % 5 < 4, "stack")})


@query(f"WITH {TRACE}, s AS (SELECT doc_id, CAST(length(low) >= 50 AND ({hits(P.PARSE)}) >= 2 AS INT) AS parse, CAST(({names_sql()}) >= 2 AS INT) AS recall, CAST(low <> '' AND (illicit = 0 OR ({hits(P.MARKERS)}) >= 2) AS INT) AS match, CAST(CASE WHEN label = 0 THEN illicit = 0 ELSE illicit = 1 AND coalesce(typ = 'Cycle', false) END AS INT) AS conclude FROM d) SELECT *, CASE WHEN parse = 0 THEN 'parse' WHEN recall = 0 THEN 'recall' WHEN match = 0 THEN 'match' WHEN conclude = 0 THEN 'conclude' ELSE 'all_pass' END AS first_fail FROM s")
def lexical_scores(spark, sf):
    """The four lexical steps of a trace and the first that fails."""
    d = _traces(spark, sf)
    scores = P.trace_scores(F.col("low"), F.col("illicit"), F.col("typ"), F.col("label"), F.lit("cycle"))
    s = d.select("doc_id", *[c.alias(n) for n, c in scores.items()])
    return s.withColumn("first_fail", P.first_fail(["parse", "recall", "match", "conclude"]))


@query(f"WITH {TRACE} SELECT doc_id, CAST({hits(P.PARSE)} AS INT) AS features, CAST({names_sql()} AS INT) AS names, CAST({hits(P.MARKERS)} AS INT) AS markers FROM d")
def lexical_counts(spark, sf):
    """What the scores count: structural features, typology names and markers."""
    low = F.col("low")
    return _traces(spark, sf).select("doc_id", P.features_in(low).alias("features"), P.names_in(low).alias("names"), P.markers_in(low).alias("markers"))


@query(f"WITH {TRACE}, w AS (SELECT d.doc_id, size, lower(left(text, size)) AS low FROM d CROSS JOIN (VALUES (500), (1000), (8000)) z(size)) SELECT size, count(*) FILTER (({names_sql()}) >= 1) AS recalled, count(*) AS n FROM w GROUP BY size")
def prefix_truncation(spark, sf):
    """How a score changes with the window of the trace that it sees: the sensitivity analysis, by design over several windows."""
    d = _traces(spark, sf).withColumn("size", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(8000))))
    low = d.select("size", F.lower(F.substring("text", F.lit(1), F.col("size"))).alias("low"))
    return low.groupBy("size").agg(F.count_if(P.names_in(F.col("low")) >= 1).alias("recalled"), F.count("*").alias("n"))


@query(f"WITH {TRACE}, f AS (SELECT doc_id, ({hits(P.PARSE)}) >= 1 AS a, ({names_sql()}) >= 1 AS b FROM d) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM f")
def rule_conjunctions(spark, sf):
    d = _traces(spark, sf).select((P.features_in(F.col("low")) >= 1).alias("a"), (P.names_in(F.col("low")) >= 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


# ---------------------------------------------------------------- labels and verdicts: spellings with the beginnings of real texts around them

SPELLINGS = ["Fan–Out (many).", "cycle, or stack", "Scatter gather", "  BIPARTITE;", "none", "fanin/fanout", "Gather‑Scatter and cycle", "Smurfing", "circular flow", "normal activity", "Fanout", "LEGITIMATE.", "random*", "stacked layers", "mule accounts", "Layering [3]"]
SAID = f"sp AS (SELECT doc_id, coalesce(text, '') AS text, [{', '.join(quoted(x) for x in SPELLINGS)}][doc_id % {len(SPELLINGS)} + 1] || CASE WHEN doc_id % 3 = 0 THEN ' ' || left(coalesce(text, ''), 20) ELSE '' END AS said FROM documents)"
FOLDED = f"translate({{}}, {quoted(P.DASHES)}, {quoted('-' * len(P.DASHES))})"
STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def label_sql(text: str) -> str:
    """The text of a label, cut and stripped; ``class_sql`` names it."""
    s = rf"regexp_replace(lower({STRIPPED.format(FOLDED.format(text))}), '[.,;:*]+$', '')"
    for end in P.LABEL_ENDS:
        s = STRIPPED.format(f"split_part({s}, {quoted(end)}, 1)")
    return s


def class_of(s: str) -> str:
    parts = " ".join(f"WHEN contains({s}, '{part}') THEN '{name}'" for part, name in (("cycl", "cycle"), ("random", "random"), ("bipart", "bipartite"), ("stack", "stack"), ("legit", "legitimate"), ("normal", "legitimate")))
    return f"CASE WHEN {s} IN ({', '.join(quoted(c) for c in P.CANONICAL)}) THEN {s} WHEN contains({s}, 'scatter') AND contains({s}, 'gather') THEN CASE WHEN strpos({s}, 'scatter') < strpos({s}, 'gather') THEN 'scatter-gather' ELSE 'gather-scatter' END WHEN contains({s}, 'fan') AND contains({s}, 'out') THEN 'fan-out' WHEN contains({s}, 'fan') AND contains({s}, 'in') THEN 'fan-in' {parts} ELSE '' END"


def _said(spark, sf):
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    spelt = F.element_at(F.array(*[F.lit(x) for x in SPELLINGS]), (i % len(SPELLINGS) + 1).cast("int"))
    return read(spark, sf, "documents").select(i, text.alias("text"), F.concat(spelt, F.when(i % 3 == 0, F.concat(F.lit(" "), F.substring(text, 1, 20))).otherwise("")).alias("said"))


@query(f"WITH {SAID} SELECT doc_id, {class_of('s')} AS typology FROM (SELECT doc_id, {label_sql('said')} AS s FROM sp)")
def typology_normalise(spark, sf):
    return _said(spark, sf).select("doc_id", P.normalised_typology(F.col("said")).alias("typology"))


RAW = "raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Observed  pattern: **' || said WHEN 1 THEN left(text, 30) || ' Final Pattern ' || said WHEN 2 THEN 'typology:' || said ELSE left(text, 80) || said END AS raw FROM sp)"


def _raw(spark, sf):
    kind, said = F.col("doc_id") % 4, F.col("said")
    raw = F.when(kind == 0, F.concat(F.lit("Observed  pattern: **"), said)).when(kind == 1, F.concat(F.substring("text", 1, 30), F.lit(" Final Pattern "), said)).when(kind == 2, F.concat(F.lit("typology:"), said)).otherwise(F.concat(F.substring("text", 1, 80), said))
    return _said(spark, sf).select("doc_id", raw.alias("raw"))


NAMED = ", ".join(rf"regexp_extract({FOLDED.format('raw')}, '(?i){key}\s*:?\s*\**\s*([a-z][a-z\- ]{{2,30}})', 1) AS k{i}" for i, key in enumerate(P.TYPOLOGY_KEYS))
ANYWHERE = "CASE " + " ".join(f"WHEN contains(lower({FOLDED.format('raw')}), '{c}') THEN '{c}'" for c in P.CANONICAL) + " ELSE '' END"
FROM_RAW = f"WITH {SAID}, {RAW}, na AS (SELECT doc_id, raw, {NAMED} FROM raw), la AS (SELECT doc_id, raw, {', '.join(f'{label_sql(f'k{i}')} AS s{i}' for i in range(len(P.TYPOLOGY_KEYS)))} FROM na), ra AS (SELECT doc_id, coalesce({', '.join(f'nullif({class_of(f's{i}')}, {quoted('')})' for i in range(len(P.TYPOLOGY_KEYS)))}, {ANYWHERE}) AS typology FROM la)"


@query(f"{FROM_RAW} SELECT doc_id, typology FROM ra")
def typology_from_raw(spark, sf):
    """The class that an answer names, by the keys of its lines or anywhere."""
    return _raw(spark, sf).select("doc_id", P.typology_in(F.col("raw")).alias("typology"))


@query(f"{FROM_RAW}, pf AS (SELECT doc_id, {label_sql('CASE WHEN doc_id % 7 = 0 THEN said END')} AS a, {label_sql('CASE WHEN doc_id % 7 < 5 THEN said END')} AS c FROM sp) SELECT doc_id, coalesce(nullif({class_of('a')}, ''), CASE WHEN doc_id % 2 = 1 THEN nullif(typology, '') END, nullif({class_of('c')}, ''), '') AS typology FROM pf JOIN ra USING (doc_id)")
def typology_patched(spark, sf):
    """A patched field first, then the raw answer of an illicit verdict, then the structured field."""
    i = F.col("doc_id")
    d = _raw(spark, sf).join(_said(spark, sf).select("doc_id", "said"), "doc_id")
    return d.select("doc_id", P.patched_typology(F.when(i % 7 == 0, F.col("said")), i % 2 == 1, F.col("raw"), F.when(i % 7 < 5, F.col("said"))).alias("typology"))


ENDINGS = ["Suspicious", "Not suspicious", "**Suspicious** (high)", "unclear", "NOT SUSPICIOUS."]
ANSWER = f"an AS (SELECT doc_id, 'Explanation: ' || left(text, 60) || chr(10) || 'and more' || chr(10) || 'Observed Pattern: ' || said || CASE WHEN doc_id % 11 = 0 THEN '' ELSE chr(10) || 'Conclusion: ' || [{', '.join(quoted(x) for x in ENDINGS)}][doc_id % {len(ENDINGS)} + 1] END AS answer FROM sp)"


@query(rf"""WITH {SAID}, {ANSWER}, f AS (SELECT doc_id, {FOLDED.format('answer')} AS t FROM an), x AS (SELECT doc_id, lower(regexp_extract(t, '(?i)conclusion[:\s]*([^\n]+)', 1)) AS line, regexp_extract(t, '(?is)explanation[:\s]*([^\n].*)$', 1) AS rest, lower(regexp_extract(t, '(?i)observed\s*pattern[:\s]*([^\n]+)', 1)) AS pattern FROM f),
y AS (SELECT doc_id, contains(line, 'suspicious') AND NOT contains(line, 'not suspicious') AS illicit, {STRIPPED.format(r"regexp_replace(rest, '(?is)\n(\n|observed).*$', '')")} AS explanation, CASE {' '.join(f"WHEN contains(pattern, '{k}') THEN '{v}'" for k, v in P.PATTERN_WORDS)} END AS pred_typology FROM x),
z AS (SELECT *, CASE WHEN illicit AND pred_typology IS NOT NULL THEN 0.8 WHEN illicit THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM y) SELECT *, CASE WHEN illicit THEN confidence ELSE round(1 - confidence, 6) END AS score FROM z""")
def verdict_parse(spark, sf):
    i = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (i % len(ENDINGS) + 1).cast("int"))
    answer = F.concat(F.lit("Explanation: "), F.substring("text", 1, 60), F.lit("\nand more\nObserved Pattern: "), F.col("said"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("\nConclusion: "), ending)))
    out = _said(spark, sf).withColumn("answer", answer).select("doc_id", *[c.alias(n) for n, c in P.verdict(F.col("answer")).items()])
    return rounded(out.withColumn("score", P.ranking_score(F.col("illicit"), F.col("confidence"))))


SHORT = ["VERDICT: Suspicious", "REASON: x\nverdict :  Not   suspicious", "so\n Suspicious \nend", "not_suspicious", "it is suspicious, or so", "", "this is not suspicious"]
SHORT_SQL = "[" + ", ".join(quoted(x).replace("\n", "' || chr(10) || '") for x in SHORT) + f"][doc_id % {len(SHORT)} + 1]"


@query(rf"""WITH t AS (SELECT doc_id, lower(CASE WHEN doc_id % 2 = 0 THEN left(coalesce(text, ''), 40) || chr(10) ELSE '' END || {SHORT_SQL}) AS low FROM documents), x AS (SELECT doc_id, low, regexp_extract(low, 'verdict\s*:\s*(suspicious|not\s+suspicious)', 1) AS named, regexp_extract(low, '(?m)^[^\S\n]*(suspicious|not suspicious|not_suspicious)[^\S\n]*$', 1) AS line FROM t)
SELECT doc_id, CASE WHEN named <> '' THEN 1 - starts_with(named, 'not')::INT WHEN line <> '' THEN 1 - starts_with(line, 'not')::INT ELSE (contains(low, 'suspicious') AND NOT contains(low, 'not suspicious'))::INT END AS verdict FROM x""")
def verdict_line(spark, sf):
    """Short answers: a verdict field, a line of its own, or any mention."""
    i = F.col("doc_id")
    short = F.element_at(F.array(*[F.lit(x) for x in SHORT]), (i % len(SHORT) + 1).cast("int"))
    said = F.concat(F.when(i % 2 == 0, F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit("\n"))).otherwise(""), short)
    return read(spark, sf, "documents").select("doc_id", P.own_line_verdict(said).alias("verdict"))


RETAG = "r AS (SELECT doc_id, 'case  v2_' || lpad((doc_id % 99999)::VARCHAR, 5, '0') || '  near acct_v2_99999 and v2_1  v2_' || (doc_id + 70000) || ' ' || left(coalesce(text, ''), 30) AS said FROM documents)"


@query(rf"WITH {RETAG} SELECT doc_id, regexp_replace(said, '(^|[^A-Za-z0-9_])v2_(\d{{5,}})([^A-Za-z0-9_]|$)', '\1amlc_\2\3', 'g') AS text, len(regexp_extract_all(said, '(^|[^A-Za-z0-9_])v2_(\d{{5,}})([^A-Za-z0-9_]|$)'))::BIGINT AS n, 'amlc_' || regexp_extract(said, 'v2_(\d+)', 1) AS canonical, len(regexp_replace(said, '(^|[^A-Za-z0-9_])v2_(\d{{5,}})([^A-Za-z0-9_]|$)', '\1amlc_\2\3', 'g')) - 2 * len(regexp_extract_all(said, '(^|[^A-Za-z0-9_])v2_(\d{{5,}})([^A-Za-z0-9_]|$)')) = len(said) AS sized FROM r")
def retag_tokens(spark, sf):
    """Whole case names get the present prefix; the length grows by two for each, and nothing else changes."""
    i = F.col("doc_id")
    number = F.lpad((i % 99999).cast("string"), 5, "0")
    said = F.concat(F.lit("case  v2_"), number, F.lit("  near acct_v2_99999 and v2_1  v2_"), (i + 70000).cast("string"), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 30))
    r = read(spark, sf, "documents").select(i, said.alias("said"), number.alias("number"))
    text, n = retag(F.col("said")), retag_count(F.col("said")).cast("bigint")
    return r.select("doc_id", text.alias("text"), n.alias("n"), canonical_case(F.concat(F.lit("v2_"), F.col("number"))).alias("canonical"), (F.length(text) - 2 * n == F.length("said")).alias("sized"))


@query(rf"SELECT count(*) FILTER (regexp_matches(text, {quoted(P.LABEL_FIELD)}) OR regexp_matches(text, {quoted(P.PLACEHOLDER)})) AS leaking, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN text || chr(10) || ' - Label: 1' WHEN doc_id % 9 = 1 THEN 'no label: ' || text WHEN doc_id % 9 = 2 THEN text || ' < id >' ELSE text END AS text FROM documents)")
def label_leak_guard(spark, sf):
    """Label fields at the start of a line and identifiers never filled in; a label in mid-line is no leak."""
    i, text = F.col("doc_id") % 9, F.col("text")
    said = F.when(i == 0, F.concat(text, F.lit("\n - Label: 1"))).when(i == 1, F.concat(F.lit("no label: "), text)).when(i == 2, F.concat(text, F.lit(" < id >"))).otherwise(text)
    return read(spark, sf, "documents").agg(F.count_if(P.leaks_label(said)).alias("leaking"), F.count("*").alias("n"))


@query("WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || role || ': ' || text || '</think> ' || text || '</think> c' WHEN 1 THEN ' <think>' || text || '</think>' ELSE text END AS said FROM conversations), p AS (SELECT *, strpos(said, '</think>') AS k FROM s) SELECT conv_id, turn, CASE WHEN k > 0 THEN md5(regexp_replace(replace(left(said, k - 1), '<think>', ''), '^\\s+|\\s+$', '', 'g')) END AS reasoning, md5(CASE WHEN k > 0 THEN regexp_replace(substr(said, k + 8), '^\\s+|\\s+$', '', 'g') ELSE said END) AS answer FROM p")
def reasoning_split(spark, sf):
    """Reasoning and answer of each turn, parted at the first closing tag."""
    c = read(spark, sf, "conversations")
    think = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = F.col("text")
    said = F.when(F.col("turn") % 3 == 0, think("<think>", F.col("role"), ": ", text, "</think> ", text, "</think> c")).when(F.col("turn") % 3 == 1, think(" <think>", text, "</think>")).otherwise(text)
    reasoning, answer = P.split_reasoning(said)
    return c.select("conv_id", "turn", F.md5(reasoning).alias("reasoning"), F.md5(answer).alias("answer"))
