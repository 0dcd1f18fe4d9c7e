"""Parsers of verdicts and labels in free text, lexical scores of traces, rendering helpers. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class names of the graph; the class names that free text may hold, in the order in which they are looked
# for; surface forms of a pattern with their class, first hit first; dashes that count as a hyphen.
CLASSES = ["fan-out", "fan-in", "cycle", "scatter-gather", "gather-scatter", "stack", "bipartite", "random"]
CANONICAL = ["scatter-gather", "gather-scatter", "fan-out", "fan-in", "bipartite", "cycle", "random", "stack", "legitimate"]
PATTERN_WORDS = [
    ("scatter-gather", "scatter-gather"), ("scattergather", "scatter-gather"), ("gather-scatter", "gather-scatter"), ("gatherscatter", "gather-scatter"),
    ("fan-out", "fan-out"), ("fanout", "fan-out"), ("fan out", "fan-out"), ("fan-in", "fan-in"), ("fanin", "fan-in"), ("fan in", "fan-in"),
    ("bipartite", "bipartite"), ("mule", "bipartite"), ("cycle", "cycle"), ("circular", "cycle"), ("round-trip", "cycle"),
    ("structuring", "random"), ("smurfing", "random"), ("random", "random"), ("layering", "stack"), ("stack", "stack"),
]
DASHES = "‐‑‒–—―−⁃­"
#: What ends a label, and keys of a line that names a typology.
LABEL_ENDS = ["(", "[", "{", " and ", " or ", "/"]
TYPOLOGY_KEYS = [r"observed\s+pattern", r"final\s+pattern", "typology"]
#: Structural features of a trace, typology names (a space counts as a hyphen), and markers by kind.
PARSE = [r"acct[_\-]\w+", r"\bhub\b|\bcentral\b", r"\b(out[_\- ]?degree|in[_\- ]?degree|degree)\b", r"\b\d+\s+(transactions|edges|accounts|nodes)\b", r"\b(volume|total|sum)\b.*\d"]
NAMES = ["fan-out", "fan in", "fan-in", "fanout", "fanin", "scatter-gather", "scattergather", "gather-scatter", "gatherscatter", "cycle", "cyclic", "stack", "stacking", "layering", "bipartite", "random", "structuring", "smurfing"]
MARKERS = [
    r"\b(temporal|timestamp|time[ \-]?bucket|monthly|biweekly|weekly|daily|recurring|periodic|interval)\b",
    r"\b(identical amount|same amount|repeated.*amount|threshold|reporting threshold|just below)\b",
    r"\b(cycle|return.*origin|loop[s]?|back[ \-]?and[ \-]?forth)\b",
    r"\blayer(ing)?\b|\bmulti[\- ]?(hop|tier|step)\b",
    r"\b(rapid|quick|fast|burst)\b.*\b(transfer|movement)\b",
    r"\b(multiple|many|several).*counterpart",
]
#: How the patterns above are looked for: texts that lack a word of one of the groups are not searched, and of two words of a line with
#: anything in between the first is taken once a line, so that a line costs its length and not its square.
WITHIN = {
    PARSE[0]: [([["acct"]], PARSE[0])],
    PARSE[1]: [([["hub", "central"]], PARSE[1])],
    PARSE[2]: [([["degree"]], PARSE[2])],
    PARSE[3]: [([["transactions", "edges", "accounts", "nodes"]], PARSE[3])],
    PARSE[4]: [([["volume", "total", "sum"]], r"(?m)^(?>.*?\b(?:volume|total|sum)\b).*\d")],
    MARKERS[0]: [([["temporal", "timestamp", "bucket", "monthly", "weekly", "daily", "recurring", "periodic", "interval"]], MARKERS[0])],
    MARKERS[1]: [
        ([["amount", "threshold", "just below"]], r"\b(identical amount|same amount|threshold|reporting threshold|just below)\b"),
        ([["repeated"], ["amount"]], r"(?m)^(?>.*?\brepeated).*amount\b"),
    ],
    MARKERS[2]: [
        ([["cycle", "loop", "forth"]], r"\b(cycle|loop[s]?|back[ \-]?and[ \-]?forth)\b"),
        ([["return"], ["origin"]], r"(?m)^(?>.*?\breturn).*origin\b"),
    ],
    MARKERS[3]: [([["layer", "multi"]], MARKERS[3])],
    MARKERS[4]: [([["transfer", "movement"], ["rapid", "quick", "fast", "burst"]], r"(?m)^(?>.*?\b(?:rapid|quick|fast|burst)\b).*\b(?:transfer|movement)\b")],
    MARKERS[5]: [([["counterpart"], ["multiple", "many", "several"]], r"(?m)^(?>.*?\b(?:multiple|many|several)).*counterpart")],
}
#: Label fields at the start of a line, and identifiers that were never filled in.
LABEL_FIELD = r"""(?im)^\s*(?:[-*]\s*)?["']?(?:label|labels|illicit|is_illicit|is[_ ]?laundering|typology|typology_id|ground[_ ]?truth)["']?\s*[:=]"""
PLACEHOLDER = r"(?i)<\s*ID\s*>|\{\{[^{}]*\}\}"


def any_of(text: Column, words: list[tuple[str, str]]) -> Column:
    """The value of the first word that the text contains."""
    out = None
    for word, value in words:
        hit = text.contains(word)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hyphened(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _class_of(s: Column) -> Column:
    has = s.contains
    crossed = F.when(F.instr(s, "scatter") < F.instr(s, "gather"), "scatter-gather").otherwise("gather-scatter")
    parts = F.when(has("scatter") & has("gather"), crossed).when(has("fan") & has("out"), "fan-out").when(has("fan") & has("in"), "fan-in")
    for part, name in (("cycl", "cycle"), ("random", "random"), ("bipart", "bipartite"), ("stack", "stack"), ("legit", "legitimate"), ("normal", "legitimate")):
        parts = parts.when(has(part), name)
    return F.when(s.isin(CANONICAL), s).otherwise(F.coalesce(parts, F.lit("")))


def normalised_typology(text: Column) -> Column:
    """The class that a label stands for, "" if none: dashes folded, trimmed, lower-cased, closing punctuation and what follows a bracket, a slash, "and" or "or" cut; then by its parts."""
    s = F.regexp_replace(F.lower(stripped(hyphened(text))), r"[.,;:*]+$", "")
    for end in LABEL_ENDS:
        s = stripped(F.substring_index(s, end, 1))
    return let(s, _class_of)


def typology_in(text: Column) -> Column:
    """What a line names as observed pattern, final pattern or typology; else the first class name anywhere, "" without any."""
    named = lambda t, key: F.nullif(normalised_typology(F.regexp_extract(t, rf"(?i){key}\s*:?\s*\**\s*([a-z][a-z\- ]{{2,30}})", 1)), F.lit(""))
    return let(hyphened(text), lambda t: F.coalesce(*[named(t, key) for key in TYPOLOGY_KEYS], let(F.lower(t), lambda low: any_of(low, [(c, c) for c in CANONICAL])), F.lit("")))


def patched_typology(patched: Column, illicit: Column, raw: Column, typology: Column) -> Column:
    """A prediction's typology: the patched field, else what the raw answer of an illicit verdict says, else the structured field; "" where none gives a class."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(normalised_typology(patched)), F.when(illicit, filled(typology_in(raw))), filled(normalised_typology(typology)), F.lit(""))


def verdict(text: Column) -> dict[str, Column]:
    """illicit, explanation, typology and confidence from an answer's conclusion, explanation and observed pattern; without a conclusion it is benign."""
    text = hyphened(F.coalesce(text, F.lit("")))
    line = F.lower(F.regexp_extract(text, r"(?i)conclusion[:\s]*([^\n]+)", 1))
    illicit = line.contains("suspicious") & ~line.contains("not suspicious")
    explanation = stripped(F.regexp_extract(text, r"(?i)explanation[:\s]*([^\n]+(?:\n(?!observed)[^\n]+)*)", 1))
    typology = any_of(F.lower(F.regexp_extract(text, r"(?i)observed\s*pattern[:\s]*([^\n]+)", 1)), PATTERN_WORDS)
    confidence = F.when(illicit & typology.isNotNull(), 0.8).when(illicit, 0.6).otherwise(0.7)
    return {"illicit": illicit, "explanation": explanation, "pred_typology": typology, "confidence": confidence}


def ranking_score(illicit: Column, confidence: Column) -> Column:
    return F.when(illicit, confidence).otherwise(1 - confidence)


def own_line_verdict(text: Column) -> Column:
    """1 for suspicious, 0 for not: from "VERDICT: ...", else from the first line that says only that, else from the text; 0 without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.regexp_extract(low, r"verdict\s*:\s*(suspicious|not\s+suspicious)", 1)
    line = F.regexp_extract(low, r"(?m)^[^\S\n]*(suspicious|not suspicious|not_suspicious)[^\S\n]*$", 1)
    code = lambda c: F.when(c == "", None).when(c.startswith("not"), 0).otherwise(1)
    return F.coalesce(code(named), code(line), (low.contains("suspicious") & ~low.contains("not suspicious")).cast("int"))


def judge_scores(text: Column) -> Column:
    """The four flags from an answer that is JSON, or holds a JSON object, or both behind a code fence."""
    schema = "parse int, recall int, match int, conclude int"
    inner = F.regexp_extract(text, r'(?s)(\{[^{}]*"parse"[^{}]*\})', 1)
    return F.coalesce(*[F.when(F.from_json(x, schema)["parse"].isNotNull(), F.from_json(x, schema)) for x in (text, inner)])


def counted(hits: list[Column]) -> Column:
    return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))


def found(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text holds a pattern of PARSE or MARKERS."""
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    each = [reduce(lambda a, b: a & b, [*[either([low.contains(w) for w in words]) for words in groups], low.rlike(f"(?Ud){regex}")]) for groups, regex in WITHIN[pattern]]
    return either(each)


def features_in(low: Column) -> Column:
    """How many kinds of structural features a lower-cased trace names."""
    return counted([found(low, p) for p in PARSE])


def names_in(low: Column) -> Column:
    """How many different typology names a lower-cased trace holds."""
    same: dict[str, list[str]] = {}
    for name in NAMES:
        same.setdefault(name.replace(" ", "-"), []).append(name)
    either = lambda names: low.contains(names[0]) if len(names) == 1 else low.contains(names[0]) | either(names[1:])
    return counted([either(names) for names in same.values()])


def markers_in(low: Column) -> Column:
    """How many kinds of structural markers a lower-cased trace holds."""
    return counted([found(low, p) for p in MARKERS])


def trace_scores(low: Column, illicit: Column, typology: Column, label: Column, truth: Column) -> dict[str, Column]:
    """parse, recall, match and conclude of a lower-cased trace and its verdict; a benign verdict needs no marker, as it claims no pattern."""
    low = F.coalesce(low, F.lit(""))
    parse = ((F.length(low) >= 50) & (features_in(low) >= 2)).cast("int")
    match = ((low != "") & (~illicit | (markers_in(low) >= 2))).cast("int")
    named = F.coalesce(F.lower(typology) == F.lower(truth), F.lit(False))
    return {"parse": parse, "recall": (names_in(low) >= 2).cast("int"), "match": match, "conclude": F.when(label == 0, ~illicit).otherwise(illicit & named).cast("int")}


def first_fail(steps: list[str]) -> Column:
    out = F.when(F.col(steps[0]) == 0, steps[0])
    for s in steps[1:]:
        out = out.when(F.col(s) == 0, s)
    return out.otherwise("all_pass")


def outcome(label: Column, pred: Column, truth: Column, named: Column) -> Column:
    """correct_benign, false_positive, false_negative, correct, or typology_error where the reference is missing or another one."""
    return F.when((label == 0) & (pred == 0), "correct_benign").when(label == 0, "false_positive").when(pred == 0, "false_negative").when(truth.isNotNull() & (truth == named), "correct").otherwise("typology_error")


#: Fixed value: the former name of an outcome, taken on input.
FORMER_OUTCOMES = {"correct_benign": "correct_legit"}


def present_outcome(name: Column) -> Column:
    out = name
    for old, new in FORMER_OUTCOMES.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def reference_group(label: Column, truth: Column) -> Column:
    """benign, illicit_typed, or illicit_reference_absent where an illicit row has no typology."""
    return F.when(label != 1, "benign").when(F.coalesce(truth, F.lit("")) != "", "illicit_typed").otherwise("illicit_reference_absent")


def eligibility_flags(label: Column, truth: Column, illicit: Column, named: Column) -> dict[str, Column]:
    """Which rows can be judged: binary_correct, reference_evaluable, typed_eligible, typed_correct and evaluable_correct."""
    group = reference_group(label, truth)
    typed = group == "illicit_typed"
    right = typed & illicit & F.coalesce(named == truth, F.lit(False))
    return {"binary_correct": illicit == (label == 1), "reference_evaluable": group != "illicit_reference_absent", "typed_eligible": typed, "typed_correct": right, "evaluable_correct": ((label != 1) & ~illicit) | right}


def failure(label: Column, pred: Column, named: Column, truth: Column) -> Column:
    """correct, over, under, format where a flagged illicit row names no typology, typology where it names another one."""
    missing = F.trim(F.coalesce(named, F.lit(""))).isin("", "unknown")
    return F.when((label == 1) & (pred == 0), "under").when((label == 0) & (pred == 1), "over").when(label == 0, "correct").when(missing, "format").when(F.coalesce(named == truth, F.lit(False)), "correct").otherwise("typology")


def probe_class(pattern: Column, unparsed: str = "benign") -> Column:
    """An observed pattern within the nine classes: legitimate is benign, and so is nothing unless told otherwise."""
    return F.when(F.coalesce(pattern, F.lit("")) == "", unparsed).when(pattern == "legitimate", "benign").otherwise(pattern)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def leaks_label(text: Column) -> Column:
    """Whether a text for evaluation holds a label field at the start of a line, or an identifier that was never filled in."""
    return text.rlike(LABEL_FIELD) | text.rlike(PLACEHOLDER)


def is_account(c: Column) -> Column:
    return c.rlike(r"^[^_\s]+_\S+$")


def is_edge_id(c: Column) -> Column:
    return c.rlike(r"^e_(0|[1-9]\d*)$")


def finite_decimal(c: Column) -> Column:
    """The text as an exact number; null for NaN, infinities and anything else."""
    return c.try_cast("decimal(38,18)")


def truncated(text: Column, overflow: Column) -> Column:
    """Cuts about what overflows: keeps 85% of the rest at the head and the others, 500 at least, at the tail; 2000 and 1000 where nothing would be left."""
    n = F.length(text)
    cut = F.floor((overflow + 4096) * 4 * 1.3).cast("int")
    keep = n - cut
    head = F.floor(keep * 0.85).cast("int")
    tail = F.greatest(keep - head, F.lit(500))
    both = lambda h, t: F.concat(F.substring(text, F.lit(1), h), F.lit("\n...\n"), F.substring(text, n - t + 1, t))
    return F.when(cut >= n, both(F.lit(2000), F.least(F.lit(1000), n))).otherwise(both(head, F.least(tail, n)))


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """What stands before and behind the first </think>, without opening tags and outer white space; no reasoning where there is none."""
    at, bare = F.instr(text, "</think>"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    before = F.replace(F.substring(text, F.lit(1), at - 1), F.lit("<think>"), F.lit(""))
    return F.when(at > 0, bare(before)), F.when(at > 0, bare(F.substring(text, at + len("</think>"), F.length(text)))).otherwise(text)
