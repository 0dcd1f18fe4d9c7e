"""Readers of archived predictions and probe answers that report every departure from their convention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.identifiers import FORMER, PREFIX, canonical_case, case_number, retag, retag_count

META = ("dataset", "model", "method", "seed")
#: Counts of a report that an accepted file has at zero.
RULES = ("bad_metadata", "no_list", "invalid_case", "unknown_case", "repeated_case", "wrong_edge", "wrong_label", "missing_case")


def _part(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, path, kind)


def archive(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, dataset, model, method, seed, doc): a row for each prediction file, its names taken from its path.

    ``pattern`` is a regular expression whose four groups are the names in the order of META.
    """
    docs = spark.read.option("singleVariantColumn", "doc").option("multiLine", True).json(path)
    named = docs.select(F.input_file_name().alias("file"), "doc")
    return named.select("file", *[F.regexp_extract("file", pattern, i + 1).alias(m) for i, m in enumerate(META)], "doc")


def file_rules(files: DataFrame) -> DataFrame:
    """Adds bad_metadata, 1 where a name that the file states (null counts as stated) differs from its path's, and no_list, 1 where predictions are no list."""
    keys = F.map_keys(_part(F.col("doc"), "$", "map<string,variant>"))
    differs = lambda m: F.array_contains(keys, m) & ~F.coalesce(_part(F.col("doc"), f"$.{m}", "string") == F.col(m), F.lit(False))
    bad = F.greatest(*[F.coalesce(differs(m), F.lit(True)).cast("int") for m in META])
    listed = F.coalesce(F.schema_of_variant(_part(F.col("doc"), "$.predictions")).startswith("ARRAY"), F.lit(False))
    return files.withColumns({"bad_metadata": bad, "no_list": (~listed).cast("int")})


def records(files: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """(by, record): the predictions of each file, one row each."""
    return files.select(*by, F.explode(_part(F.col("doc"), "$.predictions", "array<variant>")).alias("record"))


def read_record(rows: DataFrame, record: str = "record") -> DataFrame:
    """Adds case_id, center_edge_id, gt_label and flag to rows with a record, and what its verdict is: missing_illicit, null_illicit or non_binary_illicit.

    A verdict is binary if it is a boolean or the whole number 0 or 1. The flag keeps the archive's convention: any other
    value counts by whether it is empty or zero; no value counts as benign.
    """
    r = F.col(record)
    value = _part(r, "$.illicit")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    has = F.coalesce(F.array_contains(F.map_keys(_part(r, "$", "map<string,variant>")), "illicit"), F.lit(False))
    void, text = kind == "VOID", value.cast("string")
    whole = F.when(kind == "BIGINT", value.cast("bigint"))
    binary = (kind == "BOOLEAN") | F.coalesce(whole.isin(0, 1), F.lit(False))
    empty = (kind == "BOOLEAN") & (text == "false") | (kind == "STRING") & (text == "") | text.isin("[]", "{}") & (kind != "STRING")
    zero = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & F.coalesce(value.cast("double") == 0, F.lit(False))
    id_kind = F.schema_of_variant(_part(r, "$.case_id"))
    return rows.withColumns({
        "case_id": F.when(id_kind == "STRING", _part(r, "$.case_id", "string")), "center_edge_id": _part(r, "$.center_edge_id", "string"), "gt_label": _part(r, "$.gt_label", "double"),
        "flag": (~void & ~F.coalesce(empty | zero, F.lit(False))).cast("int"), "missing_illicit": (~has).cast("int"), "null_illicit": (has & void).cast("int"), "non_binary_illicit": (~void & ~binary).cast("int"),
    })


def record_report(cases: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each group of ``found`` (by and the columns of ``read_record``) against cases (case_id, edge_id, label): counts of all kinds, those of RULES included.

    A repeated case counts each record after its first. Missing cases are never filled in.
    """
    named = F.col("case_id")
    each = found.withColumn("case_id", F.when(case_number(named).isNotNull(), canonical_case(named)))
    known = cases.select("case_id", F.col("edge_id").alias("_edge"), F.col("label").alias("_label"))
    joined = each.join(known, "case_id", "left").withColumn("_known", F.col("_label").isNotNull())
    wrong_edge = F.col("_known") & (F.col("center_edge_id") != F.col("_edge"))
    wrong_label = F.col("_known") & (F.col("gt_label") != F.col("_label"))
    n = lambda c: F.count_if(c)
    one = joined.groupBy(*by, "case_id").agg(
        F.count("*").alias("n"), F.max("_known").alias("_known"), n(wrong_edge).alias("wrong_edge"), n(wrong_label).alias("wrong_label"),
        n(F.col("center_edge_id").isNull()).alias("missing_edge"), n(F.col("gt_label").isNotNull()).alias("checked_label"), *[F.sum(c).alias(c) for c in ("missing_illicit", "null_illicit", "non_binary_illicit", "flag")],
    )
    valid = F.col("case_id").isNotNull()
    total = lambda c, cond=F.lit(True): F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(c)
    got = one.groupBy(*by).agg(
        F.sum("n").alias("records"), total("n", ~valid).alias("invalid_case"), total("n", valid & ~F.col("_known")).alias("unknown_case"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("n") - 1)), F.lit(0)).alias("repeated_case"),
        *[total(c) for c in ("wrong_edge", "wrong_label", "missing_edge", "checked_label", "missing_illicit", "null_illicit", "non_binary_illicit", "flag")], F.count_if(F.col("_known")).alias("_covered"),
    )
    whole = known.agg(F.countDistinct("case_id").alias("_cases"))
    return got.crossJoin(F.broadcast(whole)).withColumn("missing_case", F.col("_cases") - F.col("_covered")).drop("_cases", "_covered")  # one row


def archive_report(cases: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each file: its names, its own rules and those of its records. ``checks.accepted(report, RULES)`` takes the files or raises."""
    marks = file_rules(files)
    got = record_report(cases, read_record(records(marks.where("no_list = 0"))), ["file"])
    size = cases.agg(F.countDistinct("case_id").alias("_cases"))  # one row
    report = marks.drop("doc").join(got, "file", "left").crossJoin(F.broadcast(size))
    counts = [c for c in got.columns if c not in ("file", "missing_case")]
    return report.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "missing_case": F.coalesce("missing_case", "_cases")}).drop("_cases")


def probe_answers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of archived probe answers that may be passed on, from lines of JSON, under the present prefix.

    Thoughts and texts are not read further than whether they are there (withheld). Rows with a name outside the vocabulary, or a line that is no
    JSON, carry violation. Missing answers are empty texts, missing counts 0.
    """
    schema = "model string, variant string, case_id string, class string, label int, parsed struct<observed_pattern:string,conclusion:string>, error string, usage struct<input_tokens:bigint,output_tokens:bigint>, latency_ms double, thinking string, response_text string, _corrupt string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    there = lambda c: F.coalesce((F.length(c) > 0).cast("int"), F.lit(0))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    name = retag(F.col("case_id"), FORMER, PREFIX)
    return raw.select(
        "model", "variant", name.alias("case_id"), or_empty("class").alias("gold_class"), F.coalesce("label", F.lit(0)).alias("gold_label"),
        or_empty("parsed.observed_pattern").alias("pred_pattern"), or_empty("parsed.conclusion").alias("pred_conclusion"), there("error").alias("errored"),
        F.coalesce("usage.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("usage.output_tokens", F.lit(0)).alias("output_tokens"), F.round(F.coalesce("latency_ms", F.lit(0.0)), 1).alias("latency_ms"),
        (there("thinking") + there("response_text")).alias("withheld"), F.coalesce(retag_count(F.col("case_id")), F.lit(0)).alias("retagged"),
        F.when(F.col("_corrupt").isNotNull(), "no JSON").when(F.coalesce(~name.rlike(rf"^{PREFIX}\d+$"), F.lit(True)), "no case").alias("violation"),
    )
