"""Readers with fixed schemas, and checks of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataweave.functions.identifiers import canonical_case, node_id, retag
from strataweave.functions.parsing import probe_class
from strataweave.operators.checks import binary_violations
from strataweave.operators.ordered import running

TRANSACTION_COLUMNS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
TRANSACTIONS = T.StructType([T.StructField(c, T.DoubleType() if c.startswith("amount") else T.IntegerType() if c == "is_laundering" else T.StringType()) for c in TRANSACTION_COLUMNS])
TIME = "yyyy/MM/dd HH:mm"
#: Fixed pattern of a block's first line.
BEGIN = r"^BEGIN LAUNDERING ATTEMPT(?: - ([^:]*))?"


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """The transaction file by position of its columns (its header repeats a name), strings trimmed, with times and node ids.

    Add ``row_id`` at ingest: ``with_row_ids`` of the file's lines, stored as a table once.
    """
    raw = spark.read.csv(path, header=True, schema=TRANSACTIONS, enforceSchema=True, mode="FAILFAST")
    text = [F.trim(c).alias(c) if isinstance(TRANSACTIONS[c].dataType, T.StringType) else F.col(c) for c in TRANSACTION_COLUMNS]
    return raw.select(*text).withColumns({"ts": F.to_timestamp_ntz(F.col("timestamp"), F.lit(TIME)), "source": node_id(F.col("from_bank"), F.col("from_account")), "target": node_id(F.col("to_bank"), F.col("to_account")), "cross_currency": F.col("receiving_currency") != F.col("payment_currency")})


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Numbers rows 0, 1, 2 ... in file order: the rows of each partition are counted first, a number for each, so nothing is gathered. Store the result before use."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())  # the partition above bit 33, the row in it below
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")  # a row for each partition
    return joined.select((F.col("_before") + inside).alias(name), *df.columns)


def pattern_labels(lines: DataFrame) -> DataFrame:
    """(key, typology) from lines (file, line_no, line) of pattern files: records take the type of the block that they stand in; the last one of a key wins.

    Blocks are numbered by a running count of the lines that begin or end one, and a line meets the head of its block by
    that number, so a file may hold any number of lines.
    """
    head = F.when(F.col("line").startswith("BEGIN"), F.coalesce(F.nullif(F.lower(F.trim(F.regexp_extract("line", BEGIN, 1))), F.lit("")), F.lit("unknown"))).when(F.col("line").startswith("END"), F.lit(""))
    placed = running(lines.withColumn("_head", head), "line_no", {"_block": F.when(F.col("_head").isNotNull(), 1).otherwise(0)}, ["file"])
    heads = placed.where("_head is not null and _head != ''").select("file", "_block", F.col("_head").alias("typology"))
    records = placed.where(F.col("_head").isNull() & (F.size(F.split("line", ",")) >= 5)).join(heads, ["file", "_block"])
    return records.groupBy(F.concat_ws(",", F.slice(F.split("line", ","), 1, 5)).alias("key")).agg(F.max_by("typology", F.struct("file", "line_no")).alias("typology"))


def pattern_file(spark: SparkSession, path: str) -> DataFrame:
    """The labels of pattern files; their lines are numbered across files, so they ascend within each."""
    lines = with_row_ids(spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r$", "").alias("line")), "line_no")
    return pattern_labels(lines.where("line != ''"))


PREDICTION = "case_id string, illicit boolean, typology string, confidence double, total_tokens bigint, raw_response string"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each prediction of each result file."""
    schema = "method string, model string, dataset string, seed int, n_predictions bigint, predictions array<struct<" + ",".join(x.strip().replace(" ", ":") for x in PREDICTION.split(",")) + ">>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    return files.withColumn("p", F.explode("predictions")).select("method", "model", "dataset", "seed", "n_predictions", "p.*")


def permissive(coreset: DataFrame, found: DataFrame) -> DataFrame:
    """A verdict for each case of the coreset: benign and untyped where there is none."""
    return coreset.join(found, "case_id", "left").withColumns({"illicit": F.coalesce("illicit", F.lit(False)), "typology": F.coalesce("typology", F.lit("unknown"))})


def coverage_report(coreset: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """What a strict read rejects, for each group of ``found``: missing, unknown and duplicate case ids, and null verdicts. All zero: accepted."""
    total = coreset.select("case_id").distinct().agg(F.count("*").alias("_total"))
    known = found.join(coreset.select("case_id").distinct().withColumn("_known", F.lit(True)), "case_id", "left")
    got = known.groupBy(*by).agg(F.count_if(F.col("_known").isNull()).alias("unknown"), (F.count("*") - F.countDistinct("case_id")).alias("duplicate"), F.count_if(F.col("illicit").isNull()).alias("no_verdict"), F.countDistinct(F.when(F.col("_known"), F.col("case_id"))).alias("_covered"))
    return got.crossJoin(F.broadcast(total)).withColumn("missing", F.col("_total") - F.col("_covered")).drop("_total", "_covered")  # one row


def parse_bool(c) -> F.Column:
    """true/1 and false/0 in any case; anything else is null, for the caller to reject."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "1", "1.0"), True).when(v.isin("false", "0", "0.0"), False)


def annotations(spark: SparkSession, path: str, key: list[str], flags: list[str]) -> DataFrame:
    """Annotation sheets where an empty cell is an empty string, flags parsed strictly, keys unique: rows that break a rule carry it in ``violation``."""
    raw = spark.read.csv(path, header=True, nullValue="\u0000", emptyValue="")
    w = Window.partitionBy(*key)
    parsed = raw.withColumns({f: parse_bool(F.col(f)) for f in flags}).withColumn("_n", F.count("*").over(w))
    bad = F.when(F.col("_n") > 1, "duplicate key")
    for f in flags:
        bad = bad.when(F.col(f).isNull(), f"{f} is not boolean")
    return parsed.withColumn("violation", bad).drop("_n")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """ok, changed, missing or unrecorded for each file of either side."""
    both = found.alias("f").join(recorded.alias("r"), "path", "full_outer")
    state = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("r.sha256").isNull(), "unrecorded").when(F.col("f.sha256") == F.col("r.sha256"), "ok").otherwise("changed")
    return both.select("path", state.alias("state"))


def node_tables(spark: SparkSession, features: str, classes: str, edges: str, n_features: int = 165) -> tuple[DataFrame, DataFrame]:
    """Nodes with features, time step and label (1, 0, -1 for unknown), and edges whose ends both exist."""
    schema = "txId bigint, time_step smallint, " + ", ".join(f"f{i} float" for i in range(n_features))
    f = spark.read.csv(features, schema=schema)
    c = spark.read.csv(classes, header=True, schema="txId bigint, class string")
    nodes = f.join(c, "txId", "left").withColumn("label", F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0).otherwise(-1)).drop("class")
    e = spark.read.csv(edges, header=True, schema="src bigint, dst bigint")
    ids = nodes.select("txId")
    return nodes, e.join(ids, e["src"] == ids["txId"], "left_semi").join(ids, e["dst"] == ids["txId"], "left_semi")


CASE_FIELDS = "case_id string, center_edge_id string, label int, typology string, prompt string"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from lines of JSON, their names and texts under the present prefix; lines that are no JSON carry violation."""
    raw = spark.read.schema(f"{CASE_FIELDS}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = raw.withColumns({"case_id": canonical_case(F.col("case_id")), "prompt": retag(F.col("prompt"))})
    return named.withColumn("violation", F.when(F.col("_corrupt").isNotNull(), "no JSON").when(F.col("case_id").isNull(), "no case")).drop("_corrupt")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Reasoning traces (model, case_id, trace, illicit, typology) of prediction files; a missing trace is empty."""
    schema = "model string, predictions array<struct<case_id:string,illicit:boolean,typology:string,reasoning_content:string>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select("model", F.explode("predictions").alias("p"))
    return p.select("model", canonical_case(F.col("p.case_id")).alias("case_id"), F.coalesce("p.reasoning_content", F.lit("")).alias("trace"), "p.illicit", F.coalesce("p.typology", F.lit("")).alias("typology"))


def judges(spark: SparkSession, path: str, flags: tuple[str, ...] = ("parse", "recall", "match", "conclude"), key: tuple[str, ...] = ("model", "case_id")) -> DataFrame:
    """Sheets of judges or raters with 0/1 flags; rows that break a rule carry it in ``violation``."""
    return binary_violations(spark.read.csv(path, header=True, nullValue="\u0000", emptyValue=""), flags, key)


def probes(spark: SparkSession, path: str) -> DataFrame:
    """(model, run, case_id, cls): probe answers within the nine classes."""
    raw = spark.read.csv(path, header=True, schema="model string, run int, case_id string, observed_pattern string", enforceSchema=False)
    return raw.select("model", "run", "case_id", probe_class(F.col("observed_pattern")).alias("cls"))


def tuned(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of the best parameters in files of a tuning."""
    raw = spark.read.schema("best_params map<string,string>, best_score double").json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("file"), F.explode("best_params").alias("name", "value"))
