"""A time-varying mixture of sources.

Each source has a schedule: its weight at some moments of the training from 0 to 1, linear between them. The
integral of the schedule up to a moment, over its whole, is the share of the source's tokens due by then; the whole
integrals set the shares of the sources. A source's target stops at ``max_epochs`` times its size, and what is over
goes to the others by weight. Within a source, documents come in a fixed pseudo-random order, epoch after epoch; the
inverse of the cumulative demand turns a document's offset in that stream into its moment of training, and the
documents are range-sorted by moment.

Only sizes and hashes move: one shuffle by (source, bucket) for the running sums, which no hot source can overload,
and one for the order. The table of sources is aggregated first and has a row for each source; sources are taken to
be few (some ten thousand at most), as their weights are ranked in one task.

Defined results: a null text has size 0; the null source is a source, last in order; documents without words are
never taken; a repeated row is a document of its own; equal rows may swap places, which changes no result; ties of the
pseudo-random order go by key and size. A very long text counts whole; the one document at the end of a source's
target is taken in part, however long. An empty table gives an empty result. Columns that come with the input stay,
apart from those of the result's names, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.llm.common import bucket_of, running, written

WORD = r"[^\x20\x09-\x0D]+"
MADE = ["size", "source_size", "target", "quota", "taken", "offset", "moment", "knots", "_source", "_order", "_bucket"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, key: Column, text: Column) -> Column:
    """The place of a document in its source's order. The text is part of it, so that rows that share a key, or have none, spread over the buckets too."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def source_key(source: str = "source") -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def cycling_weights(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilt: float = 0.5) -> DataFrame:
    """Schedules for the sources in code-point order, null last: the weights in turn, every other source rising over time and the rest falling."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    mean = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    lean = F.when(rank % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    return sources.select("source").distinct().withColumn("_w", mean).withColumn("_t", lean).select(
        "source", F.explode(F.array(F.struct(F.lit(0.0).alias("moment"), (F.col("_w") * (1 - F.col("_t"))).alias("weight")), F.struct(F.lit(1.0).alias("moment"), (F.col("_w") * (1 + F.col("_t"))).alias("weight"))))
    ).select("source", "col.*")


def integrated(schedule: DataFrame) -> DataFrame:
    """For each source the knots of its schedule in order, each with the integral up to it, and the whole integral as weight."""
    w = Window.partitionBy("source").orderBy("moment")
    step = F.coalesce((F.col("moment") - F.lag("moment").over(w)) * (F.col("weight") + F.lag("weight").over(w)) / 2, F.lit(0.0))
    knots = schedule.withColumn("_step", step).withColumn("due", F.sum("_step").over(w))
    return knots.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("moment", "weight", "due"))).alias("knots"), F.max("due").alias("weight"))


def moment(share: Column, knots: Column) -> Column:
    """The moment at which the integral of the schedule reaches ``share`` of its whole: a quadratic on the piece that holds it."""
    due = share * F.element_at(knots, -1)["due"]
    pieces = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("z")))
    piece = F.coalesce(F.try_element_at(F.filter(pieces, lambda p: p["z"]["due"] >= due), F.lit(1)), F.element_at(pieces, -1))

    def inside(p: Column) -> Column:
        a, z = p["a"], p["z"]
        length, rise = z["moment"] - a["moment"], z["weight"] - a["weight"]
        root = F.sqrt(F.greatest(a["weight"] * a["weight"] + F.try_divide(2 * rise * (due - a["due"]), length), F.lit(0.0)))
        return a["moment"] + F.least(F.coalesce(F.try_divide(2 * (due - a["due"]), a["weight"] + root), F.lit(0.0)), length)

    return F.element_at(F.transform(F.array(piece), inside), 1)


def targets(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size, weight): all sizes shared by weight, none over ``max_epochs`` times its source's size.

    The sources that stop at their cap are those of the least cap for their weight; behind the last of them, what
    is left over is shared by weight.
    """
    w = Window.orderBy("_level", F.col("source").isNull(), "source")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("_cap", max_epochs * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    capped = ranked.withColumn("_share", level).withColumn("_open", F.col("_share") < F.col("_level"))
    first = F.max(F.when(F.col("_open"), F.col("_share"))).over(Window.partitionBy())  # the shares fall from the first open source on
    target = F.when(F.col("_open"), F.col("weight") * first).otherwise(F.col("_cap"))
    return capped.withColumn("target", target).drop("_cap", "_level", "_share", "_open")


def mix(documents: DataFrame, schedule=cycling_weights, max_epochs: float = 3.0, key: str = "doc_id", seed: str = "mix", keep: bool | tuple[str, ...] = True, order: Column | None = None) -> DataFrame:
    """One row for each document, sorted by the moment of its first use: size, source_size, target, taken, moment (null if unused).

    ``schedule``: a DataFrame (source, moment, weight), or a function that makes it from the sources' table.
    ``keep``: carry the other columns, all or those named, which then move with the rows.
    ``order``: hex digits that give each source's documents their order; a draw by key and text if left out.
    """
    kept = documents.columns if keep is True else (key, "source", *(keep or ()))
    rest = [F.col(c) for c in documents.columns if c not in MADE and c in kept]
    sized = documents.select(*rest, words(F.col("text")).alias("size"), source_key().alias("_source"), (draw(seed, F.col(key), F.col("text")) if order is None else order).alias("_order"))
    sized = sized.withColumn("_bucket", F.substring("_order", 1, 3))
    if keep is not True:
        sized = written(sized, "mixing")
    sources = sized.groupBy("source", "_source").agg(F.sum("size").alias("source_size"))
    plan = integrated(schedule(sources) if callable(schedule) else schedule)
    sources = targets(sources.join(plan, sources["source"].eqNullSafe(plan["source"])).drop(plan["source"]), max_epochs)
    sources = sources.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.floor(F.lit(max_epochs) * F.col("source_size"))))
    at = running(sized, ["_source"], "_bucket", ["_order", key, "size"], F.col("size"), "offset", sources.drop("source"))
    size, quota, whole, offset = F.col("size"), F.col("quota"), F.col("source_size"), F.col("offset")
    epochs = F.when(whole > 0, F.floor(quota / whole)).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.least(quota - epochs * whole - offset, size), F.lit(0))
    first = moment(offset / F.greatest(quota, F.lit(1)), F.col("knots"))
    at = at.withColumn("taken", (size * epochs + part).cast("long")).withColumn("moment", F.when(F.col("taken") > 0, first)).drop("knots", "weight", "_bucket", "_source")
    unused = 1 + F.conv(F.substring("_order", 1, 13), 16, 10).cast("double") / float(16**13)
    return at.withColumn("_at", F.coalesce("moment", unused)).repartitionByRange("_at", "_order").sortWithinPartitions("_at", "_order").drop("_at", "_order")


def training_order(mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, range-sorted by moment of training, with their epoch and the words taken.

    ``mixed`` must come from ``mix``, joined with ``knots`` of ``integrated`` by source.
    """
    uses = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))) - 1, F.lit(0)).cast("int"))
    each = mixed.where("taken > 0").withColumn("epoch", F.explode(uses))
    each = each.withColumn("used", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    share = (F.col("offset") + F.col("epoch") * F.col("source_size")) / F.greatest(F.col("quota"), F.lit(1))
    return each.withColumn("moment", moment(share, F.col("knots"))).drop("knots").repartitionByRange("moment").sortWithinPartitions("moment")
