"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws a uniform number from a hash of its id and text length and
gets the exponential key -ln(u) / quality weight; ascending keys are a weighted
sample without replacement, the same in every run.  Within a source the keys
are sorted and sizes prefix-summed up to the source's token budget.  A budget
beyond the source's size takes complete epochs first; only what is left is a
fractional selection, whose last document is cut at the budget.

Targets: sources ordered by code point, null last, weigh 1, 2, 3, repeating,
and share the sum of all sizes; a target stops at 3 times its source's size
and the excess is shared again by weight (one water level settles all rounds).

The prefix sum is split: keys cut each source into buckets of about
``BUCKET_ROWS`` documents, bucket totals are summed over buckets, and windows
run inside buckets only, so that a source holding a third of all rows is many
small tasks.  DataFrame functions only.

Defined results: null text has size 0 and takes 0 words; null is a source of
its own; a null doc_id draws like any other; equal rows share their draw and
take their turns in an arbitrary, hence indistinguishable, order; an empty
table gives no rows.  Extra columns are ignored (``mixed_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skupulse.llm.common import SPACE, cut

WEIGHTS = (1, 2, 3)
MOST = 3                 # epochs at most
BUCKET_ROWS = 2_000
BROADCAST_SOURCES = 100_000


def text_size(text: str = "text") -> Column:
    """Number of words in the text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def text_quality(text: str = "text", size: str = "size") -> Column:
    """Sampling weight from 0.25 to 1: falls with the symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.coalesce(F.greatest(F.lit(0.25), 1 - 0.5 * symbols / F.greatest(F.col(size), F.lit(1))), F.lit(0.25))


def draw(quality: str = "quality") -> Column:
    """Exponential key of a document over its quality weight."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 11).cast("double")
    return -F.log((bits + 1) / F.lit(float(1 << 53))) / F.col(quality)


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_key, source_size, n_docs, target, epochs (complete
    ones) and rest (words of the fractional selection)."""
    per = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                          F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.select("*", weight.alias("weight")).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(full) - held) / open_
    # the first source, by room per weight, that the level does not fill
    per = per.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    per = per.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("most") / F.col("weight"))).over(full))
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    per = per.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("epochs", F.least(epochs, F.lit(most).cast("long")))
    rest = F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    return per.withColumn("rest", F.when(F.col("epochs") < most, rest).otherwise(F.lit(0)).cast("long"))


def _sized(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                            text_size().alias("size"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("quality", text_quality())
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    return rows.select("doc_id", "source", key.alias("source_key"), "size", "quality", draw().alias("key"))


def quality_levels(sized: DataFrame) -> DataFrame:
    """Per source, its documents' qualities rounded to sixteenths, with counts."""
    counts = sized.groupBy("source_key", (F.round(F.col("quality") * 16) / 16).alias("q")).agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("source_key").alias("level_key")).agg(F.collect_list(F.struct("q", "n")).alias("levels"))   # at most 13


def _prepared(sized: DataFrame, weights, most) -> DataFrame:
    """Targets and quality levels: one row per source."""
    per = targets(sized, weights, most)
    return cut(per.join(quality_levels(sized), F.col("source_key") == F.col("level_key")).drop("level_key"))


def _with_targets(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with their source's figures; the side is small when sources are few."""
    side = per.drop("source")
    return sized.join(F.broadcast(side) if per.count() <= BROADCAST_SOURCES else side, "source_key")


def _summed(rows: DataFrame) -> DataFrame:
    """Adds ``before``: words of the source's documents with smaller keys."""
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    # the share of the source's keys below this one: exponential at each quality
    below = F.aggregate("levels", F.lit(0.0), lambda s, e: s + e["n"] * (1 - F.exp(-e["q"] * F.col("key")))) / F.col("n_docs")
    rows = rows.withColumn("bucket", F.least(buckets - 1, F.floor(buckets * below)).cast("long")).drop("levels")
    totals = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["source_key", "bucket"]).withColumn("before", F.col("base") + F.col("inner"))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every document."""
    sized = cut(_sized(documents))
    rows = _summed(_with_targets(sized, _prepared(sized, weights, most)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source")


def mixed_documents(documents: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole; a document
    at the budget's edge is taken if half of it or more fits.  Keeps columns.

    Only one number per source, the largest key taken, goes back to the
    documents, so their texts are not shuffled."""
    sized = cut(_sized(documents))
    per = _prepared(sized, weights, most)
    inside = F.col("size") + 2 * F.col("before") <= 2 * F.col("rest")
    edge = (_summed(_with_targets(sized, per)).where(inside & (F.col("size") > 0)).groupBy("source_key")
            .agg(F.max("key").alias("__edge")).withColumnRenamed("source_key", "__key"))
    side = (per.select(F.col("source_key").alias("__name"), F.col("epochs").alias("__epochs"))
            .join(edge, F.col("__name") == F.col("__key"), "left").select("__name", "__epochs", "__edge"))
    side = cut(side)
    if per.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    names = documents.columns
    row = F.struct(*(F.col(c) for c in names))
    probe = documents.select(row.alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"),
                             F.col("text").cast("string").alias("text"),
                             F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("__name"))
    probe = probe.withColumn("quality", text_quality()).withColumn("key", draw())
    probe = probe.join(side, "__name")
    copies = F.when(F.col("size") > 0, F.col("__epochs") + F.coalesce(F.col("key") <= F.col("__edge"), F.lit(False)).cast("long"))
    return (probe.select("__row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("__copy"))
            .select(*(F.col("__row").getField(c).alias(c) for c in names)))
