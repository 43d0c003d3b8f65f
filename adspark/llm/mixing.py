"""Mixing sources to target weights, by capped water-filling.

Every source gets a share of all words in proportion to its weight. A source
whose share exceeds ``max_epochs`` times its size is clamped there; what is left
over is shared among the others by weight, again and again until no source is
above its limit. A document of a source with target ``e`` times its size is
repeated ``floor(e)`` times; the fraction is a seeded whole-document sample: in
the order of a hash, documents are taken once more while their middle lies below
the words still wanted, so a source misses its target by half a document at most
(documents are never cut).

Only DataFrame operations; the texts are read once, for their sizes. A source's
running total goes over 65,536 hash buckets and then over the rows of the one
bucket that holds the cut, so a source with a third of all rows is no task of
its own.

Nulls: a null text has size 0, a null source is a source, sorted last. Documents
without an id are ordered by a hash of their texts, so that they spread over the
buckets too and the order is that of the data, not of the files. Repeated
rows count as documents of their own; those with equal key and size are ordered
arbitrarily among themselves, which does not change what is taken. An empty table
gives no rows. A source of size 0 has target 0. Extra columns are left out; join
the result to the documents, or use ``expand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark.llm._common import WORD, stored, unused
from adspark.operators.lookup import lookup_join

BUCKET_DIGITS = 4


def sizes_of(docs: DataFrame, carried: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """doc_id, source, size in words, carried columns, further expressions."""
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    return docs.select("doc_id", "source", n.cast("bigint").alias("size"), *carried, *more)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last: offsets of ranges, then rows of a range."""
    ranged = stored(sources.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("_part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.max("source").alias("_max"))
    # one row per range, of which there are as many as shuffle partitions
    offset = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("_part", F.coalesce(offset, F.lit(0)).alias("_before"))
    within = F.row_number().over(
        Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return (ranged.join(before, "_part")
            .withColumn("rank", F.col("_before") + within - 1).drop("_part", "_before"))


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the cycle's values in turn along the sources' order."""
    values = F.array(*[F.lit(float(w)) for w in cycle])
    at = (F.col("rank") % F.lit(len(cycle))).cast("int")
    return ranked_sources(sources).withColumn("weight", F.get(values, at)).drop("rank")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to stored rows of (source, source_size, weight).

    The level is the words that a unit of weight gets. Each round clamps the
    sources whose limit lies below it and raises it by what they leave; it ends
    when a round clamps no further source. Only scalars come to the driver.
    """
    limit = F.col("source_size") * F.lit(float(max_epochs))
    sums = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("w")).first()
    total, weight = float(sums["total"] or 0), float(sums["w"] or 0)
    level, clamped = (total / weight if weight else 0.0), 0
    while weight:
        over = limit < F.col("weight") * F.lit(level)
        r = sources.agg(F.count_if(over).alias("n"),
                        F.sum(F.when(over, limit)).alias("used"),
                        F.sum(F.when(~over, F.col("weight"))).alias("left")).first()
        if r["n"] == clamped or not r["left"]:
            break
        clamped, level = r["n"], (total - r["used"]) / r["left"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def order_key(seed: int) -> Column:
    """Hexadecimal digits that order a source's documents."""
    no_id = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    name = F.coalesce(F.col("doc_id").cast("string"), no_id)
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...], max_epochs: float = 3.0,
        seed: int = 17, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken, and ``row`` if given.

    ``row`` names a column of distinct numbers, which tell apart rows of the same or no
    doc_id; rows that would be in no order of their own are taken in that of their numbers.

    ``weights``: a table (source, weight), where a source without weight gets 0,
    or weights to be dealt to the sources in turn, in the order of their names.
    """
    carried = (row,) if row else ()
    sizes = stored(sizes_of(docs, carried, order_key(seed).alias("key")), "mix-sizes")
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if isinstance(weights, tuple):
        weighed = cycled_weights(by_source, weights)
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        weighed = by_source.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        weighed = weighed.fillna(0.0, subset=["weight"])
    plan = water_fill(stored(weighed, "mix-weights"), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(epochs).cast("bigint"))
    plan = plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))

    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("words").over(run))
    p = plan.select(F.col("source").alias("_s"), "wanted")
    cut = (run.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
           .filter((F.col("upto") <= F.col("wanted")) & (F.col("wanted") > 0))
           .groupBy("source").agg(F.max("bucket").alias("last"), F.max("upto").alias("below"))
           .withColumnRenamed("source", "_s"))
    plan = (plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
            .withColumn("below", F.coalesce("below", F.lit(0)))
            .withColumn("last", F.coalesce("last", F.lit(""))))
    nxt = (sums.join(plan.select(F.col("source").alias("_s"), "last"),
                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
           .filter(F.col("bucket") > F.col("last"))
           .groupBy("source").agg(F.min("bucket").alias("edge")).withColumnRenamed("source", "_s"))
    plan = plan.join(nxt, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = lookup_join(
        sizes, plan, "source", ["source_size", "target", "whole", "wanted", "last", "below", "edge"],
        spread_by=["doc_id", "key", *carried], weight="n", null_matches=True)
    at_edge = F.coalesce(bucket == F.col("edge"), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *carried).rowsBetween(
        Window.unboundedPreceding, 0)
    upto = F.col("below") + F.sum("size").over(order)
    edge = rows.filter(at_edge).withColumn(
        "more", 2 * upto - F.col("size") < 2 * F.col("wanted"))
    rest = rows.filter(~at_edge).withColumn("more", bucket <= F.col("last"))
    repeats = F.col("whole") + F.coalesce(F.col("more"), F.lit(False)).cast("bigint")
    return edge.unionByName(rest).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"),
        (repeats * F.col("size")).alias("taken"), *carried)


def expand(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents as often as the mix repeats them.

    ``key`` must be unique and not null: for documents with repeated or null ids, the
    ``row`` that the mix was given.
    """
    at, times = unused("id", docs.columns), unused("times", docs.columns)
    n = mixed.select(F.col(key).alias(at), F.col("repeats").alias(times)).filter(F.col(times) > 0)
    return (docs.join(n, F.col(key) == F.col(at)).drop(at)
            .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
            .drop(times))
