"""Ordered operations without a whole-table sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.session import cut_lineage


def first_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key. Spark cuts every partition down to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sums_before(frame: DataFrame, group: list[str], block: str, order: list[Column], value: Column,
                name: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, in (block, order) order within each group.

    A group is cut into blocks; block totals are added up first, on one row per block, so no task
    ever holds more than one block.
    """
    valued = frame.withColumn("_v", value)
    per_block = valued.groupBy(*group, block).agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        valued.join(offsets, [*group, block])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_v", "_offset")
    )


def in_blocks(frame: DataFrame, group: list[str], order: str) -> DataFrame:
    """The frame with ``_block``: numbered ranges of (group, order), as many as there are shuffle partitions.

    The rows are stored as dealt, so losing an executor cannot deal them differently.
    """
    ranged = frame.repartitionByRange(*[F.col(c) for c in [*group, order]])
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))


def beside(blocks: DataFrame, group: list[str], order: str, values: list[Column], name: str, ahead: bool = False) -> DataFrame:
    """Adds ``name``: a struct of ``values`` of the row before in its group, or of the row after with ``ahead``; null at the ends.

    ``blocks`` comes from :func:`in_blocks`. A directory of one row per group and block carries the values
    over the borders of blocks, so no task holds a long group whole.
    """
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    seen = blocks.withColumn("_own", F.struct(*values))
    ends = seen.groupBy(*group, "_block").agg((edge("_own", order)).alias("_end"))
    ends = ends.withColumn("_end", shift("_end").over(Window.partitionBy(*group).orderBy("_block")))
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    near = F.coalesce(shift("_own").over(inside), F.col("_end"))
    return seen.join(ends, [*group, "_block"]).withColumn(name, near).drop("_own", "_end")


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers the rows from 1 in this order, which must be total to be repeatable.

    Rows are dealt to ranges of the order; a directory of one count per range gives each its first number, so no task
    orders more than one range.
    """
    spark = frame.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(frame.repartitionByRange(ranges, *order).withColumn("_block", F.spark_partition_id()))
    counts = dealt.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return dealt.join(F.broadcast(first), "_block").withColumn(name, F.col("_first") + inside).drop("_block", "_first")


#: Bins of a round after the first.
_BINS = 1024


def exact_median(frame: DataFrame, keys: list[str], value: str, name: str, ranked: int = 2048) -> DataFrame:
    """Exact median per key, nulls left out, without holding a key's values in one place.

    Equal values are counted first. Histograms of all keys at once then find the bin with the middle, bins of that bin, and so on
    until it holds at most ``ranked`` values, which are ranked. The first bins are the same for all keys and later ones meet on key and
    bin, so nothing is joined or ranked on a key alone.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    by = [f"_k{i}" for i in range(max(1, len(keys)))]
    counted = frame.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    scale = F.when(F.isnan("_v"), 1e9).otherwise(F.signum("_v") * F.floor(64 * F.log2(1 + F.abs("_v") * 1e6)))
    rows = cut_lineage(counted.withColumn("_bin", F.least(scale, F.lit(1e8)).cast("long")).withColumn("_which", F.lit(0)))
    ranks = None
    while True:
        bins = rows.groupBy(*by, "_which", "_bin").agg(F.sum("_n").alias("_n"), F.count("*").alias("_kinds"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*by, "_which").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("_upto", F.sum("_n").over(w)).withColumn("_from", F.col("_upto") - F.col("_n"))
        if ranks is None:  # of n values those of rank (n - 1) / 2, rounded down and up
            last = F.max("_upto").over(Window.partitionBy(*by, "_which"))
            bins = bins.withColumn("_middle", F.array(F.floor((last - 1) / 2), F.ceil((last - 1) / 2)))
            bins = bins.select("*", F.posexplode("_middle").alias("_half", "_rank"))
        else:
            bins = bins.join(ranks, [*by, "_which"]).withColumn("_half", F.col("_which"))
        chosen = bins.where((F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
        chosen = cut_lineage(chosen.select(*by, "_which", "_bin", "_half", (F.col("_rank") - F.col("_from")).alias("_rank"), "_kinds", "_lo", "_hi"))
        part = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * _BINS)
        inner = F.when(F.col("_kinds") <= ranked, 0).otherwise(F.least(F.coalesce(part, F.lit(0)), F.lit(_BINS - 1)))
        near = rows.join(chosen, [*by, "_which", "_bin"]).select(*by, F.col("_half").alias("_which"), inner.cast("long").alias("_bin"), "_v", "_n")
        if chosen.where(F.col("_kinds") > ranked).isEmpty():
            break
        ranks = chosen.select(*by, F.col("_half").alias("_which"), "_rank")
        rows = cut_lineage(near)
    w = Window.partitionBy(*by, "_which").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("_upto", F.sum("_n").over(w)).join(chosen.select(*by, F.col("_half").alias("_which"), "_rank"), [*by, "_which"])
    values = placed.where((F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    found = values.groupBy(*by).agg((F.sum("_v") / F.count("*")).alias(name))
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], name)
