"""Mixing bus artifacts to target weights by budgets that run down a tree of their origin.

The token budget is split at each node of the tree (producer, type, key) among its children by their
weights. A child that has fewer tokens than its share gives the rest to its siblings, and only what a
whole subtree cannot use goes up. Each leaf takes whole epochs of its rows and then, in the seeded order
of the next epoch, the longest run of rows that its remaining budget pays for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.llm.common import stored, words
from acremark.operators.ordering import sums_before

#: Budgets of up to this many leaves are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 200_000
LEVELS = ("producer_skill", "artifact_type", "artifact_key")


def _weight(level: str, weights: dict[str, dict[str, float]], value: Column) -> Column:
    given = weights.get(level) or {}
    out = F.lit(float(given.get(None, 1.0)))
    for name, w in ((k, w) for k, w in given.items() if k is not None):
        out = F.when(value == name, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: Column, levels: list[str], weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """Leaves (the levels and ``tokens``) with the whole number of tokens that each may give, ``budget``.

    Among siblings in order of capacity by weight, the level to which all are filled is the greatest of
    (what the budget leaves after the smaller ones) / (weights from here on).
    """
    parents = None
    for i, level in enumerate(levels):
        path = levels[: i + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("_cap"))
        nodes = nodes.withColumn("_w", _weight(level, weights, F.col(level)))
        nodes = nodes.withColumn("_b", budget.cast("double")) if parents is None else nodes.join(parents, levels[:i])
        over = Window.partitionBy(*levels[:i]) if i else Window.partitionBy(F.lit(0))
        by = over.orderBy(F.col("_cap") / F.col("_w"), level)
        before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_fill", (F.col("_b") - before) / rest)
        nodes = nodes.withColumn("_fill", F.max("_fill").over(over))
        parents = nodes.select(*path, F.least("_cap", F.greatest(F.lit(0.0), F.col("_fill") * F.col("_w"))).alias("_b"))
    return leaves.join(parents, levels).select(*levels, "tokens", F.floor(F.col("_b") + 1e-6).alias("budget"))


def mix(artifacts: DataFrame, share: float, weights: dict[str, dict[str, float]], levels: tuple[str, ...] = LEVELS,
        artifact_id: str = "artifact_id", payload: str = "payload_json", epochs: int = 2, seed: int = 17) -> DataFrame:
    """The chosen rows with ``n_tokens`` (words between blanks) and ``copies`` (1 to ``epochs``).

    ``share`` of all tokens is the budget; ``weights`` gives positive weights by level and value; others
    have that of None, or 1. Null values of a level count as the empty name. Rows without words cost nothing and
    are kept as long as their leaf's run lasts. Rows with equal ids are drawn one after the other. An
    empty table gives no rows; columns named like the new ones are replaced.
    """
    clean = artifacts.drop("n_tokens", "copies")
    keys = [f"_l{i}" for i in range(len(levels))]
    rows = clean.select("*", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in zip(keys, levels)],
                        F.size(words(F.col(payload))).cast("long").alias("n_tokens"))
    leaves = stored(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share + 1e-6).alias("b")).select("b").scalar()
    named = {k: weights.get(c, {}) for k, c in zip(keys, levels)}
    budgets = leaf_budgets(leaves, total, keys, named, epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    budgets = budgets.withColumn("_full", full).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens"))
    budgets = budgets.drop("tokens", "budget")
    # a join that deals rows by leaf would put a hot leaf into one task
    drawn = rows.join(F.broadcast(budgets) if leaves.count() <= BROADCAST_LEAVES else budgets, keys)
    key = F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col(artifact_id).cast("string"), F.lit("")))
    drawn = drawn.withColumn("_order", F.md5(key.cast("binary"))).withColumn("_block", F.substring("_order", 1, 2))
    upto = sums_before(drawn, keys, "_block", [F.col("_order"), F.col(artifact_id)], F.col("n_tokens"), "_before")
    more = (F.col("_before") + F.col("n_tokens") <= F.col("_rest")) & (F.col("_full") < epochs)
    copies = F.least(F.col("_full"), F.lit(epochs)) + more.cast("int")
    return upto.select(*[F.col(f"`{c}`") for c in clean.columns], "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
