"""Passages of reference texts inside analysis descriptions, by a prefix-filtered set join.

DataFrame functions only. Each window of a reference item (13 consecutive words, or the whole item if it
has fewer) must occur word for word. Words are ordered by how rarely the descriptions use them; since all
of a window's words must be there, its rarest word alone is a sufficient prefix. A description's words are
joined to the windows' prefix words; the word's place in the window gives the only place where the window
can lie, the lengths bound it, and the words there are compared exactly before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.llm.common import ASCII_NON_WORD, stored, words

#: Windows up to this many words in all are broadcast; more are left to Spark's own choice of join.
BROADCAST_WORDS = 20_000_000


def windows(items: DataFrame, row_id: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """Distinct windows: ``window`` (its words) and ``items`` (ids that have it). Items without words have none."""
    w = F.col("_w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
    return (
        items.select(F.col(row_id).alias("_item"), words(F.col(text), ASCII_NON_WORD).alias("_w"))
        .where("size(_w) > 0")
        .select("_item", F.explode(F.transform(starts, lambda i: F.slice(w, i, size))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("_item").alias("items"))
    )


def with_prefix(found: DataFrame, analyses: DataFrame, text: str = "description") -> DataFrame:
    """Adds each window's rarest word in the descriptions (``prefix``) and that word's offset in it."""
    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    used = analyses.select(F.explode(words(F.col(text), ASCII_NON_WORD)).alias("word"))
    rarity = vocabulary.join(used.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    ranked = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("word")).alias("l"), "word", "at")
    spread = found.select("window", "items", F.posexplode("window").alias("at", "word")).join(rarity, "word")
    best = spread.groupBy("window").agg(F.min(ranked).alias("best"), F.first("items").alias("items"))
    return best.select("window", "items", F.col("best.word").alias("prefix"), F.col("best.at").alias("at"))


def passages(analyses: DataFrame, items: DataFrame, analysis_id: str = "analysis_number", text: str = "description",
             item_id: str = "item_id", item_text: str = "text", size: int = 13) -> DataFrame:
    """One row per row of ``analyses``: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), and ``items`` (sorted ids, as strings, of the items whose windows occur).

    Null texts have no words. Rows that are equal in id and text are each counted as such. Empty tables
    and items without words give no hits. Null item ids count as the id ``null``.
    """
    known = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("text"))
    found = stored(with_prefix(windows(known, "item_id", "text", size), analyses, text), "windows")
    total = found.agg(F.sum(F.size("window"))).first()[0] or 0
    # a first pseudo-word of every text meets this row, so each text gives a row with its length
    marker = found.sparkSession.createDataFrame([([""], None, "", 0)], found.schema)
    lexicon = found.unionByName(marker)
    lexicon = F.broadcast(lexicon) if total <= BROADCAST_WORDS else lexicon
    worded = analyses.select(
        F.struct(F.col(analysis_id).alias("id"), F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row")).alias("_row"),
        F.concat(F.array(F.lit("")), words(F.col(text), ASCII_NON_WORD)).alias("_w"),
    )
    spread = worded.select("_row", "_w", F.posexplode("_w").alias("_at", "prefix"))
    start = F.col("_at") - F.col("at")
    inside = (start >= 0) & (start + F.size("window") <= F.size("_w")) & (F.slice("_w", start + 1, F.size("window")) == F.col("window"))
    hits = spread.join(lexicon, "prefix").where(inside)
    hits = hits.select(
        "_row", "items", F.when(F.col("prefix") == "", F.size("_w") - 1).alias("n_words"),
        F.when(F.col("prefix") != "", F.struct(start.alias("start"), (start + F.size("window")).alias("end"))).alias("span"))
    grouped = hits.groupBy("_row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.select(F.col("_row.id").alias(analysis_id), "n_words", _covered(F.col("spans")).alias("n_hit"), "items")


def _covered(spans: Column) -> Column:
    """Length of the union of (start, end) spans that are sorted by start."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto")),
    )
    return state["n"]
