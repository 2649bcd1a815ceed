"""I-Match fingerprints of analysis descriptions: a lexicon within an idf band, hashed by random subsets.

DataFrame functions only. A lexicon keeps the terms whose inverse document frequency lies in a chosen
band. Each text keeps its distinct lexicon terms in sorted order; one hash is taken over all of them and
one over every randomised sub-lexicon (several seeds at each of the keep rates 1/4, 1/16, 1/64, 1/256).
Fine sub-lexicons see few terms of a long text and many hashes survive an edit; coarse ones do that for
short texts. The best share of equal hashes at one rate grades likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.llm.common import words

RATES, SEEDS = 4, 8
#: Lexicons up to this many terms are broadcast; larger ones are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: Fixed value: the digest of no terms.
NO_TERMS = "d41d8cd9"


def lexicon(analyses: DataFrame, text: str = "description", min_idf: float = 2.3, max_idf: float = 7.0) -> DataFrame:
    """Terms with ``min_idf <= ln(N / df) <= max_idf``: ``term`` and its ``code``.

    The code orders terms by a hash (high 31 bits) and says which sub-lexicons keep the term (low 32
    bits, rate by rate). As a term in the band is in at least one of ``exp(max_idf)`` texts, there are
    at most ``exp(max_idf)`` times the mean number of distinct terms per text of them, whatever the
    number of texts. Null texts count as empty ones; an empty table gives an empty lexicon.
    """
    terms = analyses.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = analyses.agg(F.count("*").alias("n")).select("n").scalar()
    idf = F.ln(total / F.col("df"))
    kept = F.lit(0).cast("long")
    for seed in range(SEEDS):
        head = _head(F.concat(F.lit(f"{seed}:"), F.col("term")))
        for rate in range(RATES):
            kept = kept + F.when(head < (1 << (30 - 2 * rate)), F.lit(1 << (rate * SEEDS + seed))).otherwise(F.lit(0)).cast("long")
    order = F.shiftright(_head(F.col("term")), 1)
    return counted.where(idf.between(min_idf, max_idf)).select("term", (F.shiftleft(order, 32) + kept).alias("code"))


def _head(value: Column) -> Column:
    """The first 32 bits of a value's md5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")


def fingerprints(analyses: DataFrame, terms: DataFrame, key: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per row of ``analyses``: its other columns and a fingerprint of each text column.

    ``key`` names columns that are unique together, ``texts`` maps a text column to the fingerprint's
    name. A fingerprint is the hash over all lexicon terms, then those of the sub-lexicons by rate and
    seed, joined by ``-``; an empty sub-lexicon gives an empty part. A text without any lexicon term
    takes its whole sorted word set in the first part, so unlike texts stay apart. Texts with the same
    set of lexicon terms (equal texts above all) have equal fingerprints. Null texts are empty ones.
    """
    kept = [c for c in analyses.columns if c not in texts]
    worded = analyses.select(*[F.col(f"`{c}`") for c in kept],
                             *[F.array_distinct(words(F.col(f"`{t}`"))).alias(f"_terms{i}") for i, t in enumerate(texts)])
    whole = [_digest(F.sort_array(f"_terms{i}")) for i in range(len(texts))]
    # one marker row per text row carries the other columns through the grouping
    sides = F.array(F.struct(F.lit(-1).alias("side"), F.array(F.lit("")).alias("terms")),
                    *[F.struct(F.lit(i).alias("side"), F.col(f"_terms{i}").alias("terms")) for i in range(len(texts))])
    keyed = worded.select(*key, F.struct(*[F.col(f"`{c}`") for c in kept], F.array(*whole).alias("_whole")).alias("_row"),
                          sides.alias("_sides"))
    keyed = keyed.select(*key, "_row", F.explode("_sides").alias("_s"))
    exploded = keyed.select(*key, F.when(F.col("_s.side") == -1, F.col("_row")).alias("_row"),
                            F.col("_s.side").alias("_side"), F.explode("_s.terms").alias("term"))
    known = terms.unionByName(terms.sparkSession.createDataFrame([("", 0)], "term string, code long"))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    own = [F.sort_array(F.collect_list(F.when(F.col("_side") == i, F.col("code")))).alias(f"_own{i}") for i in range(len(texts))]
    found = exploded.join(known, "term").groupBy(*key).agg(F.first("_row", ignorenulls=True).alias("_row"), *own)
    prints = []
    for i, name in enumerate(texts.values()):
        mine = F.col(f"_own{i}")
        full = F.when(F.size(mine) == 0, F.col("_row._whole")[i]).otherwise(_digest(mine))
        prints.append(F.concat_ws("-", full, *[_subset(mine, bit) for bit in range(RATES * SEEDS)]).alias(name))
    return found.select(*[F.col(f"_row.`{c}`") for c in kept], *prints)


def _digest(items: Column) -> Column:
    return F.substring(F.md5(F.array_join(items.cast("array<string>"), " ").cast("binary")), 1, 8)


def _subset(codes: Column, bit: int) -> Column:
    """The digest of the codes that a sub-lexicon keeps, empty if it keeps none."""
    part = F.filter(codes, lambda c: c.bitwiseAND(F.lit(1 << bit).cast("long")) != 0)
    return F.replace(_digest(part), F.lit(NO_TERMS), F.lit(""))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: at the best keep rate, equal hashes among those that are not empty in both fingerprints.

    Where fewer than half of a rate's hashes are in use, half of them is the divisor.
    """
    pairs = F.arrays_zip(F.split(one, "-").alias("a"), F.split(other, "-").alias("b"))

    def at(rate: int) -> Column:
        used = F.filter(F.slice(pairs, 2 + rate * SEEDS, SEEDS), lambda p: (p["a"] != "") | (p["b"] != ""))
        return F.size(F.filter(used, lambda p: p["a"] == p["b"])) / F.greatest(F.size(used), F.lit(SEEDS // 2))

    return F.when(one == other, 1.0).otherwise(F.greatest(*[at(r) for r in range(RATES)]))


def beside_next(analyses: DataFrame, row_id: str = "analysis_number", text: str = "description",
                block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Every row with the text of the next one in descending id order; after the last comes the first.

    Adds ``_block``/``_place`` (unique), ``_next_block``/``_next_place`` and ``_next_text``. Rows are
    sorted within blocks of ids; only the lowest row of each block looks into another one, so no task
    sees more than a block. The lowest rows of the blocks come as a second frame: the first one then stays
    partitioned by block and can be grouped by row without moving. Rows with equal ids follow in the order of their text's hash, null ids come
    last.
    """
    numbered = analyses.withColumn("_block", F.coalesce(F.floor(F.col(row_id) / block), F.lit(-(1 << 62))).cast("long"))
    w = Window.partitionBy("_block").orderBy(F.col(row_id).desc_nulls_last(), F.xxhash64(text), F.col(text))
    placed = numbered.withColumn("_place", F.row_number().over(w)).withColumn(
        "_next_text", F.coalesce(F.lead(F.coalesce(F.col(text), F.lit(""))).over(w))
    )
    inner = placed.where("_next_text is not null").select(
        "*", F.col("_block").alias("_next_block"), (F.col("_place") + 1).alias("_next_place")
    )
    heads = placed.where("_place = 1").select(F.col("_block").alias("_next_block"),
                                              F.coalesce(F.col(text), F.lit("")).alias("_next_text"))
    ends = placed.where("_next_text is null").drop("_next_text").join(_following(numbered), "_block")
    return inner, ends.join(heads, "_next_block").withColumn("_next_place", F.lit(1)).select(*inner.columns)


def _following(numbered: DataFrame, block: int = 4096) -> DataFrame:
    """For each id block the next lower one that has rows, the highest after the lowest."""
    blocks = numbered.groupBy("_block").agg(F.lit(1).alias("_one")).select(
        "_block", F.floor(F.col("_block") / block).alias("_outer"))
    within = Window.partitionBy("_outer").orderBy(F.col("_block").desc())
    outers = blocks.groupBy("_outer").agg(F.max("_block").alias("_first"))
    down = Window.orderBy(F.col("_outer").desc())
    after = outers.withColumn("_after", F.lead("_first").over(down))
    top = blocks.agg(F.max("_block").alias("m")).select("m").scalar()
    return (blocks.withColumn("_next_block", F.lead("_block").over(within)).join(after, "_outer")
            .select("_block", F.coalesce("_next_block", "_after", top).alias("_next_block")))
