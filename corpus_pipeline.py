"""A training corpus from the documents: toxic, repeated and contaminated ones go, sources are mixed, shards made.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows of docs
and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns that they got. ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acremark.llm import decontaminate, mixing, queries, resemblance, sharding, toxicity
from acremark.llm.common import remainder, stored

#: Fixed value: the weight of each language that has none among queries.LANGUAGE_WEIGHTS, null included.
OTHER_LANGUAGES = 0.01


def _whole(docs: DataFrame, **columns) -> DataFrame:
    """The rows as one struct column ``_row`` beside what an operator needs, so that no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.3; null and empty texts stay."""
    rows = _whole(docs, analysis_number=F.col("doc_id"), description=F.col("text"))
    held = remainder(F.col("analysis_number"), 4) == 2
    machine = toxicity.train(rows.drop("_row"), queries.labels(spark, sf_dir), ~held)
    kept = toxicity.score(rows, machine).where(F.col("description").isNull() | (F.col("description") == "") | (F.col("score") < 0.3))
    return kept.select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar texts: 5-word shingles, Jaccard 0.8 or more.

    SimHash by anchor-point covering finds the first links, each checked exactly; an exact join of the rest completes them.

    Of rows with one id, those with texts of different groups stay. Rows without an id stay, as nothing names them.
    """
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(docs.columns)])), 256)
    rows = docs.where("doc_id is not null").withColumn("_name", F.struct(F.col("doc_id").alias("id"), text.alias("text"), row.alias("row")))
    named = stored(resemblance.nodes(rows.withColumn("text_hash", F.xxhash64("text")), "text", "_name", "text_hash"), "nodes")
    found = named.join(resemblance.roots(rows, "text", named.select("node", "simhash", "text_hash")), "node", "left")
    kept = found.groupBy(F.coalesce("root", "node")).agg(F.min("_name").alias("_name")).select("_name")
    rows = rows.join(kept, "_name", "left_semi").dropDuplicates(["_name"])  # rows of one name are equal
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("text")))
    rows = _whole(docs, analysis_number=name, description=F.col("text"))
    found = decontaminate.passages(rows.drop("_row"), items)
    bad = found.where("n_hit > 0 and 20 * n_hit >= n_words").select("analysis_number").distinct()
    return rows.join(bad, "analysis_number", "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, drawn by the languages' weights, then evenly by domain and source, none twice.

    The domain is what precedes the first of ``/ : . _ -`` in the source; sources without one share a domain.
    Null and unlisted languages have the weight ``OTHER_LANGUAGES``.
    """
    domain = F.regexp_extract(F.coalesce("source", F.lit("")), r"^([^/:._-]+)[/:._-]", 1)
    rows = _whole(docs, artifact_id=F.col("doc_id"), payload_json=F.col("text"), producer_skill=domain,
                  artifact_type=F.col("lang"), artifact_key=F.col("source"))
    weights = {"artifact_type": {**queries.LANGUAGE_WEIGHTS, None: OTHER_LANGUAGES}}
    levels = ("artifact_type", "producer_skill", "artifact_key")
    return mixing.mix(rows, 0.5, weights, levels, epochs=1).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``shard`` (0 to 7, nearly equal bytes) and ``slot`` in it."""
    return sharding.shard(docs, 8, "doc_id", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("sharding", shard),
]

#: Models and connected fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
