"""Web addresses of map features: rules on hosts and paths, and boosted trees for what the rules leave open.

The trees see how an address is written (its length, depth, digits, entropy, parameters) and how often addresses with the
same suffixes were blocked, and learn from the addresses that the rules decide. DataFrame functions and Spark's
own trees only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.llm.common import LOWER, UPPER, stored

#: A rule: verdict, host, path.
Rule = tuple[str, str, str]
#: Addresses that the trees are trained on, about; taken by a hash of the address among all that rules decide.
SAMPLE = 20_000
#: Hash buckets of the suffixes of one kind, and the weight of the whole share in a bucket's share.
SUFFIX_BUCKETS, PRIOR = 4096, 20.0
TREES, DEPTH = 20, 4
_SEED = 13


def websites(features: DataFrame) -> DataFrame:
    """The map features with their ``website`` from ``tags_json``, null where they have none."""
    return features.withColumn("website", F.get_json_object("tags_json", "$.website"))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_rest(url), "/", 1)).otherwise("")
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    plain = F.substring_index(F.substring_index(F.when(F.instr(url, "://") > 0, _rest(url)).otherwise(""), "?", 1), "#", 1)
    slash = F.instr(plain, "/")
    return F.when(slash > 0, F.substring(plain, slash, F.length(plain))).otherwise("")


def host_suffixes(name: Column) -> Column:
    """The host and what remains of it without its first label, without its first two, ..."""
    labels = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting_rule(name: Column, place: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host is the host or what it ends in after a dot, and whose path begins the path.

    A struct of ``rule`` (host and path) and ``verdict``, null where none fits. Of equally long rules the one with the
    longer host counts, then the first by its bytes. Meant for a short list of rules, which becomes part of the expression.
    """
    by_host: dict[str, list[dict]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append({"rule": rule_host + rule_path, "path": rule_path, "verdict": verdict})
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.from_json(F.lit(json.dumps(by_host)), "map<string,array<struct<rule:string,path:string,verdict:string>>>")
    near = F.flatten(F.transform(F.filter(host_suffixes(name), lambda s: F.map_contains_key(table, s)), lambda s: F.element_at(table, s)))
    fitting = F.transform(F.filter(near, lambda r: F.startswith(place, r["path"])), lambda r: F.struct(
        (-F.length(r["rule"])).alias("size"), F.length(r["path"]).alias("rest"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_min(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)

    def share(c: Column) -> Column:
        return (n - F.length(F.replace(text, c))) / n

    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)


#: Suffixes whose share of blocked addresses the trees see: of the host, one label and two, and of the path.
SUFFIXES = ("end", "site", "kind")


def _suffix(kind: str) -> Column:
    if kind == "kind":
        return F.lower(F.regexp_extract("_path", r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.substring_index(F.col("_host"), ".", -1 if kind == "end" else -2)


def _lexical(url: Column) -> dict[str, Column]:
    plain, query = F.coalesce(url, F.lit("")), F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(plain, r"[^0-9]", ""))
    return {
        "length": F.length(plain), "host_length": F.length("_host"), "path_length": F.length("_path"), "query_length": F.length(query),
        "labels": F.when(F.col("_host") == "", 0).otherwise(F.size(F.split("_host", r"\."))),
        "depth": F.size(F.array_remove(F.split("_path", "/"), "")),
        "digit_ratio": digits / F.greatest(F.length(plain), F.lit(1)),
        "host_digit_ratio": F.length(F.regexp_replace("_host", r"[^0-9]", "")) / F.greatest(F.length("_host"), F.lit(1)),
        "hyphens": F.length("_host") - F.length(F.replace(F.col("_host"), F.lit("-"))),
        "entropy": _entropy(plain), "host_entropy": _entropy(F.col("_host")), "path_entropy": _entropy(F.col("_path")),
        "parameters": F.size(F.array_remove(F.split(query, "&"), "")),
        "fragment": F.contains(plain, F.lit("#")).cast("int"), "secure": F.startswith(F.lower(plain), F.lit("https:")).cast("int"),
    }


def _bucket(kind: str) -> Column:
    return F.pmod(F.xxhash64(_suffix(kind), F.lit(kind)), F.lit(SUFFIX_BUCKETS)).cast("int")


def suffix_shares(decided: DataFrame) -> DataFrame:
    """(kind, bucket, share) of blocked addresses among all of (_host, _path, _blocked): three times ``SUFFIX_BUCKETS`` rows."""
    each = decided.select("_blocked", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _bucket(k).alias("bucket")) for k in SUFFIXES])).alias("s"))
    counted = each.groupBy("s.kind", "s.bucket").agg(F.count("*").alias("n"), F.sum("_blocked").alias("blocked"))
    whole = decided.agg(F.coalesce(F.avg("_blocked"), F.lit(0.5)).alias("share")).first().share
    every = decided.sparkSession.range(SUFFIX_BUCKETS).select(F.explode(F.array(*map(F.lit, SUFFIXES))).alias("kind"), F.col("id").cast("int").alias("bucket"))
    n, blocked = F.coalesce("n", F.lit(0)), F.coalesce("blocked", F.lit(0))
    return every.join(counted, ["kind", "bucket"], "left").select("kind", "bucket", ((blocked + PRIOR * whole) / (n + PRIOR)).alias("share"))


def described(rows: DataFrame, url: str, shares: DataFrame) -> DataFrame:
    """The rows of (url, _host, _path, ...) with the columns that the trees see, ``f_...``."""
    out = rows.select("*", *[v.cast("double").alias(f"f_{k}") for k, v in _lexical(F.col(url)).items()], *[_bucket(k).alias(f"_b_{k}") for k in SUFFIXES])
    for kind in SUFFIXES:
        table = shares.where(F.col("kind") == kind).select(F.col("bucket").alias(f"_b_{kind}"), F.col("share").alias(f"f_{kind}"))
        out = out.join(F.broadcast(table), f"_b_{kind}")  # SUFFIX_BUCKETS rows
    return out.drop(*[f"_b_{k}" for k in SUFFIXES])


def train(decided: DataFrame, url: str = "website", most: int = SAMPLE) -> tuple[PipelineModel | str, DataFrame | None]:
    """(trees, suffix shares) from the addresses of (url, _host, _path, _verdict) that rules decide, each address once.

    Half of the addresses, by a hash, give the suffix shares (all of them count), the other half the trees' rows (about ``most``), so
    that no row is described by its own verdict. Where only one verdict occurs that verdict is given in place of trees,
    ``allow`` where there is none.
    """
    known = decided.where("_verdict is not null").withColumn("_blocked", (F.col("_verdict") == "block").cast("int"))
    place = F.xxhash64(F.col(url), F.lit(_SEED))
    found = {r.half: r for r in known.groupBy(F.pmod(place, F.lit(2)).alias("half")).agg(
        F.min("_verdict").alias("first"), F.max("_verdict").alias("last"), F.approx_count_distinct(url).alias("n")).collect()}
    verdicts = {v for r in found.values() for v in (r["first"], r["last"])}
    if len(verdicts) < 2 or 1 not in found or found[1]["first"] == found[1]["last"]:
        return min(verdicts, default="allow"), None
    shares = stored(suffix_shares(known.where(F.pmod(place, F.lit(2)) == 0)), "suffixes")
    part = F.pmod(F.shiftright(place, 1), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / found[1]["n"]))
    rows = known.where((F.pmod(place, F.lit(2)) == 1) & part).select(url, "_host", "_path", "_blocked").dropDuplicates([url])
    rows = stored(described(rows, url, shares).coalesce(1).sortWithinPartitions(url), "addresses")  # bounded by most
    trees = GBTClassifier(labelCol="_blocked", featuresCol="_seen", predictionCol="_guess", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=_SEED)
    seen = _assembler(rows)
    model = trees.setProbabilityCol("_odds").setRawPredictionCol("_raw").fit(seen.transform(rows))
    return PipelineModel([seen, model]), shares


def _assembler(rows: DataFrame) -> VectorAssembler:
    return VectorAssembler(inputCols=sorted(c for c in rows.columns if c.startswith("f_")), outputCol="_seen")


def judge(features: DataFrame, rules: Sequence[Rule], url: str = "website", most: int = SAMPLE) -> DataFrame:
    """The features with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score`` of their web address.

    The verdict is that of the longest fitting rule, see :func:`fitting_rule`; where none fits, that of trees that :func:`train` has
    learned from the addresses with rules. ``score`` is the trees' probability of ``block``, null where a rule decides. An
    address that is null or has no ``://`` has an empty host and path, no rule, and is judged by the trees as it stands.
    Equal addresses get equal verdicts; an empty table gives no rows. Columns of the result's names are replaced, others stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in features.columns if c not in {"host", "path", "rule", "verdict", "score"}]).alias("_row")
    rows = features.select(row, F.col(f"`{url}`").alias("_url"))
    rows = rows.select("*", host(F.col("_url")).alias("_host"), path(F.col("_url")).alias("_path"))
    rows = rows.select("*", fitting_rule(F.col("_host"), F.col("_path"), rules).alias("_rule")).withColumn("_verdict", F.col("_rule.verdict"))
    model, shares = train(rows, "_url", most)
    if shares is None:
        guess, odds = F.lit(model), F.lit(1.0 if model == "block" else 0.0)
    else:
        rows = model.transform(described(rows, "_url", shares))
        guess, odds = F.when(F.col("_guess") == 1.0, "block").otherwise("allow"), vector_to_array("_odds")[1]
    return rows.select("_row.*", F.coalesce("_host", F.lit("")).alias("host"), F.coalesce("_path", F.lit("")).alias("path"), F.col("_rule.rule").alias("rule"),
                       F.coalesce("_verdict", guess).alias("verdict"), F.when(F.col("_verdict").isNull(), odds).alias("score"))
