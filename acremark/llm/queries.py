"""The registered queries of this package: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acremark.llm import decontaminate, imatch, language, licences, mixing, phrases, ppm, quality, search, sharding, simhash, toxicity, urls
from acremark.llm.common import remainder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as analysis lists: their number and their description."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("analysis_number"), F.col("text").alias("description"))


@registered
def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = analyses(spark, sf_dir)
    terms = stored(imatch.lexicon(given), "lexicon")
    n, text = F.length("description"), F.col("description")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - cut), F.substring("_next_text", F.lit(1), cut))

    def prints(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
        return imatch.fingerprints(rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("_next_text"), terms,
                                   ["_block", "_place"], {"description": "fingerprint", "edited": "edited_fingerprint"})

    inner, ends = imatch.beside_next(given.withColumn("description", F.coalesce("description", F.lit(""))))
    printed = stored(prints(inner).unionByName(prints(ends)), "fingerprints")
    following = printed.select(F.col("_block").alias("_next_block"), F.col("_place").alias("_next_place"),
                               F.col("fingerprint").alias("_following"))
    return printed.join(following, ["_next_block", "_next_place"]).select(
        F.col("analysis_number").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as bus artifacts: their id and payload."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("payload_json"))


@registered
def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("payload_json"), F.lit(""))
    given = artifacts(spark, sf_dir).select(
        "*", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(given, 8).select(
        F.col("artifact_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@registered
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(artifacts(spark, sf_dir)).withColumnRenamed("artifact_id", "doc_id")


@registered
def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.passages(analyses(spark, sf_dir), items)
    return found.select(
        F.col("analysis_number").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLE["op8_benchmark_passages"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, gram.n, item_id FROM gram JOIN win ON gram.words = win.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@registered
def op10_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("analysis_number"), 7) == 2
    scored = ppm.text_scores(analyses(spark, sf_dir), ~held)
    return scored.withColumn("held_out", held).withColumnRenamed("analysis_number", "doc_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("analysis_number"), F.col("quality").alias("usable"), F.col("toxic").alias("offensive"))


@registered
def op4_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("analysis_number"), 4) == 2
    given = analyses(spark, sf_dir)
    machine = toxicity.train(given, labels(spark, sf_dir), ~held)
    return toxicity.score(given, machine).select(
        F.col("analysis_number").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@registered
def op2_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("analysis_number"), 4) == 2
    given = analyses(spark, sf_dir)
    space = quality.train(given, labels(spark, sf_dir), ~held)
    return quality.score(given, space).select(
        F.col("analysis_number").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@registered
def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("osm_id"), 5) == 0
    given = documents(spark, sf_dir).select(F.col("doc_id").alias("osm_id"), F.col("text").alias("description"), F.col("lang").alias("language"))
    recogniser = language.train(given, ~held)
    return language.recognise(given.drop("language"), recogniser).select(
        F.col("osm_id").alias("doc_id"), held.alias("held_out"), F.col("language_pred").alias("lang_pred"), "score")


#: Short forms, usual headers and lines of well-known licences.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "odbl-1.0": "This database is made available under the Open Database License.",
    "all-rights-reserved": "All rights reserved.",
    "spdx": "SPDX-License-Identifier:",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
    'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    **{f"{name}-{version}-header": f"{kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {family}General Public "
       f"License as published by the Free Software Foundation; either version {version.removesuffix('.0')} of the License, or (at your option) any "
       f"later version. {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
       f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {family}General Public License for more details."
       for name, version, family, kind in (("gpl", "2.0", "", "This program"), ("gpl", "3.0", "", "This program"),
                                           ("lgpl", "2.1", "Lesser ", "This library"), ("lgpl", "3.0", "Lesser ", "This library"))},
}


def licence_templates() -> dict[str, str]:
    """:data:`NOTICES` and the whole texts of ``licence_texts``, named by their file with ``-text``."""
    whole = resources.files(__package__) / "licence_texts"
    return NOTICES | {f"{f.name.removesuffix('.txt').lower()}-text": f.read_text("utf-8") for f in sorted(whole.iterdir(), key=lambda f: f.name)}


@registered
def op9_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.notices(analyses(spark, sf_dir), licence_templates()).withColumnRenamed("analysis_number", "doc_id")


LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@registered
def op7_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = documents(spark, sf_dir).select(
        F.col("doc_id").alias("artifact_id"), F.col("text").alias("payload_json"), F.substring("source", 1, 4).alias("producer_skill"),
        F.col("lang").alias("artifact_type"), F.col("source").alias("artifact_key"))
    chosen = mixing.mix(given, 0.5, {"artifact_type": LANGUAGE_WEIGHTS})
    return chosen.select(F.col("artifact_id").alias("doc_id"), F.col("producer_skill").alias("domain"), F.col("artifact_type").alias("lang"),
                         F.col("artifact_key").alias("source"), "n_tokens", "copies")


ORACLE["op7_hierarchical_mixture"] = r"""
WITH d AS (
  SELECT doc_id, substr(source, 1, 4) AS domain, lang, source, coalesce(substr(source, 1, 4), '') AS a, coalesce(lang, '') AS b, coalesce(source, '') AS c,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens FROM documents),
leaf AS (SELECT a, b, c, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY a, b, c),
n1 AS (SELECT a, CAST(sum(tokens) * 2 AS DOUBLE) AS cap, CAST(1 AS DOUBLE) AS w FROM leaf GROUP BY a),
f1 AS (SELECT *, (CAST((SELECT floor(sum(tokens) * CAST(0.5 AS DOUBLE) + 1e-6) FROM leaf) AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / w, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM n1),
b1 AS (SELECT a, least(cap, greatest(0, max(fill) OVER () * w)) AS budget FROM f1),
n2 AS (SELECT leaf.a, b, CAST(sum(tokens) * 2 AS DOUBLE) AS cap, CAST(CASE b WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 1 END AS DOUBLE) AS w
  FROM leaf GROUP BY leaf.a, b),
f2 AS (SELECT n2.*, (budget - coalesce(sum(cap) OVER (PARTITION BY n2.a ORDER BY cap / w, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY n2.a ORDER BY cap / w, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM n2 JOIN b1 ON n2.a = b1.a),
b2 AS (SELECT a, b, least(cap, greatest(0, max(fill) OVER (PARTITION BY a) * w)) AS budget FROM f2),
n3 AS (SELECT a, b, c, tokens, CAST(tokens * 2 AS DOUBLE) AS cap, CAST(1 AS DOUBLE) AS w FROM leaf),
f3 AS (SELECT n3.*, (budget - coalesce(sum(cap) OVER (PARTITION BY n3.a, n3.b ORDER BY cap / w, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY n3.a, n3.b ORDER BY cap / w, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
  FROM n3 JOIN b2 ON n3.a = b2.a AND n3.b = b2.b),
b3 AS (SELECT a, b, c, tokens, CAST(floor(least(cap, greatest(0, max(fill) OVER (PARTITION BY a, b) * w)) + 1e-6) AS BIGINT) AS budget FROM f3),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b3),
o AS (SELECT d.*, whole, budget - whole * tokens AS rest, md5('17:' || whole || ':' || doc_id) AS h FROM d JOIN e ON d.a = e.a AND d.b = e.b AND d.c = e.c),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY a, b, c ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o),
r AS (SELECT doc_id, domain, lang, source, n_tokens, least(whole, 2) + CASE WHEN upto <= rest AND whole < 2 THEN 1 ELSE 0 END AS copies FROM s)
SELECT * FROM r WHERE copies > 0
"""


@registered
def op11_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("payload_json"))
    lists = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("key"), F.col("text").alias("description"))
    return search.search(artifacts, lists, 10).select(F.col("key").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLE["op11_automaton_search"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc),
term AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM doc) GROUP BY doc_id, n, term),
item AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM term GROUP BY term), size),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS v FROM term JOIN weight USING (term), size),
total AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM item JOIN part USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM total WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@registered
def op12_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = documents(spark, sf_dir).select(F.col("lang").alias("artifact_type"), F.col("text").alias("payload_json"))
    return phrases.collocations(artifacts).withColumnRenamed("artifact_type", "lang").withColumn("rank", F.col("rank").cast("long"))


ORACLE["op12_tiled_collocations"] = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS id, w FROM (
    SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS p FROM documents)) WHERE len(w) > 0),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS words FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, words, count(*) AS a FROM gram GROUP BY lang, k, words HAVING count(*) >= 30),
cut AS (SELECT lang, k, words, a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (
  SELECT cut.lang, cut.k, cut.words, cut.a, c, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * cut.a) // (l.a + r.a) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.words = list_slice(cut.words, 1, c) JOIN f r ON r.lang = cut.lang AND r.words = list_slice(cut.words, c + 1, cut.k)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, c) AS o FROM scored) WHERE o = 1),
sub AS (
  SELECT lang, max(a) AS a, list_slice(words, i, i + m - 1) AS words FROM (
    SELECT lang, words, k, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY lang, list_slice(words, i, i + m - 1)),
kept AS (
  SELECT best.*, list_aggregate(best.words, 'string_agg', ' ') AS phrase FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.words = best.words
  WHERE sub.a IS NULL OR CAST(100 AS HUGEINT) * sub.a < 80 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


#: The rules as the contract states them.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@registered
def op13_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("osm_id"), F.col("url").alias("website"))
    return urls.judge(features, URL_RULES).select(F.col("osm_id").alias("page_id"), "host", "path", "rule", "verdict", "score")
