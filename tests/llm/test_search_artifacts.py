"""Ranked search of bus artifacts against a plain loop over all pairs of payload and list."""

import math
import random
import re

from acremark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ARTIFACT = "id long, run_id string, producer_skill string, artifact_type string, payload_json string, rank string, score string"


def found(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def ranked(artifacts, lists, limit=10):
    texts = [(i, found(t)) for i, t in artifacts]
    texts = [(i, t) for i, t in texts if t]
    count, total = len(texts), sum(len(t) for _, t in texts)
    out = []
    for key in sorted({k for k, _ in lists if k is not None}):
        wanted = {t for k, d in lists if k == key for t in found(d)}
        rows = []
        for i, have in texts:
            m, value = 10 + 90 * len(have) * count // total, 0
            for t in wanted & set(have):
                df = sum(t in other for _, other in texts)
                tf = have.count(t)
                value += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if value > 0:
                rows.append((-value, (i is not None, i or 0), i))
        out += [(key, n + 1, i, -v) for n, (v, _, i) in enumerate(sorted(rows, key=lambda r: r[:2])[:limit])]
    return out


def given(spark, artifacts):
    return spark.createDataFrame([(i, "run-1", "osm_hotspot_grid", "cells", t, "x", "y") for i, t in artifacts], ARTIFACT)


def lists_of(spark, lists):
    return spark.createDataFrame([(k, "title", d) for k, d in lists], "key string, title string, description string")


def test_equals_a_plain_loop(spark):
    rng = random.Random(3)
    names = ["łąka", "las", "Road", "way", "hotspot", "a", "b1", "żuraw", "P7", "x", "straße", "bridge"]
    texts = [" ".join(rng.choices(names, k=rng.randint(1, 40))).replace("a x", "a,x;") for _ in range(300)]
    artifacts = [(i, t) for i, t in enumerate(texts)] + [(i + 300, texts[i % 7]) for i in range(60)]
    artifacts += [(900, None), (901, ""), (902, " ,. "), (903, "las" * 5000), (904, "las " * 20000), (None, texts[0]), (5, texts[0])]
    lists = [("k1", "Las, road; way"), ("k2", "łąka łąka ŁĄKA żuraw"), ("k2", "b1"), ("k3", None), ("k4", ""), ("k5", "nowhere"), (None, "las"),
             ("k6", "a x"), ("k7", " ".join(names))]
    got = search.search(given(spark, artifacts).repartition(5), lists_of(spark, lists)).collect()
    assert sorted(map(tuple, got)) == sorted(ranked(artifacts, lists))
    assert [f.name for f in search.search(given(spark, artifacts), lists_of(spark, lists)).schema] == ["key", "rank", "id", "score"]
    blockwise = search.search(given(spark, artifacts), lists_of(spark, lists), limit=3, block_terms=3).collect()
    assert sorted(map(tuple, blockwise)) == sorted(ranked(artifacts, lists, 3))


def test_empty_tables(spark):
    assert search.search(given(spark, []), lists_of(spark, [("k", "las")])).count() == 0
    assert search.search(given(spark, [(1, "las")]), lists_of(spark, [])).count() == 0
    assert search.search(given(spark, [(1, None), (2, "..")]), lists_of(spark, [("k", "las")])).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    got = search.search(given(spark, [(i, "las las" if i < 500 else "road") for i in range(900)]).repartition(7), lists_of(spark, [("k", "las"), ("z", "LAS!")]), 4)
    assert [(r.key, r.rank, r.id) for r in got.orderBy("key", "rank").collect()] == [(k, i + 1, i) for k in "kz" for i in range(4)]


def test_norms_beyond_64_bits():
    import numpy as np

    n = np.array([1, 10**12], np.int64)
    assert search.length_norms(n, 10**9, 10**13).tolist() == [10 + 90 * 10**9 // 10**13, 10 + 90 * 10**21 // 10**13]
