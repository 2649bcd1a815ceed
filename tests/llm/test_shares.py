"""Language shares of the pipeline's mixture."""

from collections import Counter

import numpy as np

import corpus_pipeline
from acremark.llm import queries


def test_mixture_meets_the_language_weights(spark):
    rng = np.random.default_rng(3)
    langs = ["en"] * 60 + ["de"] * 13 + ["fr"] * 13 + ["es"] * 12 + [None, "pl"]
    rows = [(i, "word " * int(rng.integers(20, 60)), langs[int(rng.integers(100))], f"src{i % 20}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter()
    sources = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.lang] += len(r.text.split())
        sources[r.source] += len(r.text.split())
    total = sum(got.values())
    for lang, weight in queries.LANGUAGE_WEIGHTS.items():
        assert abs(got[lang] / total - weight / 1.02) < 0.02
    assert got[None] / total < 0.02 and got["pl"] / total < 0.02
    assert len(sources) == 20 and max(sources.values()) < 1.6 * min(sources.values())
