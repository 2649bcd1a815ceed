"""The language kernel against plain sets and a dense regression, and on long texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acremark.llm import language

STEMS = {"pl": ["łąka", "droga", "działka", "przy", "rzeka", "las"], "de": ["wiese", "straße", "fluss", "grundstück", "und", "der"],
         "en": ["meadow", "road", "the", "river", "plot", "and"]}


def plain_runs(text):
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    return [{plain[i:i + n] for i in range(len(plain) - n + 1)} for n in (1, 2, 3)]


def kernel(a, b):
    return sum(len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(plain_runs(a), plain_runs(b))) / 3


def sentences(n, seed=3, words=9):
    rng = np.random.default_rng(seed)
    names = sorted(STEMS)
    return [(" ".join(rng.choice(STEMS[names[i % 3]], words)) + ["", " 12!", "  x-y"][i // 3 % 3], names[i % 3]) for i in range(n)]


def test_margins_equal_a_dense_regression():
    learned, fresh = sentences(60), [t for t, _ in sentences(20, 8)] + ["Nowhere land", "é", "a b c"]
    texts, names = [t for t, _ in learned], sorted(STEMS)
    model = language.fit(texts, [v for _, v in learned], landmarks=30, ridge=1e-2)
    marks = [t for n in names for t in [t for t, v in learned if v == n][:10]]
    middle = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(middle)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = np.array([[kernel(t, m) for m in marks] for t in texts]) @ root
    wanted = np.array([[1.0 if v == n else -1.0 for n in names] for _, v in learned])
    solved = np.linalg.solve(features.T @ features + 1e-2 * 60 * np.eye(features.shape[1]), features.T @ wanted)
    want = np.array([[kernel(t, m) for m in marks] for t in fresh]) @ root @ solved
    got = model.margins([language.runs(t) for t in fresh])
    assert np.abs(got - want).max() < 1e-3
    assert [p for p, _ in model.predict(fresh)] == [names[i] for i in want.argmax(axis=1)]


def test_long_texts_keep_their_language():
    learned = sentences(120)
    model = language.fit([t for t, _ in learned], [v for _, v in learned])
    for name, stems in STEMS.items():
        rng = np.random.default_rng(1)
        parts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzłśäöü"), 3)) for _ in range(4000)]
        long = " ".join([*rng.choice(stems, 150_000), *parts])
        assert len(long) > 600_000
        assert model.predict([long, long[:1000]])[0][0] == name


def test_runs_are_exact():
    for text in ["abc", "a", "Zażółć gęślą jaźń", "x" * 5, "a1b2", "\U0001F600a"]:
        got = [{int(v) for v in part} for part in language.runs(text)]
        assert got == [{sum(ord(c) << 21 * (len(r) - 1 - k) for k, c in enumerate(r)) for r in part} for part in plain_runs(text)]
    assert language.runs("12 .,") is None and language.runs(None) is None


def test_sample_of_each_language_is_bounded(spark, monkeypatch):
    rows = [(i, t, v if i % 10 else "en") for i, (t, v) in enumerate(sentences(3000))] + [(i, "only one here", "cs") for i in range(5000, 5003)]
    frame = spark.createDataFrame(rows, "osm_id long, description string, language string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, languages, *a: seen.append(dict(zip(*np.unique(languages, return_counts=True)))))
    language.train(frame, F.lit(True), most=50)
    assert seen == [{"cs": 3, "de": 50, "en": 50, "pl": 50}]


@pytest.mark.parametrize("text", ["łąka", "rzeka przy drodze"])
def test_equal_fits_go_to_the_first_name(text):
    model = language.fit([text, text], ["pl", "cs"])
    assert model.predict([text])[0][0] == "cs"
