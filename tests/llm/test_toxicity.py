"""What the toxicity machine learns from train(): pairs of words, the share of labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acremark.llm import common, toxicity


def scores(spark, texts, labels, most=toxicity.SAMPLE):
    frame = spark.createDataFrame(list(enumerate(texts)), "analysis_number long, description string")
    known = spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v is not None], "analysis_number long, offensive int")
    machine = toxicity.train(frame, known, F.lit(True), most=most)
    return [r.score for r in toxicity.score(frame, machine).orderBy("analysis_number").collect()], machine


@pytest.mark.parametrize("others, words", [(30, 4), (2500, 20)])
def test_train_learns_what_only_a_pair_tells(spark, others, words):
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 4, 1200)
    fill = [f"{i:04x}f" for i in rng.permutation(others)]
    texts = [" ".join([*rng.choice(fill, words), *(["group"] if k & 1 else []), *(["vermin"] if k & 2 else [])]) for k in kinds]
    toxic = [int(k in (0, 3)) for k in kinds]
    got, _ = scores(spark, texts, [v if i < 900 else None for i, v in enumerate(toxic)])
    assert np.mean([(s >= 0.5) == v for s, v in zip(got[900:], toxic[900:])]) > 0.9


def test_scores_do_not_depend_on_the_rate_of_the_sample(spark):
    rng = np.random.default_rng(6)
    toxic = [int(rng.random() < 0.1) for _ in range(3000)]
    texts = [f"{'weak' if rng.random() < (0.4 if v else 0.2) else 'other'} f{rng.integers(20)}" for v in toxic]
    for most in (4000, 400):
        got, _ = scores(spark, texts, toxic, most)
        assert abs(np.mean(got) - np.mean(toxic)) < 0.05
    got, _ = scores(spark, texts, [None] * 3000)
    assert max(got) < 0.3


def test_of_two_labels_of_one_id_the_larger_counts(spark):
    known = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 7)], "analysis_number long, offensive int")
    assert sorted(map(tuple, common.known_labels(known, "analysis_number", "offensive").collect())) == [(1, 1), (2, 0)]


def test_sample_is_bounded_and_whole_where_small(spark):
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)], "analysis_number long, offensive int")
    taken = common.bounded_sample(known, "analysis_number", "offensive", 700, 1, each=True).groupBy("offensive").count().collect()
    assert sorted(map(tuple, taken)) == [(0, 700), (1, 700)]
    assert common.bounded_sample(known, "analysis_number", "offensive", 5000, 1).count() == 3000


def test_pairs_equal_a_plain_count(spark):
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(600)]
    labels = np.array([float((3 in r) != (17 in r)) if i % 9 else float(i % 2) for i, r in enumerate(rows)])
    sample = toxicity.Sample.of(np.concatenate(rows), np.array([len(r) for r in rows]), labels)
    has = np.stack([np.isin(np.arange(40), r) for r in rows])
    told = set()
    for a in range(40):
        for b in range(a):
            odds = []
            for part in (has[:, a], ~has[:, a]):
                n = [((has[:, b] == p) & (labels == v) & part).sum() + 0.5 for p in (1, 0) for v in (1, 0)]
                odds.append((np.log(n[0] * n[3] / (n[1] * n[2])), sum(1 / x for x in n)))
            if (odds[0][0] - odds[1][0]) ** 2 / (odds[0][1] + odds[1][1]) >= 25:
                told |= {a, b}
    assert {3, 17} <= told and sample.kept[toxicity.pair_buckets(spark, sample)].tolist() == sorted(told)


def test_steps_follow_the_gradient():
    """One step on all rows, with rate 1 and no decay to speak of, against gradients by differences."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(30)]
    labels = rng.integers(0, 2, 30).astype(float)
    sample = toxicity.Sample.of(np.concatenate(rows), np.array([len(r) for r in rows]), labels)
    none = np.zeros(0, np.int64)
    before, after = (toxicity.fit(sample, none, epochs=e, batch=1000, rate=1e-6) for e in (0, 1))

    def loss(weights, vectors, bias):
        machine = toxicity.Machine(bias, sample.kept, weights, vectors)
        odds = np.array([machine.score(r) for r in rows])
        return -(labels * np.log(odds) + (1 - labels) * np.log(1 - odds)).mean()

    for i in range(len(sample.kept)):
        up = before.weights.copy()
        up[i] += 1e-5
        slope = (loss(up, before.vectors, before.bias) - loss(before.weights, before.vectors, before.bias)) / 1e-5
        assert abs(slope) < 1e-3 or np.sign(slope) == -np.sign(after.weights[i] - before.weights[i])
