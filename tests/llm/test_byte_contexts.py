import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acremark.llm import ppm

TEXTS = ["The road by the plot", "the plot by the river", None, "", "a plot of the road  the road", "THE other road\nby the lake", "quartz lakes by thé road",
         "by the plot the plot the plot", "zebra"]


def plain_scores(streams, learn, order):
    """Method C with exclusion over whole texts, by definition."""
    nodes = Counter()
    for i, s in enumerate(streams):
        if learn(i):
            for at in range(order, len(s)):
                for k in range(order + 1):
                    nodes[s[at - k : at], s[at]] += 1
    for s in streams:
        total = 0.0
        for at in range(order, len(s)):
            p, gone = 1.0, set()
            for k in range(order, -1, -1):
                own = {x: n for (c, x), n in nodes.items() if c == s[at - k : at]}
                left = {x: n for x, n in own.items() if x not in gone}
                whole = sum(left.values()) + len(left)
                if s[at] in left:
                    p *= left[s[at]] / whole
                    break
                p *= len(left) / whole if left else 1.0
                gone |= set(own)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        yield total


@pytest.mark.parametrize("order, bounds", [(4, {}), (2, {}), (4, {"words": 3, "windows": 20}), (4, {"words": 1, "windows": 0, "nodes": 0})])
def test_byte_contexts_run_over_whole_texts(spark, order, bounds):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "analysis_number long, description string")
    words = [(t or "").lower().encode().split() for t in TEXTS]
    streams = [b" " * order + b" ".join(w) + b"\n" for w in words]
    counts = Counter(w for i, ws in enumerate(words) if i % 3 != 1 for w in [*ws, b""])
    n, v = sum(counts.values()), len(counts)
    got = {r.analysis_number: r for r in ppm.text_scores(frame, F.col("analysis_number") % 3 != 1, order=order, **bounds).collect()}
    for i, (ws, wanted) in enumerate(zip(words, plain_scores(streams, lambda i: i % 3 != 1, order))):
        assert got[i].score == pytest.approx(wanted)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, b""]))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws) + 1, sum(w in counts for w in [*ws, b""]), n)


def test_known_words_are_coded_after_the_bytes_before_the_blank(spark):
    """Each word follows each, but only one ending precedes it often; words alone or rare pairs cannot tell that."""
    rows = [(i, f"plot{i}ax mill{i}") for i in range(40)] + [(100 + i, f"plot{i}or lake{i}") for i in range(40)] + [(200, "newax mill1"), (201, "newax lake1")]
    frame = spark.createDataFrame(rows, "analysis_number long, description string")
    got = {r.analysis_number: r.score for r in ppm.text_scores(frame, F.col("analysis_number") < 200).collect()}
    assert got[200] > got[201] + 0.5


def test_without_training_or_rows(spark):
    frame = spark.createDataFrame([(0, "ab c"), (None, None)], "analysis_number long, description string")
    got = {r.analysis_number: r for r in ppm.text_scores(frame, F.lit(False)).collect()}
    assert got[0].score == pytest.approx(-5 * math.log10(256)) and got[None].score == pytest.approx(-math.log10(256))
    assert ppm.text_scores(frame.limit(0), F.lit(True)).count() == 0
