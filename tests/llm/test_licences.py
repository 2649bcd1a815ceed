"""Licence notices with foreign words inside, scattered words, a plain aligner, and the query's templates."""

import random
import time

from acremark.llm import licences, queries

MIT = "Released under the MIT License."


def found(text, notice=MIT):
    words, wanted = licences.plain_words(text.encode()), licences.plain_words(notice.encode())
    return licences.best_passages(words, wanted, 0.8)


def test_foreign_words_inside_a_notice():
    assert found("Released under the terms of the open MIT License") == [(0, 9, 5)]
    assert found("a b Released under one two three the MIT License c") == [(2, 10, 5)]
    assert found("Released " + "x " * 40 + "under the MIT License") == [(41, 45, 4)]
    assert found("Released under the MIT License and released under the MIT License") == [(0, 5, 5), (6, 11, 5)]
    assert found("under the road") == []


def test_query_finds_whole_licences_with_small_changes(spark, tmp_path):
    templates = queries.licence_templates()
    texts = []
    for name in sorted(templates):
        words = templates[name].split()
        if len(words) > 30:
            words[5:5] = ["indeed", "so"]
            words[15] = "changed"
        texts.append((name, "before it " + " ".join(words) + " after it"))
    spark.createDataFrame(texts, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.notice): r.coverage for r in queries.op9_licence_notices(spark, str(tmp_path)).collect()}
    assert all(got[name, name] > 0.95 for name in templates)
    assert {n for d, n in got if d == "mit-text"} == {"mit-text"}


def test_scattered_words_are_no_notice():
    story = "all children went home " + "and then " * 200 + "they have rights " + "so they say " * 100 + "the seats are reserved"
    assert found(story, "All rights reserved.") == []
    assert found("released " + "in spring " * 150 + "under " + "a tree " * 200 + "the " + "long road " * 50 + "license") == []
    assert found("all rights are reserved", "All rights reserved.") == [(0, 4, 3)]
    assert found("all of the many rights that there are reserved", "All rights reserved.") == []


def longest_common(one, other):
    row = [0] * (len(other) + 1)
    for a in one:
        last = row
        row = [0]
        for j, b in enumerate(other):
            row.append(last[j] + 1 if a == b else max(row[-1], last[j + 1]))
    return row[-1]


def test_equals_a_plain_aligner_on_whole_texts():
    """A passage holds at most what the longest common subsequence does, and what edits leave of a planted notice is found."""
    rng = random.Random(4)
    notice = "this map is made available under the open database license by its many authors in spring".split()
    filler = ["this", "the", "by", "its", "in", "a", "of", "plot", "road", "hill", "mill", "map"]
    for _ in range(150):
        planted = list(notice)
        for _ in range(rng.randint(0, 2)):
            planted[rng.randrange(len(planted))] = "other"
        for _ in range(rng.randint(0, 4)):
            planted.insert(rng.randrange(len(planted)), rng.choice(["plot", "so", "said"]))
        before = rng.choices(filler, k=rng.randint(0, 60))
        text = before + planted + rng.choices(filler, k=rng.randint(0, 60))
        got = licences.best_passages(text, notice)
        assert got, text
        for first, after, matched in got:
            assert matched >= 0.8 * len(notice) and matched >= 0.5 * (after - first)
            assert matched <= longest_common(text[first:after], notice)
        assert got[0][0] < len(before) + len(planted) and got[0][1] > len(before)
        rest = rng.sample(text, len(text))
        if not any(longest_common(rest[i:i + 2 * len(notice)], notice) >= 0.8 * len(notice) for i in range(len(rest))):
            assert licences.best_passages(rest, notice) == []


def test_dense_part_is_the_longest():
    rng = random.Random(7)
    for _ in range(300):
        places = sorted(rng.sample(range(60), rng.randint(1, 15)))
        want = max(b - a + 1 for a in range(len(places)) for b in range(a, len(places)) if b - a + 1 >= 0.5 * (places[b] - places[a] + 1))
        first, after, count = licences._dense_part(places, 0.5)
        assert count == want and count >= 0.5 * (after - first) and {first, after - 1} <= set(places)


def test_time_grows_with_the_text():
    took = []
    for n in (1000, 8000):
        began = time.time()
        assert len(found("Released under the MIT License. " * n)) == n
        took.append(time.time() - began)
    assert took[1] < 8 * 3 * took[0] + 1
