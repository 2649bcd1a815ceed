"""Collocations of artifact payloads against plain counting of all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from acremark.llm import phrases

ARTIFACT = "artifact_type string, payload_json string, rank string, n string, phrase string"


def brute(rows, least, limit=2000, longest=4):
    counts, total = Counter(), Counter()
    for group, text in rows:
        group = "und" if group is None else group
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[group] += len(words)
            for k in range(1, longest + 1):
                counts.update((group, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if a >= least}
    out = {}
    for (group, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = [(2_000_000 * a // (frequent[group, words[:c]] + frequent[group, words[c:]]), c) for c in range(1, len(words))]
        score, c = min(cuts)
        longer = [b for (g, w), b in frequent.items() if g == group and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= 80 * a for b in longer):
            out.setdefault(group, []).append((-score, -a, " ".join(words).encode(), frequent[group, words[:c]], frequent[group, words[c:]]))
    return sorted((g, i + 1, p.decode(), -a, l, r, total[g], -s) for g, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:limit]))


def table(spark, rows):
    return spark.createDataFrame([(g, t, "a", "b", "c") for g, t in rows], ARTIFACT)


def texts(seed=5, n=250):
    rng = random.Random(seed)
    words = ["plot", "by", "the", "Road", "łąka", "las", "of", "1", "hill", "x y"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((["cells", "parcels", None][i % 3], text + (" plot by the road of the hill" if i % 2 else "")))
    return rows + [("cells", None), ("parcels", ""), (None, " \t "), ("rare", "seen once only"), ("cells", "las " * 3000), ("cells", "las " * 3000)]


@pytest.mark.parametrize("word_ids, phrase_ids", [(1 << 19, 1 << 21), (1 << 19, 5), (6, 1 << 21), (5, 3), (0, 0)])
def test_equals_plain_counting(spark, word_ids, phrase_ids):
    rows = texts()
    got = phrases.collocations(table(spark, rows).repartition(3), least=12, word_ids=word_ids, phrase_ids=phrase_ids)
    assert got.columns == ["artifact_type", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12)


def test_first_of_each_group_and_empty_tables(spark):
    rows = texts(9, 120)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), least=8, limit=3).collect())) == brute(rows, 8, 3)
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [("cells", None), (None, "..")])).count() == 0


def test_crowded_tiles_equal_lists(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = (rng.integers(0, 3000, 200_000) ** 2 // 3000 for _ in range(2))

    def counted():
        tiles = phrases.Tiles()
        for at in range(0, len(left), 50_000):
            tiles.add(left[at:at + 50_000], right[at:at + 50_000])
        got = Counter()
        for cells, counts in tiles.take(True):
            got.update(dict(zip(cells.tolist(), counts.tolist())))
        return got, len(tiles.arrays)

    monkeypatch.setattr(phrases, "_DENSE", 1000)
    dense, _ = counted()
    monkeypatch.setattr(phrases, "_DENSE", 1 << 40)
    sparse, _ = counted()
    assert dense == sparse == Counter((int(a) << 20 | int(b)) for a, b in zip(left, right))


def test_long_texts_are_cut_between_pieces():
    text = b"One two, three. " * 50
    assert b"\n".join(phrases._parts(text, 64)).split(b"\n") == text.translate(phrases._PIECES).split(b"\n")
    assert list(phrases._parts(b"x" * 100, 10)) == [b"x" * 100]


def test_many_phrases_are_not_counted_by_their_words(spark, monkeypatch):
    """However many phrases are frequent, those of words with ids are counted as ids."""
    monkeypatch.setattr(phrases, "open_counts", lambda *a: pytest.fail("counted by words"))
    rows = texts(7, 120)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), least=8, phrase_ids=3).collect())) == brute(rows, 8)


def test_more_words_than_tile_bits_have_ids():
    left, right = np.array([(1 << 20) + 5, 7, (1 << 20) + 5]), np.array([(1 << 21) - 1, 3, (1 << 21) - 1])
    tiles = phrases.Tiles(21)
    tiles.add(left, right)
    (cells, n), = tiles.take(True)
    assert dict(zip(cells.tolist(), n.tolist())) == {7 << 21 | 3: 1, ((1 << 20) + 5) << 21 | (1 << 21) - 1: 2}
    assert phrases.WORD_IDS == 1 << phrases._ID_BITS and phrases._IDS_A_CELL * phrases._ID_BITS < 64


def test_a_sieve_holds_all_that_was_added():
    rng = np.random.default_rng(3)
    cells = [rng.integers(0, 1 << 62, 5000), rng.integers(0, 1 << 21, 5000)]
    sieve = phrases.Sieve(5000)
    sieve.add(cells)
    assert sieve.has(cells).all()
    assert sieve.has([cells[0] + 1, cells[1]]).mean() < 0.2
