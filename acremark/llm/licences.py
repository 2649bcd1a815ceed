"""Licence and attribution notices in analysis descriptions by patience alignment.

A notice and a stretch of text are anchored on the words that occur once in both, the longest increasing
run of anchors is kept, and the gaps between them are aligned the same way. Coverage is the share of the
notice's words that are matched, density the share of the passage's words that are matched: a passage must reach
both, so a few foreign words do not hide a notice and words scattered over a text are none. Stretches are
proposed around the notice's words that are rarest in the text, as many of them as could all be missing below the
wanted coverage, plus one, in the text without the words foreign to the notice.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acremark.llm.common import LOWER_BYTES, byte_texts, row_slices

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)


#: Shares of the notice's words, and of the passage's, that must be matched.
COVERAGE, DENSITY = 0.8, 0.5


def plain_words(text: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def align(one: list[bytes], other: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (i, j), increasing in both, of two word lists by patience alignment."""
    out, waiting = [], [(0, len(one), 0, len(other))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and one[a] == other[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(one[a:b]), Counter(other[c:d])
        place = {w: i for i, w in enumerate(other[c:d], c) if right[w] == 1 and left.get(w) == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(one[a:b], a) if w in place])
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            out += anchors
            waiting += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) with increasing seconds."""
    ends, at, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(ends, j)
        ends[pile : pile + 1] = [j]
        at[pile : pile + 1] = [k]
        before.append(at[pile - 1] if pile else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def best_passages(words: list[bytes], notice: list[bytes], least: float = COVERAGE, dense: float = DENSITY) -> list[tuple[int, int, int]]:
    """(first word, word after the last, matched words) of passages that reach both shares, best first and not overlapping.

    The text is read with the words foreign to the notice left out. Each place where the notice may begin there is aligned in a
    stretch of the notice's length, in one of twice and in one of four times that length; of what an alignment matches, the
    longest part that is dense enough in the whole text counts. Time grows with the places where rare words of the
    notice stand, not with their square.
    """
    known, n = Counter(notice), len(notice)
    own = [i for i, w in enumerate(words) if w in known]
    kept = [words[i] for i in own]
    counts = Counter(kept)
    need = least * n - 1e-9
    if not n or sum((counts & known).values()) < need:
        return []
    spare = int((1 - least) * n + 1e-9) + 1
    wanted: dict[bytes, list[int]] = {}
    for j in sorted(range(n), key=lambda j: (counts[notice[j]], j))[:spare]:
        wanted.setdefault(notice[j], []).append(j)
    step = max(1, n // 8)
    starts = sorted({(k - j) // step for k, w in enumerate(kept) if w in wanted for j in wanted[w]})
    found = set()
    for s in starts:
        for wider in (0, n // 2, n + n // 2):
            low, high = max(0, s * step - wider), min(len(kept), (s + 1) * step + n + wider)
            if high - low < need or own[high - 1] - own[low] < need - 1:
                continue
            matched = align(kept[low:high], notice)
            passage = _dense_part([own[low + i] for i, _ in matched], dense)
            if passage[2] >= need:
                found.add(passage)
                if passage[2] == n:
                    break
    out: list[tuple[int, int, int]] = []  # by place, not overlapping
    for passage in sorted(found, key=_better):
        at = bisect.bisect(out, passage)
        if (not at or out[at - 1][1] <= passage[0]) and (at == len(out) or passage[1] <= out[at][0]):
            out.insert(at, passage)
    return sorted(out, key=_better)


def _better(passage: tuple[int, int, int]) -> tuple[int, int, int]:
    """Order of passages: more words matched, shorter, earlier."""
    first, after, matched = passage
    return -matched, after - first, first


def _dense_part(places: list[int], dense: float) -> tuple[int, int, int]:
    """(first, after, count) of the longest run of increasing places of which ``dense`` of all words between are such places."""
    if not places:
        return 0, 0, 0
    # the run from a to b is dense enough if height[b] - height[a] >= dense - 1; the longest one ends at extremes
    height = [k - dense * p for k, p in enumerate(places)]
    lowest = list(itertools.accumulate(height, min))
    highest = list(itertools.accumulate(reversed(height), max))[::-1]
    best, a = (0, 0), 0
    for b in range(len(places)):
        while highest[b] - lowest[a] < dense - 1 - 1e-9:
            a += 1
        if b - a > best[1] - best[0]:
            best = (a, b)
    a, b = best
    return places[a], places[b] + 1, b - a + 1


def _outdone(passage: tuple[int, int, int], others: list[tuple[int, int, int]]) -> bool:
    """Whether another notice matches more words in an overlapping passage; ``others`` are its passages by place."""
    first, after, matched = passage
    at = max(0, bisect.bisect(others, (first,)) - 1)
    while at < len(others) and others[at][0] < after:
        if first < others[at][1] and others[at][2] > matched:
            return True
        at += 1
    return False


def notices(analyses: DataFrame, templates: dict[str, str], analysis_id: str = "analysis_number", text: str = "description",
            least: float = COVERAGE, dense: float = DENSITY) -> DataFrame:
    """One row per description and notice that it holds: id, ``notice``, ``coverage`` and ``density`` of the best passage,
    its ``first_word`` and ``n_words`` in the text, and the number of ``passages``. A passage matches ``least`` of the notice's
    words, and ``dense`` of its own words are matched. Where passages of two notices overlap, the one with more matched
    words counts.

    Null and empty texts hold none; templates without words are never found; repeated rows are reported
    each. An empty table gives no rows.
    """
    worded = {name: plain_words(t.encode()) for name, t in templates.items()}
    kind = analyses.schema[analysis_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {w for t in worded.values() for w in t}
        for batch in batches:
            for piece in row_slices(batch, 1, 16 << 20):
                rows = []
                for row, t in enumerate(byte_texts(piece.column(1))):
                    words = plain_words(t)
                    seen = vocabulary.intersection(words)
                    found = {}
                    for name, notice in worded.items():
                        if notice and len(words) >= least * len(notice) and sum(w in seen for w in notice) >= least * len(notice):
                            if got := best_passages(words, notice, least, dense):
                                found[name] = got
                    placed = {name: sorted(got) for name, got in found.items()}
                    for name, own in found.items():
                        own = [p for p in own if not any(_outdone(p, more) for n, more in placed.items() if n != name)]
                        if own:
                            first, after, matched = own[0]
                            rows.append((row, name, matched / len(worded[name]), matched / (after - first), first, after - first, len(own)))
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                     *[pa.array(c, pa.float64()) for c in columns[2:4]], *[pa.array(c, pa.int64()) for c in columns[4:]]],
                    ["_id", "notice", "coverage", "density", "first_word", "n_words", "passages"])

    out = analyses.select(analysis_id, text).mapInArrow(
        run, f"_id {kind}, notice string, coverage double, density double, first_word bigint, n_words bigint, passages bigint")
    return out.select(F.col("_id").alias(analysis_id), "notice", "coverage", "density", "first_word", "n_words", "passages")
