"""Log-probability of analysis descriptions by prediction by partial matching.

:func:`text_scores` codes every byte of a text after the bytes before it, blanks included, so that contexts run over whole texts.
As a byte's probability depends on a window of ``order`` + 1 bytes alone, windows are counted and coded once as a table, and
a text adds up its windows. :func:`score` is a variant over words and their bytes:

A description is its lower-cased words, then one end. A word is coded after the word before it where that
pair is kept, or an escape (method C) leads to the word alone, with all kept followers excluded. A word of
the training texts is coded there at once, or a second escape leads to single bytes, with
all known words excluded: their share of the byte model's probability is taken out exactly. The byte trie
is counted over the training words: the context of a byte is what precedes it in the word, a word-start
mark included, at most ``order`` bytes long. A byte that the longest known context has not seen is coded by an escape (method C) and then
in the next shorter context, without the bytes that the longer one could have coded. As byte contexts stay
inside words, a word's code length is worked out once per distinct word, however often it occurs.

Every byte context of the training words counts, and every pair of words that occurs ``LEAST_PAIR`` times, so ten
times the text gives more contexts. The most frequent words and pairs and a trie of up to ``NODES`` nodes are held
in memory where texts are read; all others are joined from tables, with equal results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from acremark.llm.common import byte_texts, byte_words, most_frequent, row_slices, stored

ORDER = 4
#: Bytes before a byte that are its longest context where contexts run over whole texts.
TEXT_ORDER = 5
#: Words and windows of whole texts that are held in memory, at most; tables have the others.
TEXT_WORDS, WINDOWS = 1 << 18, 1 << 20
#: Fixed value: occurrences in the training texts from which a pair of words is a context of its own.
LEAST_PAIR = 8
#: Words, pairs of words and trie nodes that are held in memory, at most; tables have the others.
WORDS, PAIRS, NODES = 1 << 19, 1 << 21, 1 << 21
#: Bits of the marks of words and of pairs that tables have; a mark that is set by chance costs a row, not the result.
_MARKS = 1 << 26
START, END_OF_TEXT, SYMBOLS = 0x20, 0x0A, 256


def token_counts(analyses: DataFrame, training: Column, text: str = "description", held: int = 400_000) -> DataFrame:
    """``token``, ``n_train`` and ``n_all`` over all rows; the empty token is the end of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()
        for batch in batches:
            for piece in row_slices(batch, 0, 16 << 20):
                for t, learn in zip(byte_texts(piece.column(0)), piece.column(1).to_pylist()):
                    into = train if learn else rest
                    into.update(byte_words(t))
                    into[b""] += 1
                if len(train) + len(rest) > held:
                    yield _counted(train, rest)
                    train, rest = Counter(), Counter()
        yield _counted(train, rest)

    flagged = analyses.select(F.col(text), F.coalesce(training, F.lit(False)).alias("_learn"))
    parts = flagged.mapInArrow(run, "token string, n_train bigint, n_all bigint")
    return parts.groupBy("token").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _counted(train: Counter, rest: Counter) -> pa.RecordBatch:
    tokens = [*train, *(t for t in rest if t not in train)]
    n = np.fromiter((train.get(t, 0) for t in tokens), np.int64, len(tokens))
    more = np.fromiter((rest.get(t, 0) for t in tokens), np.int64, len(tokens))
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(n), pa.array(n + more)],
                                      ["token", "n_train", "n_all"])


def _events(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat symbols of the words (start mark first), the word of each, and its place in the word."""
    framed = [b"\x20" + t + b"\x20" if t else b"\x20\x0a" for t in tokens]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), dtype=np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(framed)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat, word, place


def _keys(flat: np.ndarray, order: int) -> np.ndarray:
    """For each position the packed (order, context, symbol); only valid where the place is at least the order."""
    out = flat.copy()
    for k in range(1, order + 1):
        out[k:] |= flat[:-k] << np.uint64(8 * k)
    return out | np.uint64(order) << np.uint64(56)


def _context_counts(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.array([], np.uint64), np.array([], np.int64), []
        for batch in batches:
            flat, word, place = _events(byte_texts(batch.column(0)))
            n = batch.column(1).to_numpy()[word]
            found = [(_keys(flat, k)[at], n[at]) for k in range(order + 1) for at in [np.flatnonzero(place >= max(k, 1))]]
            waiting.append(_summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])))
            if sum(len(k) for k, _ in waiting) > max(2_000_000, len(keys)):
                keys, counts = _summed(np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]]))
                waiting = []
        keys, counts = _summed(np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]]))
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], ["key", "n"])

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


class Trie:
    """Kept nodes (packed keys with counts) and contexts (with totals), and what exclusion leaves of parents."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray, order: int):
        by = np.argsort(keys)
        self.order, self.keys, self.counts = order, keys[by], counts[by].astype(np.float64)
        by = np.argsort(contexts)
        self.contexts, self.totals = contexts[by], totals[by].astype(np.float64)
        own = self.keys >> np.uint64(8)
        at = np.searchsorted(self.contexts, own)
        m = len(self.contexts)
        self.kinds = np.bincount(at, minlength=m).astype(np.float64)
        self.dropped = self.totals - np.bincount(at, self.counts, minlength=m)
        # what each context leaves to its parent once its own symbols are excluded there
        level = (self.contexts >> np.uint64(48)).astype(np.int64)
        shorter = self.contexts & ((np.uint64(1) << (8 * np.maximum(level - 1, 0)).astype(np.uint64)) - np.uint64(1))
        parent = np.where(level > 0, shorter | np.maximum(level - 1, 0).astype(np.uint64) << np.uint64(48), self.contexts)
        self.parent = np.where(level > 0, np.searchsorted(self.contexts, parent), -1)
        seen = np.zeros(m)
        inner = np.flatnonzero(self.parent[at] >= 0)
        node = self.contexts[self.parent[at[inner]]] << np.uint64(8) | self.keys[inner] & np.uint64(255)
        np.add.at(seen, at[inner], self.counts[np.searchsorted(self.keys, node)])
        up = np.maximum(self.parent, 0)
        self.left = np.where(self.parent >= 0, self.totals[up] - seen, 0.0) if m else np.zeros(0)
        self.left_kinds = np.where(self.parent >= 0, self.kinds[up] - self.kinds, 0.0) if m else np.zeros(0)

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """The log10 probability of each word with its end mark; of the end of a text for the empty token."""
        flat, word, place = _events(tokens)
        at = np.flatnonzero(place >= 1)
        bits = np.zeros(len(at))
        context = np.full(len(at), -1)
        for k in range(self.order, -1, -1):  # the longest known context of each symbol
            todo = np.flatnonzero((context < 0) & (place[at] >= k))
            if len(todo) and len(self.contexts):
                wanted = _keys(flat, k)[at[todo]] >> np.uint64(8)
                near = np.minimum(np.searchsorted(self.contexts, wanted), len(self.contexts) - 1)
                context[todo] = np.where(self.contexts[near] == wanted, near, -1)
        return np.bincount(word[at], self._bits(context, flat[at]), minlength=len(tokens))

    def windows_log10(self, windows: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each packed window, whose context are the bytes before it."""
        context = np.full(len(windows), -1)
        for k in range(self.order, -1, -1):
            todo = np.flatnonzero(context < 0)
            if len(todo) and len(self.contexts):
                wanted = _cut(windows[todo], k) >> np.uint64(8)
                near = np.minimum(np.searchsorted(self.contexts, wanted), len(self.contexts) - 1)
                context[todo] = np.where(self.contexts[near] == wanted, near, -1)
        return self._bits(context, windows & np.uint64(255))

    def _bits(self, context: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol from its longest known context (its place, -1: none) down."""
        bits, child, context = np.zeros(len(symbols)), np.full(len(symbols), -1), context.copy()
        todo = np.flatnonzero(context >= 0)
        while len(todo):
            c, from_child = context[todo], child[todo]
            excluded = from_child >= 0
            total = np.where(excluded, self.left[from_child], self.totals[c])
            kinds = np.where(excluded, self.left_kinds[from_child], self.kinds[c])
            whole = np.maximum(total + kinds, 1e-300)
            wanted = self.contexts[c] << np.uint64(8) | symbols[todo]
            near = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[near] == wanted
            bits[todo[hit]] += np.log10(self.counts[near[hit]] / whole[hit])
            miss = ~hit
            escape = np.where(total + kinds > 0, (kinds + self.dropped[c]) / whole, 1.0)
            bits[todo[miss]] += np.log10(np.maximum(escape[miss], 1e-300))
            todo, c = todo[miss], c[miss]
            child[todo], context[todo] = c, self.parent[c]
            last = context[todo] < 0
            bits[todo[last]] -= math.log10(max(1, SYMBOLS - self.kinds[self._root()]))
            todo = todo[~last]
        bits[(context < 0) & (child < 0)] = -math.log10(SYMBOLS)
        return bits

    def _root(self) -> int:
        return int(np.searchsorted(self.contexts, np.uint64(0)))


def train(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The nodes (packed ``key``, ``n``) of the training tokens of :func:`token_counts`, stored."""
    nodes = (counts.where("n_train > 0").select("token", "n_train")
             .mapInArrow(_context_counts(order), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    return stored(nodes, "trie")


def in_memory(nodes: DataFrame, order: int = ORDER) -> Trie:
    """The trie of all nodes."""
    table = nodes.toArrow()
    keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    return Trie(keys, n, contexts, np.bincount(at, n, len(contexts)) if len(keys) else np.zeros(0), order)


def _coded_by_join(each: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """(token, spelled, _found): the log10 probabilities of the places of each token that have a known context, added up, and how many these are.

    ``each`` has a row (token, place, k, key, context) for every order ``k`` of every place.
    """
    context = F.shiftright("key", 8)
    contexts = nodes.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    level = F.shiftright("context", 48).cast("int")
    mask = F.expr(f"element_at(array({', '.join(f'{(1 << 8 * max(k - 1, 0)) - 1}L' for k in range(order + 1))}), cast(shiftright(context, 48) as int) + 1)")
    parent = F.when(level > 0, F.col("context").bitwiseAND(mask).bitwiseOR(F.shiftleft((level - 1).cast("long"), 48)))
    above = nodes.select(F.col("key").alias("_up"), F.col("n").alias("_n"))
    own = nodes.select(context.alias("context"), F.col("key").bitwiseAND(255).alias("symbol")).where(context > (1 << 48) - 1)
    seen = own.withColumn("_up", F.shiftleft(parent, 8).bitwiseOR(F.col("symbol"))).join(above, "_up").groupBy("context").agg(F.sum("_n").alias("seen"))
    up = contexts.select(F.col("context").alias("_parent"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
    known = contexts.withColumn("_parent", parent).join(up, "_parent", "left").join(seen, "context", "left").select(
        "context", "total", "kinds", (F.col("_total") - F.coalesce("seen", F.lit(0))).alias("left"), (F.col("_kinds") - F.col("kinds")).alias("left_kinds"))
    root = contexts.where("context = 0").select("kinds").first()
    last = -math.log10(max(1, SYMBOLS - root.kinds)) if root else -math.log10(SYMBOLS)

    each = each.join(known, "context").join(nodes, "key", "left")
    step = F.struct((-F.col("k")).alias("k"), "total", "kinds", "left", "left_kinds", "n")
    found = each.groupBy("token", "place").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    zero = "named_struct('bits', 0D, 'done', false, 'total', cast(null as bigint), 'kinds', cast(null as bigint))"
    # each order from the longest known context down; what the longer one could code is out of the shorter one's counts
    bits = F.expr(f"""aggregate(steps, {zero}, (s, x) -> if(s.done, s, named_struct(
        'bits', s.bits + if(x.n is not null, log10(x.n / (coalesce(s.total, x.total) + coalesce(s.kinds, x.kinds))),
          if(coalesce(s.total, x.total) + coalesce(s.kinds, x.kinds) > 0,
             log10(greatest(coalesce(s.kinds, x.kinds) / (coalesce(s.total, x.total) + coalesce(s.kinds, x.kinds)), 1e-300D)), 0D)),
        'done', x.n is not null, 'total', x.left, 'kinds', x.left_kinds)), s -> s.bits + if(s.done, 0D, {last!r}D))""")
    return found.groupBy("token").agg(F.sum(bits).alias("spelled"), F.count("*").alias("_found"))


def spelled_by_join(tokens: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """``token`` and ``spelled``, what :meth:`Trie.log10` gives, for any number of nodes: every context of a token is joined."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, 0, 1 << 16):
                flat, word, place = _events(byte_texts(piece.column(0)))
                for k in range(order + 1):
                    at = np.flatnonzero(place >= max(k, 1))
                    key = _keys(flat, k)[at]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(word[at])), pa.array(place[at].astype(np.int32)), pa.array(np.full(len(at), k, np.int32)),
                                                      pa.array(key.view(np.int64)), pa.array((key >> np.uint64(8)).view(np.int64))],
                                                     ["token", "place", "k", "key", "context"])

    each = tokens.select("token").mapInArrow(places, "token string, place int, k int, key bigint, context bigint")
    coded = _coded_by_join(each, nodes, order)
    symbols = F.when(F.col("token") == "", 1).otherwise(F.octet_length("token") + 1)
    return tokens.select("token").join(coded, "token", "left").select(
        "token", (F.coalesce("spelled", F.lit(0.0)) - (symbols - F.coalesce("_found", F.lit(0))) * math.log10(SYMBOLS)).alias("spelled"))


def marks(names: Column, rows: DataFrame) -> np.ndarray:
    """A bit for the XXH64 of each name, in 64-bit words: ``_MARKS`` bits, whatever the rows."""
    placed = rows.select(F.pmod(F.xxhash64(names), F.lit(_MARKS)).alias("_place"))
    table = placed.groupBy(F.expr("cast(floor(_place / 64) AS int)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_place % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(_MARKS // 64, np.int64)
    out[table["at"].to_numpy()] = table["bits"].to_numpy()
    return out


def _marked(name: bytes, bits: np.ndarray) -> bool:
    place = xxh64_intdigest(name, 42) % _MARKS
    return bool(int(bits[place >> 6]) >> (place & 63) & 1)


@dataclass
class Held:
    """The words in memory with their numbers and rates, and the pairs of them (sorted codes: first * words + second) with their gains.

    A ``base`` and ``known`` is added per word, a ``model`` per word and per pair. ``all_words`` tells whether these are all words that
    make pairs, and ``all_coded`` whether all pairs of these words are here. ``marked`` has the :func:`marks` of words that make pairs
    while pairs are counted, and of pairs outside of memory afterwards; None if there are none.
    """

    numbers: dict[bytes, int]
    base: np.ndarray
    known: np.ndarray
    model: np.ndarray
    pairs: np.ndarray
    gains: np.ndarray
    all_words: bool
    all_coded: bool = True
    marked: np.ndarray | None = None

    def numbered(self, tokens: list[bytes]) -> np.ndarray:
        """The number of each word between a text's start and end, -1 for others; both ends are the empty token."""
        framed = [b"", *tokens, b""]
        return np.fromiter(map(self.numbers.get, framed, repeat(-1)), np.int64, len(framed))

    def codes(self, at: np.ndarray) -> np.ndarray:
        """The code of each word and the next, -1 where one has no number."""
        return np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * len(self.numbers) + at[1:], -1)


def held_words(rated: DataFrame, least_pair: int = LEAST_PAIR, words: int = WORDS) -> Held:
    """The ``words`` most frequent words of (token, base, known, model, n_train, n_all) and the text's end; without pairs."""
    found, whole = most_frequent(rated.where("token != ''").withColumn("n", F.col("n_all")), max(words - 1, 0))
    table = found.unionByName(rated.where("token = ''").withColumn("n", F.col("n_all"))).select("token", "base", "known", "model").toArrow()
    order = sorted(range(len(table)), key=(names := table["token"].to_pylist()).__getitem__)
    base, known, model = (table[c].to_numpy()[order].astype(np.float64) for c in ("base", "known", "model"))
    if not whole:
        whole = rated.where(F.col("n_train") >= least_pair).join(found.select("token"), "token", "left_anti").where("token != ''").isEmpty()
    none = np.zeros(0, np.int64)
    return Held({names[i].encode(): k for k, i in enumerate(order)}, base, known, model, none, none.astype(float), whole)


def _pair_counts(held: Held, most: int = 2_000_000):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.array([], np.int64), np.array([], np.int64)
        for batch in batches:
            for piece in row_slices(batch, 0, 16 << 20):
                found = [held.codes(held.numbered(byte_words(t))) for t in byte_texts(piece.column(0))]
                fresh, n = np.unique(np.concatenate(found), return_counts=True)
                keys, counts = _summed(np.concatenate([keys, fresh[fresh >= 0]]), np.concatenate([counts, n[fresh >= 0]]))
                if len(keys) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["code", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["code", "n"])

    return run


def _other_pairs(held: Held, most: int = 400_000):
    """(pair, n) of neighbours of which one has no number, and all such are marked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for piece in row_slices(batch, 0, 16 << 20):
                for t in byte_texts(piece.column(0)):
                    tokens = byte_words(t)
                    at = held.numbered(tokens)
                    for i in np.flatnonzero(at < 0).tolist():  # both ends of a text have numbers
                        at[i] = -1 if _marked(tokens[i - 1], held.marked) else -2
                    open_ = (at[:-1] > -2) & (at[1:] > -2) & ((at[:-1] < 0) | (at[1:] < 0))
                    found.update(_joined(tokens, np.flatnonzero(open_)))
                if len(found) > most:
                    yield _strings(found)
                    found = Counter()
        yield _strings(found)

    return run


def _joined(tokens: list[bytes], at: np.ndarray) -> Iterator[bytes]:
    """Both words of the pairs at these places with a blank between; the text's start and end are empty."""
    framed = [b"", *tokens, b""]
    return (framed[i] + b" " + framed[i + 1] for i in at.tolist())


def _strings(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])


def pair_counts(texts: DataFrame, held: Held, least: int = LEAST_PAIR) -> DataFrame:
    """(pair, code, n) of the neighbours in the one text column that occur ``least`` times, stored; ``code`` is null without numbers."""
    counted = texts.mapInArrow(_pair_counts(held), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = [w.decode() for w in held.numbers]

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = np.divmod(batch["code"].to_numpy(), max(1, len(words)))
            spelled = [f"{words[a]} {words[b]}" for a, b in zip(first.tolist(), second.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), batch["code"], batch["n"]], ["pair", "code", "n"])

    out = counted.mapInArrow(spell, "pair string, code bigint, n bigint")
    if not held.all_words:
        more = texts.mapInArrow(_other_pairs(held), "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        out = out.unionByName(more.withColumn("code", F.lit(None).cast("long")))
    return stored(out, "pairs")


def followers(pairs: DataFrame, rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, escape) of words with kept pairs, (pair, code, n, gain)), both added to log10 probabilities of words alone.

    After a word with kept pairs every word costs the escape; the gain of a kept pair takes that back and codes the
    second word there.
    """
    alone = rated.select(F.col("token").alias("second"), F.col("model").alias("alone"))
    first = rated.select(F.col("token").alias("first"), F.col("n_train").alias("total"))
    each = pairs.withColumn("first", F.substring_index("pair", " ", 1)).withColumn("second", F.substring_index("pair", " ", -1)).join(alone, "second")
    after = each.groupBy("first").agg(F.count("*").alias("kinds"), F.sum("n").alias("kept"), F.sum(F.pow(F.lit(10.0), "alone")).alias("taken")).join(first, "first")
    whole = F.col("total") + F.col("kinds")
    escape = F.log10(F.greatest((whole - F.col("kept")) / whole, F.lit(1e-300))) - F.log10(F.greatest(1.0 - F.col("taken"), F.lit(1e-9)))
    after = stored(after.select("first", escape.alias("escape"), whole.alias("whole")), "escapes")
    gains = each.join(after, "first").select("pair", "code", "n", (F.log10(F.col("n") / F.col("whole")) - F.col("alone") - F.col("escape")).alias("gain"))
    return after.select(F.col("first").alias("token"), "escape"), stored(gains, "gains")


def score(analyses: DataFrame, training: Column, analysis_id: str = "analysis_number", text: str = "description",
          order: int = ORDER, least_pair: int = LEAST_PAIR, words: int = WORDS, pairs: int = PAIRS, nodes: int = NODES) -> DataFrame:
    """One row per row of ``analyses``: its id, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score`` (the model), both log10.

    Learns from the rows where ``training`` holds. Null texts count as empty and have their end only.
    Without training rows every symbol is equally likely. Repeated rows are scored each; ids may be null. ``words``, ``pairs``
    and ``nodes`` bound what is held in memory and do not change the result.
    """
    counts = stored(token_counts(analyses, training, text), "tokens")
    n, v, everything = counts.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    trie = train(counts, order)
    if trie.count() <= nodes:
        held = in_memory(trie, order)

        def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.log10(byte_texts(batch.column(0))))], [*batch.schema.names, "spelled"])

        rated = counts.select("token", "n_train", "n_all").mapInArrow(spell, "token string, n_train bigint, n_all bigint, spelled double")
    else:
        rated = counts.join(spelled_by_join(counts, trie, order), "token")
    rated = stored(rated.select("token", F.log10(F.col("n_train") + 1.0).alias("base"), (F.col("n_train") > 0).cast("long").alias("known"), "spelled", "n_train", "n_all"), "rated")
    taken = rated.where("known = 1").agg(F.sum(F.pow(F.lit(10.0), "spelled"))).first()[0] or 0.0
    escape = math.log10(v / (n + v) / max(1e-9, 1.0 - taken)) if n else 0.0
    rated = rated.withColumn("model", F.when(F.col("known") == 1, F.log10(F.col("n_train") / F.lit(float(n + v))))
                             .otherwise(F.lit(escape) + F.col("spelled")))
    held = held_words(rated, least_pair, words)
    if not held.all_words:
        held = replace(held, marked=marks(F.col("token"), rated.where(F.col("n_train") >= least_pair)))
    kept = pair_counts(analyses.where(F.coalesce(training, F.lit(False))).select(text), held, least_pair)
    escapes, gains = followers(kept, rated)
    # every word is followed once, and every text has one start and one end, both the empty token
    rated = rated.join(escapes, "token", "left").withColumn("model", F.col("model") + F.coalesce("escape", F.lit(0.0)))
    held = held_words(rated, least_pair, words)
    near, whole = most_frequent(gains.where("code is not null"), pairs)
    far = gains.where("code is null") if whole else gains.join(near.select("pair"), "pair", "left_anti")
    table = near.select("code", "gain").toArrow()
    by = np.argsort(table["code"].to_numpy())
    held = replace(held, pairs=table["code"].to_numpy()[by], gains=table["gain"].to_numpy()[by], all_coded=whole,
                   marked=None if whole and held.all_words else marks(F.col("pair"), far))
    kind = analyses.schema[analysis_id].dataType.simpleString()
    spread = analyses.select(F.col(analysis_id).alias("_id"), text, F.monotonically_increasing_id().alias("_row")).mapInArrow(
        _spread(held), f"_row bigint, token string, n bigint, _id {kind}, n_tokens bigint, base double, known bigint, model double")
    more = rated.select("token", F.col("base").alias("b"), F.col("known").alias("k"), F.col("model").alias("m"))
    if held.marked is not None:
        more = more.unionByName(far.select(F.col("pair").alias("token"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), F.col("gain").alias("m")))
    return _added_up(spread, more, analysis_id, n, v)


def _added_up(spread: DataFrame, more: DataFrame, analysis_id: str, n: int, v: int) -> DataFrame:
    """The sums per text, with the rates of tokens outside of memory from ``more``."""
    joined = spread.join(more.hint("shuffle_hash"), "token", "left")

    def added(own: str, rate: str) -> Column:
        return F.sum(F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col("n") * F.col(rate), F.lit(0)))

    out = joined.groupBy("_row").agg(
        F.max("_id").alias(analysis_id), F.max("n_tokens").alias("n_tokens"), added("known", "k").cast("long").alias("n_known"),
        added("base", "b").alias("_base"), added("model", "m").alias("score"))
    per_token = math.log10(n + v + 1)
    return out.select(analysis_id, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("_base") - F.col("n_tokens") * per_token).alias("base_score"), "score")


def _spread(held: Held):
    """A row per text with the sums of its words and pairs in memory, and one per other token of it, or other pair, with its count.

    The first kind has a token that no text can have, one per row, so that it meets nothing in the join. Of the other pairs only
    marked ones are given.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, 1, 8 << 20):
                rare_rows, rare, times, sums = [], [], [], []
                for row, t in zip(piece.column(2).to_pylist(), byte_texts(piece.column(1))):
                    tokens = byte_words(t)
                    at = held.numbered(tokens)
                    codes, own = held.codes(at), at[1:][at[1:] >= 0]
                    near = np.minimum(np.searchsorted(held.pairs, codes), len(held.pairs) - 1)
                    hit = held.pairs[near] == codes if len(held.pairs) else np.zeros(len(codes), bool)
                    others = Counter(tokens[i] for i in np.flatnonzero(at[1:-1] < 0).tolist())
                    if held.marked is not None:
                        open_ = codes < 0 if held.all_coded else ~hit
                        others.update(p for p in _joined(tokens, np.flatnonzero(open_)) if _marked(p, held.marked))
                    rare_rows += [row] * len(others)
                    rare += others
                    times += others.values()
                    sums.append((f"\n{row}", len(tokens) + 1, held.base[own].sum(), int(held.known[own].sum()),
                                 held.model[own].sum() + held.gains[near[hit]].sum()))
                none = piece.num_rows
                more = len(rare)
                columns = list(zip(*sums))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([piece.column(2), pa.array(rare_rows, pa.int64())]),
                     pa.concat_arrays([pa.array(columns[0], pa.string()), pa.array(rare, pa.binary()).cast(pa.string())]),
                     pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(times, pa.int64())]),
                     pa.concat_arrays([piece.column(0), pa.nulls(more, piece.column(0).type)]),
                     *[pa.concat_arrays([pa.array(c, k), pa.nulls(more, k)])
                       for c, k in zip(columns[1:], (pa.int64(), pa.float64(), pa.int64(), pa.float64()))]],
                    ["_row", "token", "n", "_id", "n_tokens", "base", "known", "model"])

    return run


# --- Byte contexts over whole texts -------------------------------------------------------------


def _cut(windows: np.ndarray, k: int) -> np.ndarray:
    """The packed (order, context, symbol) of order ``k`` at the end of each window."""
    return windows & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(k << 56)


def _windows(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed window (``order`` bytes and the next) of every byte of the texts and of their ends, and where each text's begin.

    A text is its words with one blank between, after ``order`` blanks, which no other place can have before it, and one end.
    """
    lead = b"\x20" * order
    framed = [lead + b"\x20".join(words) + b"\x0a" for words in texts]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    out = flat.copy()
    for k in range(1, order + 1):
        out[k:] |= flat[:-k] << np.uint64(8 * k)
    starts = np.cumsum(sizes) - sizes
    led = np.zeros(len(flat), bool)
    led[(starts[:, None] + np.arange(order)).ravel()] = True
    return out[~led], starts - order * np.arange(len(framed))


def window_counts(analyses: DataFrame, training: Column, text: str = "description", order: int = TEXT_ORDER, most: int = 1_000_000) -> DataFrame:
    """``key`` (a window), ``n_train`` and ``n_all`` over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: (np.zeros(0, np.uint64), np.zeros(0, np.int64)), False: (np.zeros(0, np.uint64), np.zeros(0, np.int64))}

        def given() -> Iterator[pa.RecordBatch]:
            for learn, (keys, n) in held.items():
                for at in range(0, len(keys), 100_000):
                    own = pa.array(n[at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), own if learn else pa.array(np.zeros(len(own), np.int64)), own],
                                                     ["key", "n_train", "n_all"])

        for batch in batches:
            for piece in row_slices(batch, 0, 4 << 20):
                texts, learns = byte_texts(piece.column(0)), piece.column(1).to_pylist()
                for learn, (keys, n) in held.items():
                    chosen = [byte_words(t) for t, own in zip(texts, learns) if own == learn]
                    if chosen:
                        fresh, times = np.unique(_windows(chosen, order)[0], return_counts=True)
                        held[learn] = _summed(np.concatenate([keys, fresh]), np.concatenate([n, times]))
                if sum(len(keys) for keys, _ in held.values()) > most:
                    yield from given()
                    held = {learn: (keys[:0], n[:0]) for learn, (keys, n) in held.items()}
        yield from given()

    flagged = analyses.select(F.col(text), F.coalesce(training, F.lit(False)).alias("_learn"))
    parts = flagged.mapInArrow(run, "key bigint, n_train bigint, n_all bigint")
    return parts.groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _orders(windows: DataFrame, order: int, *others: str) -> DataFrame:
    """``others``, ``k`` and the packed ``key`` of every order at the end of each window."""
    each = F.expr(f"""explode(transform(sequence(0, {order}), k -> named_struct('k', k,
        'key', (key & element_at(array({', '.join(f'{(1 << 8 * (k + 1)) - 1}L' for k in range(order + 1))}), k + 1)) | shiftleft(cast(k as bigint), 56))))""")
    return windows.select(*others, each.alias("_o")).select(*others, "_o.k", "_o.key")


def coded_windows(counts: DataFrame, order: int = TEXT_ORDER, nodes: int = WINDOWS) -> DataFrame:
    """``key``, ``n_all`` and ``bits`` of the windows of :func:`window_counts`: the log10 probability of the last byte after the others.

    The byte is coded in the longest context that occurs in training, or an escape (method C) leads to the next shorter one
    without the bytes that the longer one has. A trie of more than ``nodes`` nodes is joined from its table.
    """
    trie = stored(_orders(counts.where("n_train > 0"), order, "n_train").groupBy("key").agg(F.sum("n_train").alias("n")), "contexts")
    if trie.count() <= nodes:
        held = in_memory(trie, order)

        def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.windows_log10(batch.column(0).to_numpy().view(np.uint64)))], ["key", "n_all", "bits"])

        return counts.select("key", "n_all").mapInArrow(code, "key bigint, n_all bigint, bits double")
    each = _orders(counts.withColumn("token", F.col("key")), order, "token").select(
        "token", F.lit(0).alias("place"), "k", "key", F.shiftright("key", 8).alias("context"))
    coded = _coded_by_join(each, trie, order).select(F.col("token").alias("key"), "spelled")
    return counts.select("key", "n_all").join(coded, "key", "left").select("key", "n_all", F.coalesce("spelled", F.lit(-math.log10(SYMBOLS))).alias("bits"))


class _Looked:
    """Bits of windows by a table of places with one entry each; the few that share a place are searched."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        """``keys`` with the most frequent last, which get the places."""
        self.keys, self.bits, self.table = keys, bits, None

    def _build(self) -> None:
        """Made by the task that looks up first, so that only keys and bits are sent."""
        keys = self.keys
        self.shift = np.uint64(64 - max(2, int(4 * len(keys)).bit_length()))
        self.table = np.full(1 << 64 - int(self.shift), len(keys), np.int32)
        place = self._place(keys)
        self.table[place] = np.arange(len(keys))
        other = np.flatnonzero(self.table[place] != np.arange(len(keys)))
        self.other = other[np.argsort(keys[other])]
        self.other_keys = keys[self.other]
        self.keys, self.bits = np.append(keys, np.uint64(0)), np.append(self.bits, 0.0)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each window, 0 for those that are not here, and the places of the latter."""
        if self.table is None:
            self._build()
        at = self.table[self._place(windows)]
        out = self.bits[at]
        miss = np.flatnonzero((self.keys[at] != windows) | (at == len(self.keys) - 1))
        out[miss] = 0.0
        if len(miss) and len(self.other):
            near = np.minimum(np.searchsorted(self.other_keys, windows[miss]), len(self.other) - 1)
            hit = self.other_keys[near] == windows[miss]
            out[miss[hit]] = self.bits[self.other[near[hit]]]
            miss = miss[~hit]
        return out, miss


def text_scores(analyses: DataFrame, training: Column, analysis_id: str = "analysis_number", text: str = "description",
                order: int = TEXT_ORDER, words: int = TEXT_WORDS, windows: int = WINDOWS, nodes: int = WINDOWS) -> DataFrame:
    """The columns of :func:`score`, by contexts of up to ``order`` bytes that run over the whole text, blanks included.

    Every byte of a text and its end, known words too, is coded by partial matching: in the longest context that training has,
    after escapes (method C) in shorter ones with exclusion, at last evenly among the bytes that training has not. All windows of ``order`` + 1 bytes are counted and coded
    once as a table; a text's score adds up those of its windows. ``words``, ``windows`` and ``nodes`` bound what is held in memory
    and do not change the result. Null texts have their end only; repeated rows are scored each; ids may be null.
    """
    counts = stored(token_counts(analyses, training, text), "tokens")
    n, v = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    rated = counts.select("token", F.log10(F.col("n_train") + 1.0).alias("base"), (F.col("n_train") > 0).cast("long").alias("known"), F.lit(0.0).alias("model"), "n_train", "n_all")
    coded = stored(coded_windows(stored(window_counts(analyses, training, text, order), "windows"), order, nodes), "coded")
    near, whole = most_frequent(coded.withColumnRenamed("n_all", "n"), windows)
    table = near.toArrow()
    by = np.argsort(table["n"].to_numpy(), kind="stable")
    looked = _Looked(table["key"].to_numpy()[by].view(np.uint64), table["bits"].to_numpy()[by])
    del table, by
    held = held_words(rated, 1, words)
    kind = analyses.schema[analysis_id].dataType.simpleString()
    spread = analyses.select(F.col(analysis_id).alias("_id"), text, F.monotonically_increasing_id().alias("_row")).mapInArrow(
        _text_sums(held, looked, order), f"_row bigint, token string, n bigint, _id {kind}, n_tokens bigint, base double, known bigint, model double")
    more = rated.select("token", F.col("base").alias("b"), F.col("known").alias("k"), F.col("model").alias("m"))
    if not whole:
        far = coded.join(near.select("key"), "key", "left_anti")
        more = more.unionByName(far.select(F.concat(F.lit("\t"), F.col("key").cast("string")).alias("token"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), F.col("bits").alias("m")))
    return _added_up(spread, more, analysis_id, n, v)


def _text_sums(held: Held, looked: _Looked, order: int):
    """A row per text with the sums of its words and windows in memory, and one per other word or window of it with its count.

    The tokens of the first kind and of windows begin with a blank, so that no word can be equal.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, 1, 1 << 20):
                texts = [byte_words(t) for t in byte_texts(piece.column(1))]
                rows = piece.column(2).to_numpy()
                keys, starts = _windows(texts, order)
                bits, miss = looked(keys)
                model = np.add.reduceat(bits, starts)
                rare_rows, rare, times, sums = [], [], [], []
                for row, tokens in zip(rows.tolist(), texts):
                    at = held.numbered(tokens)[1:]
                    others = Counter(tokens[i] for i in np.flatnonzero(at < 0).tolist())
                    rare_rows += [row] * len(others)
                    rare += others
                    times += others.values()
                    own = at[at >= 0]
                    sums.append((held.base[own].sum(), int(held.known[own].sum())))
                if len(miss):
                    at = np.searchsorted(starts, miss, "right") - 1
                    for (i, key), times_ in Counter(zip(at.tolist(), keys[miss].tolist())).items():
                        rare_rows.append(int(rows[i]))
                        rare.append(b"\t%d" % key)
                        times.append(times_)
                none, more = piece.num_rows, len(rare)
                base, known = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([piece.column(2), pa.array(rare_rows, pa.int64())]),
                     pa.concat_arrays([pa.array([f"\n{row}" for row in rows.tolist()], pa.string()), pa.array(rare, pa.binary()).cast(pa.string())]),
                     pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(times, pa.int64())]),
                     pa.concat_arrays([piece.column(0), pa.nulls(more, piece.column(0).type)]),
                     *[pa.concat_arrays([pa.array(c, k), pa.nulls(more, k)])
                       for c, k in (([len(t) + 1 for t in texts], pa.int64()), (base, pa.float64()), (known, pa.int64()), (model, pa.float64()))]],
                    ["_row", "token", "n", "_id", "n_tokens", "base", "known", "model"])

    return run
