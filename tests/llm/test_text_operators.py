"""The text operators against plain loops on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from acremark.llm import decontaminate, imatch, language, licences, mixing, ppm, quality, sharding, simhash, toxicity
from acremark.llm.common import byte_words, stored, words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLOTS = "meadow by the stream with a gentle slope and an old orchard near the road to the mill".split()


def texts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    out = [" ".join(rng.choice(PLOTS, rng.integers(5, 40))) for _ in range(n)]
    return [*out, None, "", "  \n ", "Łąka ÉTÉ", out[0], out[0], out[1] + " mill", "long " * 30_000]


def analyses(spark, values, extra=False):
    rows = [(i, t) for i, t in enumerate(values)]
    frame = spark.createDataFrame(rows, "analysis_number long, description string")
    return frame.withColumns({"score": F.lit("own"), "shard": F.lit("own"), "n_tokens": F.lit("own")}) if extra else frame


def artifacts(frame):
    return frame.withColumnsRenamed({"analysis_number": "artifact_id", "description": "payload_json"})


def test_words_lower_only_ascii_letters(spark):
    values = texts()
    got = [r.w for r in analyses(spark, values).select(words(F.col("description")).alias("w")).collect()]
    assert got == [BLANK.findall((t or "").translate(A_TO_Z)) for t in values]
    assert [w.decode() for w in byte_words("Łąka ÉTÉ\x0b Dom".encode())] == ["Łąka", "ÉtÉ", "dom"]


def test_imatch_equals_a_plain_loop(spark):
    values = texts()
    frame = analyses(spark, values, extra=True)
    terms = imatch.lexicon(frame, min_idf=0.5, max_idf=3.0)
    got = {r.analysis_number: r for r in imatch.fingerprints(frame, terms, ["analysis_number"], {"description": "print"}).collect()}
    sets = [set(BLANK.findall((t or "").translate(A_TO_Z))) for t in values]
    df = Counter(w for s in sets for w in s)
    lexicon = {w for w, n in df.items() if 0.5 <= math.log(len(values) / n) <= 3.0}

    def head(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)

    def code(w):
        bits = sum(1 << (r * 8 + s) for s in range(8) for r in range(4) if head(f"{s}:{w}") < 1 << (30 - 2 * r))
        return (head(w) >> 1 << 32) + bits

    def digest(items):
        return hashlib.md5(" ".join(map(str, items)).encode()).hexdigest()[:8]

    for i, s in enumerate(sets):
        own = sorted(code(w) for w in s & lexicon)
        parts = [[c for c in own if c >> b & 1] for b in range(32)]
        want = [digest(own) if own else digest(sorted(s)), *[digest(p) if p else "" for p in parts]]
        assert got[i].print == "-".join(want)
        assert got[i].score == "own"
    assert got[0].print == got[64].print
    like = spark.createDataFrame([(got[0].print, got[64].print, got[3].print)], "a string, b string, c string")
    same, other = like.select(imatch.likeness(F.col("a"), F.col("b")), imatch.likeness(F.col("a"), F.col("c"))).first()
    assert same == 1.0 and 0 <= other < 1


def test_next_of_each_row_across_blocks(spark):
    ids = [5, 900, 901, 70_000, -3, 2_000_000, 5, None]
    frame = spark.createDataFrame([(i, f"t{k}" if k != 2 else None) for k, i in enumerate(ids)], "analysis_number long, description string")
    inner, ends = imatch.beside_next(frame, block=4)
    rows = inner.unionByName(ends).collect()
    placed = {(r._block, r._place): r for r in rows}
    assert len(placed) == len(ids)
    for r in rows:
        assert (placed[r._next_block, r._next_place].description or "") == r._next_text
    order = sorted((i for i in ids if i is not None), reverse=True)
    after = {r.analysis_number: placed[r._next_block, r._next_place].analysis_number for r in rows if r.analysis_number not in (5, None)}
    assert all(after[a] == b for a, b in zip(order, order[1:]) if a != 5)
    alone = frame.where("analysis_number = 900")
    inner, ends = imatch.beside_next(alone)
    assert inner.unionByName(ends).first()._next_text == "t1"
    inner, ends = imatch.beside_next(frame.limit(0))
    assert inner.unionByName(ends).count() == 0


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    values = ["same text of a hot group " * 4] * 700 + [f"plot {i} " + "x" * (i % 90) for i in range(1300)] + [None, "", "y" * 3000]
    frame = artifacts(analyses(spark, values, extra=True)).repartition(5)
    rows = sharding.shard(frame, 8).collect()
    assert len(rows) == len(values)
    size = Counter()
    for r in rows:
        size[r.shard] += len((r.payload_json or "").encode()) + 1
    assert max(size.values()) < 1.05 * sum(size.values()) / 8 and len(size) == 8
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = {(r.artifact_id, r.shard, r.slot) for r in sharding.shard(frame.repartition(3), 8).collect()}
    assert again == {(r.artifact_id, r.shard, r.slot) for r in rows}
    assert sharding.shard(frame.limit(0), 8).count() == 0
    one = sharding.shard(frame.where("artifact_id = 1").unionByName(frame.where("artifact_id = 1")), 8).collect()
    assert sorted(r.slot for r in one) in ([0, 1], [0, 0])


def plain_simhash(text):
    found = BLANK.findall((text or "").translate(A_TO_Z))
    runs = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    ones = [sum(xxhash.xxh64_intdigest(r.encode(), seed=42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def test_simhash_components_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    values = texts(40)[:-1]
    base = [f"w{k}" for k in rng.integers(0, 500, 400)]
    for _ in range(60):  # a dense group of near copies
        changed = list(base)
        changed[int(rng.integers(0, 400))] = f"v{rng.integers(0, 9999)}"
        values.append(" ".join(changed))
    got = {r.artifact_id: r for r in simhash.near_duplicates(artifacts(analyses(spark, values, extra=True))).collect()}
    prints = [plain_simhash(t) for t in values]
    assert [got[i].fingerprint for i in range(len(values))] == [f"{p:016x}" for p in prints]
    root = list(range(len(values)))
    for _ in values:
        for i, p in enumerate(prints):
            root[i] = min(root[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
    assert [got[i].component_id for i in range(len(values))] == root
    assert simhash.near_duplicates(artifacts(analyses(spark, values)).limit(0)).count() == 0


def test_links_in_parts_connect_the_same(spark):
    rng = np.random.default_rng(9)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 50)}
    for p in list(prints)[:10]:
        prints |= {int(np.int64(np.uint64(p & (2**64 - 1)) ^ np.uint64(1 << int(b)))) for b in rng.integers(0, 64, 6)}
    frame = spark.createDataFrame([(p,) for p in prints], "simhash long")

    def groups(part):
        return {(r.node, r.root) for r in simhash.components(simhash.links(frame, part=part)).collect()}

    assert groups(3) == groups(50_000) != set()
    with pytest.raises(ValueError):
        simhash.links(frame, threshold=4)


def test_anchors_cover_pairs_up_to_one_bit():
    halves = np.random.default_rng(1).integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    for bit in range(32):
        for h in halves[:40]:
            pair = np.array([h, h ^ np.uint32(1 << bit)], dtype=np.uint32)
            met = [set(), set()]
            for rows, anchors in simhash._near_anchors(pair):
                for r, a in zip(rows, anchors):
                    met[r].add(int(a))
            assert met[0] & met[1] and max(map(len, met)) <= 18


def plain_passages(text, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_TO_Z))

    found, hit, names = split(text), set(), set()
    for name, t in items:
        w = split(t)
        n = min(len(w), 13)
        for s in range(len(w) - n + 1) if w else ():
            for i in range(len(found) - n + 1):
                if found[i : i + n] == w[s : s + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(found), len(hit), sorted(names)


def test_passages_equal_a_plain_search(spark):
    rng = np.random.default_rng(2)
    items = [(k, " ".join(rng.choice(PLOTS, n))) for k, n in ((1, 20), (2, 13), (10, 4), (11, 1), (12, 30))] + [(13, None), (14, "-- !"), (15, None)]
    values = [" ".join([*rng.choice(PLOTS, 8), items[k % 5][1].upper(), *rng.choice(PLOTS, 9)]) for k in range(25)]
    values += [None, "", items[0][1] + " " + items[0][1], "orchard", "ÉTÉ łąka", values[0]]
    found = decontaminate.passages(analyses(spark, values, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.analysis_number: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    assert got == {i: plain_passages(t, items) for i, t in enumerate(values)}
    none = decontaminate.passages(analyses(spark, values), spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in none.collect()} == {0} and none.count() == len(values)
    assert decontaminate.passages(analyses(spark, values).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_models_learn_held_out_rows(spark):
    rng = np.random.default_rng(4)
    insults = ["blockhead", "nincompoop", "oaf", "lowlife"]
    values, bad, good = [], [], []
    for k in range(400):
        found = [f"{a}{b}" for a, b in zip(rng.choice(PLOTS, 60), rng.choice(PLOTS, 60))]
        if k % 5 == 0:
            found[10] = str(rng.choice(insults)) + str(rng.choice(["", "s", "ish"]))
        if k % 7 == 0:
            found = [w.upper() + "!!" for w in found] if k % 2 else [w + " |" for w in found]
        values.append(" ".join(found))
        bad.append(int(k % 5 == 0))
        good.append(int(k % 7 != 0))
    values += [None, ""]
    frame = analyses(spark, values, extra=True)
    rows = [(i, b, g) for i, (b, g) in enumerate(zip(bad, good))] + [(3, 1, 1), (None, 1, 0), (9, None, None)]
    labels = spark.createDataFrame(rows, "analysis_number long, offensive int, usable int")
    learn = F.col("analysis_number") % 4 != 2
    machine = toxicity.train(frame, labels, learn)
    scores = {r.analysis_number: r.score for r in toxicity.score(frame, machine).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert np.mean([(scores[i] >= 0.3) == bool(bad[i]) for i in held]) > 0.9
    assert scores[400] == scores[401] and 0 <= scores[400] <= 1
    space = quality.train(frame, labels, learn)
    votes = {r.analysis_number: r.score for r in quality.score(frame, space).collect()}
    assert np.mean([(votes[i] >= 0.7) == bool(good[i]) for i in held]) > 0.95
    assert all(0 <= v <= 1 for v in votes.values()) and votes[400] == votes[401]
    untaught = toxicity.train(frame, labels.limit(0), learn)
    assert {0 <= r.score <= 1 for r in toxicity.score(frame, untaught).collect()} == {True}
    assert quality.score(frame.limit(0), quality.train(frame, labels.limit(0), learn)).count() == 0
    assert {r.score for r in quality.score(frame, quality.train(frame, labels.limit(0), learn)).collect()} == {0.5}


def test_exact_neighbours(spark):
    space = quality.fit([t.encode() for t in ["a b c d e f", "A!! B!! C!! D!!", "x | y | z | w", "meadow and mill by road"] * 4], np.array([1, 0, 0, 1] * 4))
    placed = space.place([b"Q!! R!! S!!", b"oak and elm by river"])
    votes = space.vote([b"Q!! R!! S!!", b"oak and elm by river"], neighbours=3)
    for v, p in zip(votes, placed):
        cosine = space.vectors @ p
        near = np.argsort(-cosine, kind="stable")[:3]
        weight = np.maximum(cosine[near], 1e-6) ** 8
        assert abs(v - (weight * space.labels[near]).sum() / weight.sum()) < 1e-5


def test_machine_adds_pairs_of_words():
    model = toxicity.Machine(-1.0, np.array([3, 8]), np.array([0.5, 0.25]), np.array([[1.0, 2.0], [0.5, 1.0]]))
    assert model.score(np.array([3, 8, 99])) == pytest.approx(1 / (1 + math.exp(-(-1 + 0.75 + 2.5))))
    assert model.score(np.array([], np.int64)) == pytest.approx(1 / (1 + math.exp(1)))


def test_languages(spark):
    rng = np.random.default_rng(6)
    stems = {"pl": ["łąka", "droga", "działka", "przy", "rzeka"], "de": ["wiese", "straße", "fluss", "grundstück", "und"]}
    rows = [(i, " ".join(rng.choice(stems[lang], 12)), lang) for i, lang in enumerate(["pl", "de"] * 40)]
    rows += [(80, None, "pl"), (81, "12 ?!", "de"), (82, "Łąka przy rzeka", None), (None, "wiese", "de")]
    frame = spark.createDataFrame(rows, "osm_id long, description string, language string").withColumn("score", F.lit("own"))
    found = language.train(frame, F.col("osm_id") % 5 != 0)
    got = {r.osm_id: r for r in language.recognise(frame, found).collect()}
    assert all(got[i].language_pred == lang for i, _, lang in rows[:80])
    assert got[80].language_pred == got[81].language_pred == "und" and got[82].language_pred == "pl"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language.train(frame.limit(0), F.lit(True))
    assert {r.language_pred for r in language.recognise(frame, none).collect()} == {"und"}
    a, b = language.runs("abc"), language.runs("abd")
    kernel = sum(len(set(x) & set(y)) / math.sqrt(len(x) * len(y)) for x, y in zip(a, b)) / 3
    rows = language.Runs.of([a, b]).presence([a, b])
    assert rows[0] @ rows[1] == pytest.approx(kernel, rel=1e-5)


def test_patience_alignment_and_notices(spark):
    assert licences.align(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]
    assert licences.align(list("aXbYc"), list("aPbQc")) == [(0, 0), (2, 1 + 1), (4, 4)]
    templates = {"odbl": "this map is made available under the open database license", "cc": "licensed under cc by 4 0", "none": "?"}
    odbl = templates["odbl"]
    values = ["before " * 30 + odbl.upper() + " after", odbl.replace("map", "survey map").replace("the", "an"), f"{odbl}. {odbl}",
              "open database", None, "", "licensed under cc by nc 4 0", " ".join(reversed(odbl.split()))]
    got = licences.notices(analyses(spark, values, extra=True), templates).collect()
    found = {(r.analysis_number, r.notice): (r.coverage, r.first_word, r.n_words, r.passages) for r in got}
    assert found[0, "odbl"] == (1.0, 30, 10, 1)
    assert found[1, "odbl"][0] == pytest.approx(0.9)
    assert found[2, "odbl"][3] == 2
    assert set(found) == {(0, "odbl"), (1, "odbl"), (2, "odbl"), (6, "cc")}
    assert licences.notices(analyses(spark, values).limit(0), templates).count() == 0


def plain_mix(rows, share, weights, epochs, seed):
    """The tree by recursion, the epochs by loops."""
    total = Counter()
    for r in rows:
        total[r[1:4]] += r[4]

    def fill(budget, children):  # {name: (capacity, weight)} -> budgets, by raising the level
        left, out, level = dict(children), {}, budget
        while left:
            level = level_of(budget - sum(out.values()), left)
            full = [c for c, (cap, w) in left.items() if cap <= level * w]
            if not full:
                return out | {c: level * w for c, (_, w) in left.items()}
            for c in full:
                out[c] = left.pop(c)[0]
        return out

    def level_of(budget, left):
        return budget / sum(w for _, w in left.values())

    budgets = {(): math.floor(sum(total.values()) * share + 1e-6)}
    for depth in range(3):
        deeper = {}
        for path, b in budgets.items():
            names = {leaf[depth] for leaf in total if leaf[:depth] == path}
            caps = {n: (sum(t for leaf, t in total.items() if leaf[: depth + 1] == (*path, n)) * epochs, weights.get(n, 1.0)) for n in names}
            deeper |= {(*path, n): x for n, x in fill(b, caps).items()}
        budgets = deeper
    out = {}
    for leaf, t in total.items():
        budget = math.floor(budgets[leaf] + 1e-6)
        full = budget // t if t else 0
        rest, upto = budget - full * t, 0
        for r in sorted((r for r in rows if r[1:4] == leaf), key=lambda r: (hashlib.md5(f"{seed}:{full}:{r[0]}".encode()).hexdigest(), r[0])):
            upto += r[4]
            out[r[0]] = min(full, epochs) + (upto <= rest and full < epochs)
    return {k: int(v) for k, v in out.items() if v}


def test_mixture_equals_recursion(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"p{rng.integers(0, 2)}", str(rng.choice(["en", "pl"])), "big" if i % 3 == 0 else f"k{rng.integers(0, 4)}",
             int(rng.integers(0, 30))) for i in range(300)]
    given = [(i, a, b, c, " ".join(["w"] * n) if n else None) for i, a, b, c, n in rows]
    frame = spark.createDataFrame(given, "artifact_id long, producer_skill string, artifact_type string, artifact_key string, payload_json string")
    for share, epochs in ((0.5, 2), (1.4, 2), (3.0, 2), (0.3, 1)):
        chosen = mixing.mix(frame.withColumn("copies", F.lit("own")), share, {"artifact_type": {"en": 3.0}}, epochs=epochs)
        got = {r.artifact_id: r.copies for r in chosen.collect()}
        assert got == plain_mix(rows, share, {"en": 3.0}, epochs, 17)
    assert mixing.mix(frame.limit(0), 0.5, {}).count() == 0
    nulls = frame.withColumn("artifact_key", F.lit(None).cast("string"))
    assert mixing.mix(nulls, 1.0, {}, epochs=1).count() > 250


def plain_trie(counts, order, token):
    """Method C with exclusion, by definition."""
    nodes = Counter()
    for t, n in counts.items():
        s = b"\x20" + t + b"\x20" if t else b"\x20\x0a"
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                nodes[s[i - k : i], s[i]] += n
    s, out = b"\x20" + token + b"\x20" if token else b"\x20\x0a", 1.0
    for i in range(1, len(s)):
        p, gone, done = 1.0, set(), False
        for k in range(min(order, i), -1, -1):
            own = {x: n for (c, x), n in nodes.items() if c == s[i - k : i]}
            left = {x: n for x, n in own.items() if x not in gone}
            if own and left:
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    p, done = p * left[s[i]] / whole, True
                    break
                p *= len(left) / whole
            gone |= set(own)
        out *= p if done else p / (256 - len(gone))
    return math.log10(out)


@pytest.mark.parametrize("bounds", [{}, {"words": 8, "pairs": 3}, {"words": 1}, {"pairs": 0, "nodes": 0}])
def test_partial_matching_equals_its_definition(spark, bounds):
    values = texts(30)[:-1] + ["zebra quartz"]
    frame = analyses(spark, values, extra=True)
    learn = F.col("analysis_number") % 3 != 1
    tokens = [[w.translate(A_TO_Z).encode() for w in BLANK.findall(t or "")] + [b""] for t in values]
    counts = Counter(w for i, ws in enumerate(tokens) if i % 3 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    known = sum(10 ** plain_trie(counts, 4, t) for t in counts)
    kept = Counter(p for i, ws in enumerate(tokens) if i % 3 != 1 for p in zip([b"", *ws], ws))
    kept = {p: c for p, c in kept.items() if c >= 2}
    assert kept and len({a for a, _ in kept}) < len(counts)

    def after(a: bytes, w: bytes, alone: float) -> float:
        """Word ``w`` after ``a``: kept pairs of ``a`` by count, others by escape and exclusion."""
        own = {s: c for (f, s), c in kept.items() if f == a}
        if not own:
            return alone
        if w in own:
            return math.log10(own[w] / (counts[a] + len(own)))
        rest = 1 - sum(counts[s] / (n + v) for s in own)
        return math.log10((counts[a] - sum(own.values()) + len(own)) / (counts[a] + len(own)) / rest) + alone

    got = {r.analysis_number: r for r in ppm.score(frame, learn, least_pair=2, **bounds).collect()}
    assert len(got) == len(values)
    for i, ws in enumerate(tokens):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        alone = [math.log10(counts[w] / (n + v)) if counts[w] else
                 math.log10(v / (n + v) / (1 - known)) + plain_trie(counts, 4, w) for w in ws]
        model = sum(after(a, w, x) for a, w, x in zip([b"", *ws], ws, alone))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model)
    blank = ppm.score(frame, F.lit(False)).where("analysis_number = 0").first()
    assert blank.n_known == 0 and blank.score < 0 and blank.base_score == 0
    assert ppm.score(frame.limit(0), learn).count() == 0


def test_more_text_gives_more_contexts(spark):
    """Pairs and byte contexts are kept by fixed counts, however large the rest of the corpus is."""
    rare = [(i, f"quartz zebra {i}") for i in range(8)]
    for fill in (100, 2000):
        rows = rare + [(100 + i, f"plot by the road {i % 7}") for i in range(fill)]
        counts = ppm.token_counts(spark.createDataFrame(rows, "id long, description string"), F.lit(True))
        rated = counts.selectExpr("token", "0.0D AS base", "1L AS known", "-1.0D AS model", "n_train", "n_all")
        texts = spark.createDataFrame([(t,) for _, t in rows], "description string")
        pairs = {r.pair: r.n for r in ppm.pair_counts(texts, ppm.held_words(rated)).collect()}  # all words are in memory
        assert pairs["quartz zebra"] == 8 and pairs[" quartz"] == 8 and "zebra 1" not in pairs
        key = 4 << 48 | int.from_bytes(b"artz", "big")
        assert ppm.train(counts).where(f"shiftright(key, 8) = {key}").count() == 1


def test_stored_tables_keep_rows(spark):
    frame = analyses(spark, texts())
    assert sorted(map(repr, stored(frame, "t").collect())) == sorted(map(repr, frame.collect()))
