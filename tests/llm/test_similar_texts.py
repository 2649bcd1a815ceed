"""The near-duplicate stage against brute force over 5-word shingles, on copies with edits."""

import random

import numpy as np

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar(a, b):
    one, other = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b)]
    return 5 * len(one & other) >= 4 * len(one | other)


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def edited(seed=9, groups=12, copies=9, line=""):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, rng.integers(20, 200)))
        out.append(line + " ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(int(rng.integers(1, max(2, len(base) // 30)))):
                words[rng.integers(len(words))] = rng.choice(vocabulary)
            out.append(line + " ".join(words))
    return [*out, "", "a", "a b c", "A b c", "a b c d", out[0], out[5].upper()]


def test_near_duplicates_equal_brute_force(spark):
    for line in ("", "all of the texts have one common line in front "):
        texts = edited(line=line)
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
        got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        assert got == brute(texts)


def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = "one two three four five six seven", "nine ten eleven twelve some other words"
    rows = [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "de", "s", 1), (3, a, "en", "s", 1)]
    want = None
    for given in (rows, rows[::-1]):
        got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(given, SCHEMA).repartition(3), "").collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (2, b)]
        assert want is None or sorted(got) == want
        want = sorted(got)


def test_simhash_anchors_give_the_first_links(spark):
    from acremark.llm import resemblance, simhash

    texts = edited(seed=4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    named = resemblance.nodes(docs, "text", "doc_id").collect()
    hashes = resemblance._Hashes()
    for r in named:
        assert r.simhash == simhash.majority(resemblance.shingles(texts[r.doc_id].encode(), hashes))
    prints = {r.node: r.simhash & (1 << 64) - 1 for r in named}
    root = {n: n for n in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    pairs = resemblance.near_pairs(spark.createDataFrame(named))
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert len(set(root.values())) < len(root)
    assert {n: got.get(n, n) for n in prints} == root


def test_near_copies_of_one_text_cost_about_their_number(spark, monkeypatch):
    from acremark.llm import resemblance

    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(104)]
    texts = [" ".join(base)]
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(6, 98), 2):  # at least 0.8 like the base, most less like one another
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    hashes = resemblance._Hashes()
    sets = [set(resemblance.shingles(t.encode(), hashes).tolist()) for t in texts]
    assert all(9 * len(sets[0] & s) >= 4 * (len(sets[0]) + len(s)) for s in sets)
    compared, verified = [], resemblance._verified

    def counted(pairs, known):
        compared.append(pairs.count())
        return verified(pairs, known)

    monkeypatch.setattr(resemblance, "_verified", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    named = resemblance.nodes(docs.selectExpr("text", "xxhash64(text) as text_hash"), "text", "text_hash")
    found = resemblance.roots(docs, "text", named).collect()
    assert len({r.root for r in found}) == 1 and len(found) == len(texts) - 1
    assert sum(compared) <= 8 * len(texts)


def test_texts_that_share_a_passage_meet_once_and_not_at_each_shingle(spark):
    from acremark.llm import resemblance

    rows = [(s, node, 400, place, 300) for s in range(50) for node, place in ((1, s), (2, s + 3), (3, 60 - s))]
    rows += [(99, 1, 400, 70, 300), (99, 4, 390, 2, 300)]
    got = resemblance._merged(spark.createDataFrame(rows, resemblance._PREFIX)).collect()
    assert sorted((r.node, r.n, r.place, r.rare) for r in got) == [(1, 400, 0, 300), (1, 400, 70, 300), (2, 400, 3, 300), (3, 400, 11, 300), (4, 390, 2, 300)]
    assert len({r.shingle for r in got}) == 2


def test_shingles_of_a_share_of_all_texts_are_frequent_however_large_the_table(spark, monkeypatch):
    from acremark.llm import resemblance

    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} {' '.join(f'x{k}y{i}' for i in range(20))}" for k in range(300)]
    monkeypatch.setattr(resemblance, "SAMPLE", 2)  # too few to see anything three times
    last, n = resemblance._frequent(spark.createDataFrame([(t,) for t in texts], "text string"), len(texts))
    shared = resemblance.shingles(passage.encode(), resemblance._Hashes())
    assert last.tolist() == [s for s in shared.tolist() if s < resemblance.LOW] and last.size > 3
    assert all(200 < k < 400 for k in n.tolist())
