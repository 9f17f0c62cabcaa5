"""Operator 6 against brute force, and its edge cases."""

import random
import re

import numpy as np
import pytest

from lattica.llm import jaccard

SCHEMA = "doc_id long, text string"


def shingles(text, n=jaccard.WORDS):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, threshold=jaccard.THRESHOLD):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    out = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= threshold:
                    out[a, b] = j
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        rows.append((i * 10, " ".join(base)))
        for c in range(rng.choice([0, 0, 1, 4])):
            near = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in base]
            rows.append((i * 10 + 1 + c, " ".join(near)))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, "one"), (1003, "One!"), (1004, "two words"), (1005, ""), (1006, None), (None, rows[0][1])]
    return rows


def found(df):
    return {(r.doc_a, r.doc_b): r.jaccard for r in df.collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = found(jaccard.near_pairs(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows)
    assert set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)
    assert (1002, 1003) in got and (0, 1000) in got and (1000, 1001) in got


def test_crowds_are_cut_into_blocks(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    together = found(jaccard.near_pairs(df))
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "LIST", 1)
    assert found(jaccard.near_pairs(df)) == together


def test_near_threshold_pairs_force_a_descent(spark, monkeypatch):
    """The estimate stops at the deepest prefixes where only close copies exist, and goes on for pairs right at the threshold."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    depths = []
    real = jaccard._level
    monkeypatch.setattr(jaccard, "_level", lambda trie, floor, depth, deeper: depths.append(depth) or real(trie, floor, depth, deeper))

    def pairs(shared):
        out = []
        for i in range(150):
            common = [word() for _ in range(shared)]
            out += [(2 * i, " ".join(common + [word() for _ in range(100 - shared)])), (2 * i + 1, " ".join(common + [word() for _ in range(100 - shared)]))]
        return out

    for shared, want in ((98, [5]), (73, [5, 4])):
        depths.clear()
        rows = pairs(shared)
        got = found(jaccard.near_pairs(spark.createDataFrame(rows, SCHEMA)))
        true = {p: j for p, j in ((p, len(shingles(rows[p[0]][1]) & shingles(rows[p[1]][1])) / len(shingles(rows[p[0]][1]) | shingles(rows[p[1]][1]))) for p in ((2 * i, 2 * i + 1) for i in range(150))) if j >= jaccard.THRESHOLD}
        assert depths == want and len(true) > 100 and set(got) <= set(true) and len(got) >= 0.9 * len(true)


def test_digests_that_begin_alike_stay_apart(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    plain = found(jaccard.near_pairs(df))
    real = jaccard._signed

    def masked(batches):
        for batch in real(batches):
            nodes = [n & 3 for n in batch.column("node").to_pylist()]
            yield batch.set_column(2, "node", jaccard.pa.array(nodes, jaccard.pa.int64()))

    monkeypatch.setattr(jaccard, "_signed", masked)
    assert found(jaccard.near_pairs(df)) == plain


def test_repeated_ids_give_a_pair_once(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(5, text), (5, text + " b c"), (9, text), (9, text)]
    assert found(jaccard.near_pairs(spark.createDataFrame(rows, SCHEMA))) == {(5, 9): 1.0}
    assert jaccard.near_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_one_of_each_keeps_the_least_id(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + [rows[5]]], SCHEMA + ", _rank int, node string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found(jaccard.near_pairs(df.select("doc_id", "text"))):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({root(i) for i in parent})
    assert ids.count(None) == 1


def test_long_text_and_empty_table(spark):
    text = " ".join(f"a{i % 7000} b{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " more"), (3, "x" * 3_000_000)]
    assert set(found(jaccard.near_pairs(spark.createDataFrame(rows, SCHEMA)))) == {(1, 2)}
    assert jaccard.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert jaccard.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_every_text_of_repeated_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, one), (9, one), (3, two), (5, two + " more"), (None, two), (None, two), (None, None), (8, ""), (5, one)]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept, key=str) == sorted([(5, one), (3, two), (None, two), (None, None), (8, "")], key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 22), (22, 31)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    roots = {r.node: r.root for r in jaccard.components(df).collect()}
    assert {n for n, r in roots.items() if r == 1} == {1, 2, 3, 7, 8, 9}
    assert roots[21] == 20 and roots[30] == roots[31] == 22


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(base[:2000]), np.unique(base[500:2500])]
    sig = jaccard.signatures(sets)
    want = 1500 / 2500
    assert abs((sig[0] == sig[1]).mean() - want) < 0.15
    import pandas as pd

    a, b = (pd.Series([row.tobytes()]) for row in jaccard.sketches(sig))
    assert abs(jaccard._estimate(a, b)[0] - want) < 0.2


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_found_chance(depth):
    assert jaccard.found_chance(1.0, depth) == 1
    assert jaccard.found_chance(0.6, depth) < jaccard.found_chance(0.8, depth)


def test_tables_without_a_word(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "..."), (None, None)], SCHEMA)
    assert jaccard.near_pairs(df).count() == 0 and jaccard.one_of_each(df).count() == 4


def brute_classes(rows):
    """Class and number of links of each id, by union and find over all pairs."""
    parent, links = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        links[a] += 1
        links[b] += 1
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in parent}


@pytest.mark.parametrize("small", [False, True])
def test_a_row_a_document_with_class_and_links(spark, monkeypatch, small):
    if small:  # many blocks and products, sets by a shuffle
        for name, value in (("LINK_BYTES", 1500), ("LINK_ROWS", 2), ("LINK_SHINGLES", 7), ("MOST_BROADCAST", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    repeated = [*rows, rows[3], rows[-1], (1005, None)]
    got = jaccard.linked(spark.createDataFrame(repeated, SCHEMA)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute_classes(rows) and len(got) == len(rows) - 1
    assert jaccard.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_of_an_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (9, one), (7, two + " more")]
    got = jaccard.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == [(5, 5, 1), (5, 5, 1), (7, 5, 1), (9, 5, 1)]


@pytest.mark.parametrize("use", [jaccard.linked, jaccard.one_of_each])
def test_a_group_of_near_copies_is_joined_without_all_its_pairs(spark, monkeypatch, use):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i in range(400) for k in [rng.randrange(80)]]
    compared = []
    real = jaccard._confirmed
    monkeypatch.setattr(jaccard, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    got = use(spark.createDataFrame(rows, SCHEMA)).collect()
    assert 0 < sum(compared) < 32 * 400 < 400 * 399 / 2 / 6
    if use is jaccard.linked:
        assert {(r.class_id, r.links) for r in got} == {(0, 399)}
    else:
        assert [r.doc_id for r in got] == [0]


@pytest.mark.parametrize("size", [1 << 23, 1500])
def test_classes_hold_links_that_the_least_node_lacks(spark, monkeypatch, size):
    """Both ends of a chain are far apart; what the least node under a prefix isn't linked to is compared with the others."""
    monkeypatch.setattr(jaccard, "LINK_BYTES", size)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[15 * i : 15 * i + 100])) for i in range(20)]
    want = brute_classes(rows)
    assert {c for c, _ in want.values()} == {0} and max(n for _, n in want.values()) < 8
    got = jaccard.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == want
