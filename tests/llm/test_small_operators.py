"""Operators 1, 5 and 7: brute force and edge cases."""

import fnmatch
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import decontam, sharding, textkernel, url_filter


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab*?/", max_size=9), min_size=1, max_size=40), st.lists(st.text("ab/c", max_size=12), max_size=20))
def test_automaton_equals_fnmatch(globs, urls):
    got = url_filter.Automaton(globs).run([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            assert got[i, k] == bool(re.fullmatch(fnmatch.translate(g), u)), (g, u)


def test_url_edge_cases(spark):
    rules = (url_filter.Rule(3, "block", "*bad*"), url_filter.Rule(1, "allow", "*good*"), url_filter.Rule(7, "block", "http://x.org:8080/*"))
    rows = [(1, "HTTP://X.org:80/Bad#f"), (2, "http://x.org/bad/good?utm_a=1&b=2&gclid=9"), (3, None), (4, ""), (5, "http://X.ORG:8080"), (6, "/" + "bad" * 100_000), (6, "no scheme"), (None, "bad")]
    df = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, verdict string")
    got = {(r.page_id, r.canonical_url): (r.rules, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got[1, "http://x.org/Bad"] == ("", "pass")
    assert got[2, "http://x.org/bad/good?b=2"] == ("1,3", "allow")
    assert got[3, None] == ("", "invalid")
    assert got[4, "/"] == ("", "pass")
    assert got[5, "http://x.org:8080/"] == ("7", "block")
    assert got[6, "/" + "bad" * 100_000] == ("3", "block") and got[6, "no scheme"] == ("", "pass")
    assert got[None, "bad"] == ("3", "block")
    assert url_filter.filter_urls(df.union(df), rules).count() == 2 * df.count()
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_loop_and_moves_little():
    keys = np.array([0, 1, -1, 7, 2**62, -(2**63), *range(1000, 3000)])
    for shards in (1, 2, 10, 4096):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]
    many = np.arange(50_000)
    a, b = sharding.jump_hash(many, 20), sharding.jump_hash(many, 21)
    moved = a != b
    assert (b[moved] == 20).all() and abs(moved.mean() - 1 / 21) < 0.01
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_sharding_edge_cases(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b")], "doc_id long, shard string")
    got = sharding.assign_shards(df, shards=10).collect()
    assert sorted((r.doc_id, r.shard) for r in got if r.doc_id) == [(5, jump(5, 10))] * 2
    assert [r.shard for r in got if r.doc_id is None] == [None]
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long")).count() == 0
    texts = spark.createDataFrame([("a",), ("a",), ("b" * 100_000,), ("",), (None,)], "doc_id string").selectExpr("*", "xxhash64(doc_id) AS h")
    for r in texts.join(sharding.assign_shards(texts.select("doc_id"), shards=10).distinct(), "doc_id").collect():
        assert r["shard"] == jump(r.h, 10)
    assert [r["shard"] for r in sharding.assign_shards(texts.select("doc_id")).where("doc_id IS NULL").collect()] == [None]


def shingled(text, n):
    words = re.findall(r"\w+", (text or "").lower())
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute_leaks(docs, items):
    out = set()
    for item, text in items:
        words = re.findall(r"\w+", (text or "").lower())
        if item is None or not words:
            continue
        n = min(decontam.WORDS, len(words))
        own = set(shingled(text, n))
        width = len(words) - n + 1
        for doc, body in docs:
            s = shingled(body, n)
            best = max((len(own & set(s[i : i + width])) for i in range(len(s))), default=0)
            if best >= decontam.THRESHOLD * len(own) - 1e-9:
                out.add((doc, item, round(best / len(own), 9)))
    return out


def leak_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"é{i}" if i % 3 else f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 20, 40]))) for i in range(25)] + [(90, None), (91, ""), (None, "w3"), (92, "solo item")]
    docs = [(i, text(rng.randint(0, 150))) for i in range(60)] + [(500, None), (501, "")]
    for i in range(30):
        words = (items[i % 25][1]).split()
        noisy = [rng.choice(vocabulary) if rng.random() < 0.05 else w for w in words]
        docs.append((1000 + i, f"{text(rng.randint(0, 80))}\n{' '.join(noisy)} {text(rng.randint(0, 80))}"))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed, monkeypatch):
    docs, items = leak_case(seed)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, m int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in decontam.leaks(d, b).collect()}
    assert got == want
    clean = decontam.clean(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _, _ in want}
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 50)
    assert {(r.doc_id, r.item_id, round(r.containment, 9)) for r in decontam.leaks(d, b).collect()} == want


def test_repeated_rows_leak_as_often_as_they_occur(spark):
    text = "the planted passage of nine words stands right here"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (7, text), (8, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.leaks(docs, items).collect()) == [(0, 7), (0, 8), (1, 7), (1, 7), (1, 8), (1, 8)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]


def test_leaks_in_empty_and_long_inputs(spark):
    docs = spark.createDataFrame([(1, "filler words here " * 200_000 + "the planted passage of nine words stands right here " + "more filler " * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "The planted passage of nine words stands right here.")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.word) for r in decontam.leaks(docs, items).collect()] == [(1, 7, 600_000)]
    assert decontam.leaks(docs, items.limit(0)).count() == 0 and decontam.clean(docs, items.limit(0)).count() == 1
    assert decontam.leaks(docs.limit(0), items).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=12))
def test_word_hashes_know_words(texts):
    hashes, offsets = textkernel.word_hashes(texts)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    clean = [[w for w in ws if "�" not in w] for ws in words]
    if all("\udc80" > c or c > "\udfff" for t in texts if t for c in t):
        assert np.diff(offsets).tolist() == [len(w) for w in clean]
        flat = [w for ws in clean for w in ws]
        by = {}
        for w, h in zip(flat, hashes.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(3000))
    want = textkernel.word_hashes([text])[0]
    monkeypatch.setattr(textkernel, "_BLOCK", 1000)
    assert (textkernel.word_hashes([text, "x" * 5000])[0][:-1] == want).all()
    assert list(textkernel.slices([1, 2, None, 5_000_000, 1])) == [(0, 4), (4, 5)]
    assert pd.Series(textkernel.word_hashes([])[1]).tolist() == [0]
