"""Operator 2 against one-by-one packing, and its edge cases."""

import random
from collections import Counter, defaultdict

import pytest

from lattica.llm import packing


def one_by_one(lengths, capacity):
    """Greedy matching of large items, then best fit of the others, item by item."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    bins = []
    while large:
        x = large.pop(0)
        partner = next((i for i, y in enumerate(large) if x + y <= capacity), None)
        bins.append([x] if partner is None else [x, large.pop(partner)])
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        open_ = [b for b in bins if capacity - sum(b) >= x]
        if open_:
            min(open_, key=lambda b: capacity - sum(b)).append(x)
        else:
            bins.append([x])
    return Counter(tuple(sorted(b)) for b in bins)


def planned(lengths, capacity):
    plan = packing.Plan(dict(Counter(lengths)), capacity)
    runs, bins, seen = plan.arrays(), defaultdict(list), Counter()
    for x in lengths:
        first, first_bin, per_bin, offset = runs[x]
        r = seen[x]
        seen[x] += 1
        k = max(i for i, f in enumerate(first) if f <= r)
        i = r - first[k]
        bins[int(first_bin[k] + i // per_bin[k])].append((int(offset[k] + i % per_bin[k] * x), x))
    for b in bins.values():
        at = 0
        for offset, x in sorted(b):
            assert offset == at
            at += x
        assert at <= capacity
    return Counter(tuple(sorted(x for _, x in b)) for b in bins.values())


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 1000])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 4)) for _ in range(rng.randint(0, 400))]
    got, want = planned(lengths, capacity), one_by_one(lengths, capacity)
    assert sum(got.values()) == sum(want.values())
    assert all(sum(3 * x > capacity for x in b) <= 2 for b in got)
    # Bins of equal room are interchangeable, so compare how full they are.
    assert Counter(sum(b) for b in got.elements()) == Counter(sum(b) for b in want.elements())


def check(rows, out, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for pieces in by_bin.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.bin_offset):
            assert p.bin_offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    counts = Counter(i for i, _ in rows)
    assert set(by_doc) == set(counts)
    for i, text in rows:
        pieces = by_doc[i]
        assert sum(p.length for p in pieces) == counts[i] * packing.token_count(text)
    assert sorted(by_bin) == list(range(len(by_bin)))


def test_every_token_has_one_place(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.choice([1, 3, 10, 40, 90])))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (None, "no id here"), (5002, "long " * 500), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, bin_id int, rank int")
    out = packing.pack(df, capacity=64, buckets=4).collect()
    check(rows, out, 64)
    assert [(r.length, r.bin_id) for r in out if r.doc_id in (5000, 5001)] == [(0, None)] * 2
    assert len([r for r in out if r.doc_id == 5002]) == -(-packing.token_count("long " * 500) // 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_capacity_must_be_positive(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=0)


def test_pieces_join_to_the_text():
    text = ("word " * 30_000) + "x" * 200_000 + "\nend"
    assert "".join(packing.pieces_of(text)) == text
