"""Operator 9 against brute force, and its edge cases."""

import numpy as np
import pytest

from lattica.llm import embed

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, threshold):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    c = x @ x.T
    return {tuple(sorted((rows[i][0], rows[j][0]))): c[i, j] for i, j in zip(*np.nonzero(c >= threshold)) if rows[i][0] != rows[j][0]}


def found(df):
    return {(r.a, r.b): r.cosine for r in df.collect()}


def planted(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(0, n, 5):
        for k in range(1 + i % 3):
            rows.append((n + 10 * i + k, base[i] + rng.normal(size=dim) * 0.08 * (k + 1)))
    rows += [(100_000 + k, base[1] * (k + 1)) for k in range(60)]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("threshold", [0.9, 0.95])
def test_recall_and_exactness(spark, threshold):
    rows = planted(3)
    got = found(embed.near_vectors(spark.createDataFrame(rows, SCHEMA), threshold))
    want = brute(rows, threshold)
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_last_ring_is_complete(spark):
    rows = planted(4, n=200)
    got = found(embed.near_vectors(spark.createDataFrame(rows, SCHEMA), 0.85, target=1.1))
    assert set(got) == set(brute(rows, 0.85))


def test_sf_table_with_planted_copies(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    rng = np.random.default_rng(0)
    copies = [(10_000 + i, [float(np.float32(x)) for x in np.array(v) + rng.normal(size=len(v)) * 0.015]) for i, v in rows[:100]]
    got = found(embed.near_vectors(table.union(spark.createDataFrame(copies, SCHEMA))))
    want = brute(rows + copies, embed.THRESHOLD)
    assert len(want) >= 90 and set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_near_pairs_beside_a_hot_group(spark, monkeypatch):
    """Equal vectors, found in the first ring, don't end the search for near ones; crowded cells are cut into slots."""
    monkeypatch.setattr(embed, "SLOT", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(500, 64))
    near = base + rng.normal(size=base.shape) * 0.29
    hot = rng.normal(size=64)
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, v) for i, v in enumerate(near)] + [(5000 + i, hot) for i in range(120)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows]
    got, want = found(embed.near_vectors(spark.createDataFrame(rows, SCHEMA))), brute(rows, embed.THRESHOLD)
    apart = [p for p, c in want.items() if c < 1 - 1e-9]
    assert len(apart) > 200 and set(got) <= set(want)
    assert sum(p in got for p in apart) >= 0.95 * len(apart) and sum(p in got for p in want) >= 0.99 * len(want)


def test_cosine_at_the_threshold_counts(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.5, 0.8])]
    assert set(found(embed.near_vectors(spark.createDataFrame(rows, SCHEMA), 0.6))) == {(1, 2), (2, 3)}


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    nan = float("nan")
    rows = [(1, v), (2, v), (2, v), (None, v), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 1.0, 1.0]), (7, [nan, 1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [-1.0, -2.0, -3.0, -4.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", cell int, id int")
    got = found(embed.near_vectors(df, 0.99))
    assert set(got) == {(1, 2)} and got[1, 2] == pytest.approx(1.0)
    assert embed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embed.near_vectors(spark.createDataFrame([(1, v)], SCHEMA)).count() == 0
    assert found(embed.near_vectors(spark.createDataFrame([(1, [2.0]), (2, [5.0]), (3, [-1.0])], SCHEMA))) == {(1, 2): 1.0}


def test_a_row_an_id_with_class_and_links(spark, sf):
    """A group of n near vectors has n rows; SQL says the same."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(9)
    hot = rng.normal(size=32)
    rows = [(i, hot + rng.normal(size=32) * 0.1) for i in range(60)] + [(100 + i, rng.normal(size=32)) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = embed.linked(spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (900, None)], SCHEMA)).collect()
    assert len(got) == 101 and {(r.class_id, r.links) for r in got if r.vec_id < 60} == {(0, 59)}
    assert all((r.class_id, r.links) == (r.vec_id, 0) for r in got if r.vec_id >= 60)
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(db.execute(embed.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in got if r.vec_id != 900)


def test_recall_is_measured_where_the_sample_has_few_pairs(spark, monkeypatch):
    """Rings that find next to nothing don't end the search because the sample can't tell."""
    monkeypatch.setattr(embed, "RINGS", (1e-6, 2e-6, 3e-6, 1.0))
    rng = np.random.default_rng(12)
    base = rng.normal(size=(600, 16))
    near = base[:12] + rng.normal(size=(12, 16)) * 0.25
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*base, *near])]
    want = {p for p, c in brute(rows, embed.THRESHOLD).items() if c < 1 - 1e-9}
    assert len(want) > 4
    monkeypatch.setattr(embed, "LEAST_PAIRS", 10**6)
    assert set(found(embed.near_vectors(spark.createDataFrame(rows, SCHEMA)))) == want
