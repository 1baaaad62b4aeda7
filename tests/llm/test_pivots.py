import math

import numpy as np
import pytest

from canopy.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, bound=0.9):
    x = np.array(vectors, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= bound
    np.fill_diagonal(link, False)
    return link


def test_recall_and_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(600, 32))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    share = rng.uniform(0.88, 0.95, (600, 1))
    vectors = np.concatenate([base, share * base + np.sqrt(1 - share**2) * other, rng.normal(size=(1500, 32))]).astype(np.float32)
    link = brute(vectors)
    for block in (2048, 40):
        out = pivots.near_duplicates(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA), block=block).collect()
        found = np.array([r["n_links"] for r in sorted(out, key=lambda r: r["vec_id"])])
        assert (found <= link.sum(1)).all() and found.sum() >= 0.95 * link.sum()


def test_dense_groups_and_copies(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    group = (centre + 0.02 * rng.normal(size=(150, 16))).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(group)] + [(1000 + k, group[3].tolist(), 2) for k in range(20)]
    link = brute([r[1] for r in rows])
    out = {r["vec_id"]: r for r in pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=32).collect()}
    assert [out[i]["n_links"] for i, *_ in rows] == link.sum(1).tolist()
    assert {r["component_id"] for r in out.values()} == {0} and [i for i, r in out.items() if r["kept"]] == [0]


def test_odd_vectors(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [math.nan, 1.0], 0), (6, [math.inf, 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [1.0], 0), (None, [0.0, 1.0], 0)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out.pop(7) == (1, 7, True) and out.pop(8) == (1, 7, False)
    assert out == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, None)}
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [256 << 20, 0])
def test_many_lengths(spark, monkeypatch, most):
    """80 lengths with two parallel vectors each, with pivots broadcast and by shuffle; in double precision."""
    monkeypatch.setattr(pivots, "MOST_BROADCAST", most)
    monkeypatch.setattr(pivots, "DEALT", 1)
    rows = [(2 * w + k, [float(k + 1)] * w) for w in range(3, 83) for k in range(2)]
    rows += [(500, [1e200, 1e200]), (501, [2e200, 2e200]), (502, [1.0, 1e-9]), (502, [1.0, 1e-9]), (503, [1.0, 2e-9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("label", "raw")
    out = [(r["vec_id"], r["n_links"], r["component_id"]) for r in pivots.near_duplicates(table).collect()]
    assert all(n == 1 and c == i // 2 * 2 for i, n, c in out if i < 500)
    assert sorted(x for x in out if x[0] >= 500) == [(500, 1, 500), (501, 1, 500), (502, 2, 502), (502, 2, 502), (503, 2, 502)]


@pytest.mark.parametrize("many", [1024, 4096])
def test_recall_with_many_pivots(spark, monkeypatch, many):
    """Pairs at the bound, none of them a pivot, as in a table of 100 vectors a pivot."""
    rng = np.random.default_rng(many)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    drawn = unit(rng.normal(size=(many, 64)))
    monkeypatch.setattr(pivots, "spread", lambda units, most: drawn)
    base, other = unit(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    share = rng.uniform(0.9, 0.91, (2000, 1))
    vectors = np.concatenate([base, share * base + np.sqrt(1 - share**2) * other]).astype(np.float32)
    link = brute(vectors)
    out = pivots.near_duplicates(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA)).collect()
    found = sum(r["n_links"] for r in out)
    assert 0.95 * link.sum() <= found <= link.sum()
