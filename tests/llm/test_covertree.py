import numpy as np
import pytest

from trawl.llm import covertree


def brute(rows, least=0.95):
    """rows: (id, vector or None)."""
    n = len(rows)
    x = [np.array(v, float) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v in rows]
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                linked[i, j] = x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= least
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in np.nonzero(linked[i])[0])]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = [r[0] for r in rows]
    least_id = {g: min((ids[i] for i in range(n) if label[i] == g and ids[i] is not None), default=None) for g in set(label)}
    return sorted(((i is None, i or 0), int(linked[k].sum()), least_id[label[k]], i == least_id[label[k]]) for k, i in enumerate(ids))


def engine(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect())


def clustered(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = np.concatenate([rng.normal(size=(n // 3, dim)), centres[rng.integers(groups, size=n - n // 3 * 2)], np.repeat(centres[:1], n // 3, 0)])
    x[n // 3 :] += rng.normal(size=(len(x) - n // 3, dim)) * spread * rng.uniform(0, 1.5, size=(len(x) - n // 3, 1))
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed, dim, groups, spread", [(1, 3, 5, 0.1), (2, 16, 8, 0.12), (3, 64, 6, 0.15), (4, 2, 3, 0.3), (5, 8, 20, 0.02)])
def test_against_all_pairs(spark, monkeypatch, seed, dim, groups, spread):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "SAMPLE", 100)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(clustered(seed, 300, dim, groups, spread))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert engine(df) == brute(rows)


def test_tight_cells_within_reach_count_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 7)
    angles = [k * 0.004 for k in range(7)] + [0.2 + k * 0.004 for k in range(7)]  # too few of either for a core
    rows = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angles)]
    got = engine(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == brute(rows) and all(n == 13 for _, n, _, _ in got)


@pytest.mark.parametrize("seed", range(6))
def test_local_trees_against_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4 if seed % 2 else 100)
    monkeypatch.setattr(covertree, "STRIP", 7)
    x = clustered(seed, 240, 2 + seed, 6, 0.15)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    reach = (2 - 1.9) ** 0.5
    n, _, edges = covertree.local_links(x, None, 0.95, reach)
    assert (n == linked.sum(1)).all()
    assert all(a == b or 0 <= a < 240 and 0 <= b < 240 for e in edges for a, b in zip(*e, strict=True))
    na, nb, _ = covertree.local_links(x[:100], x[100:], 0.95, reach)
    assert (na == linked[:100, 100:].sum(1)).all() and (nb == linked[:100, 100:].sum(0)).all()


def test_odd_vectors_ids_and_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1e-30, 0.0]),
            (10, [1e30, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [5.0, 0.0, 0.1]), (0, [0.0, -1.0]), (13, [-0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<float>, n_links int, component_id string")
    assert engine(df) == brute(rows)
    assert engine(df.limit(0)) == []
    assert engine(df.where("vec_id = 3")) == [((False, 3), 0, 3, True)]
