import random

import numpy as np
import pytest
from test_simhash import components, texts

from trawl.llm import simhash_similar as sim


def slow_set(text, shingle=5):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()


def test_keys_and_low_bytes_miss_no_pair_at_the_threshold():
    tables, needed = sim.plan(0.8)
    assert (1 - 0.8**sim.ROWS) ** tables <= sim.MISS < (1 - 0.8**sim.ROWS) ** (tables - 1)
    rng = np.random.default_rng(5)
    for n in (5, 9, 45, 9_000):
        shared = []
        for _ in range(300 if n < 100 else 9):
            x = rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64)
            a, b = (sim.min_hashes(y, tables * sim.ROWS) for y in (x[:n], x[n // 9 :] if n > 5 else x[: n - 1]))
            assert set(sim.table_keys(a).tolist()) & set(sim.table_keys(b).tolist())
            assert (a.astype(np.uint8) == b.astype(np.uint8)).sum() >= needed
            shared.append(np.mean(a == b))
        assert abs(np.mean(shared) - 0.8) < 0.06
    assert sim.plan(1.0) == (1, sim.ROWS)


def test_alike_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(sim, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    base = rng.integers(-100, 100, 60)
    rows = [np.unique(np.where(rng.random(60) < p, rng.integers(-100, 100, 60), base)) for p in rng.choice([0.02, 0.1, 0.5], 50)]
    a, b = np.arange(25), np.arange(15, 50)
    label = list(range(50))
    got = [e for pair in sim.alike(rows, a, b, 0.8) for e in zip(*pair, strict=True)]
    linked = lambda i, j: i != j and ((i in a and j in b) or (j in a and i in b)) and 5 * len(set(rows[i]) & set(rows[j])) >= 4 * len(set(rows[i]) | set(rows[j]))
    joined = {(int(x), int(y)) for x, y in got}
    assert components(50, lambda i, j: (i, j) in joined or (j, i) in joined) == components(50, linked) != label


@pytest.mark.parametrize(("block", "most"), [(1024, 32), (8, 0)])
def test_similar_texts_are_joined_and_one_of_each_stays(spark, monkeypatch, block, most):
    monkeypatch.setattr(sim, "BLOCK_ROWS", block)
    monkeypatch.setattr(sim, "MOST", most)
    rng = random.Random(6)
    some = [t for t in texts(7, 60) if len(t.split()) > 20]
    hub = [rng.choice(some[0].split()) + str(k) for k in range(150)]
    for _ in range(60):
        t = list(hub)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(150)] = "changed" + str(rng.random())
        some.append(" ".join(t))
    rows = list(enumerate(some)) + [(900, None), (901, ""), (902, "two words"), (903, "Two Words"), (903, "another of this id"), (None, "only once null")]
    df = spark.createDataFrame([(a, b, "whole") for a, b in rows], "doc_id long, text string, whole string").repartition(3)
    sets = [slow_set(t) for _, t in rows]

    def linked(i, j):
        return sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0

    label = components(len(rows), linked)
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    got = sorted((str(r.doc_id), str(r.component_id)) for r in sim.similar(df).collect())
    assert got == sorted((str(rows[i][0]), str(least[label[i]])) for i in range(len(rows)))
    kept = sim.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(x) for x in least.values()})
    assert sim.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [32, 0])
def test_short_texts_at_the_threshold_are_all_joined(spark, monkeypatch, most):
    monkeypatch.setattr(sim, "MOST", most)
    monkeypatch.setattr(sim, "BLOCK_ROWS", 8)
    monkeypatch.setattr(sim, "BITS", 1 << 15)
    rows = []
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]  # 4 of 5 shingles
    rows += [(1000 + k, " ".join(f"w{k}x{j}" for j in range(7))) for k in range(20)]  # 3 of 4 and of 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sim.similar(df).collect()}
    assert got == {k: k // 2 * 2 if k < 1000 else k for k, _ in rows}


def test_rows_with_equal_or_no_ids_stay_if_their_texts_differ(spark):
    text = lambda name: " ".join(f"{name}{j}" for j in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, None), (7, text("c")), (7, text("d")), (7, text("d").upper()), (3, text("d") + " more"), (9, text("e")), (9, text("e"))]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, whole string").repartition(3)
    kept = sim.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text)
    assert got == sorted([("None", text("a")), ("None", text("b")), ("7", text("c")), ("3", text("d") + " more"), ("9", text("e"))])
    assert kept.count() == 6


def test_equal_fingerprints_of_repeats_do_not_join_different_texts(spark):
    rows = [(k, "again " * 400 + " ".join(f"own{k}x{j}" for j in range(100))) for k in range(4)]
    assert len({sim.print_of(sim.shingle_hashes(sim.words_of(t), 5)) for _, t in rows}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in sim.one_of_each(df).collect()} == {0, 1, 2, 3}


def test_a_long_chain_takes_the_driver_no_more_jobs_than_a_short_one(spark):
    """Each job costs the driver threads and heap, of which it has little."""
    jobs, n = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs, []
    for length in (3, 90):
        rows = [(k, " ".join(f"w{j}" for j in range(3 * k, 3 * k + 60))) for k in range(length)]
        docs, before = spark.createDataFrame(rows, "doc_id long, text string"), jobs()
        assert {r.component_id for r in sim.similar(docs).collect()} == {0}
        n.append(jobs() - before)
    assert n[1] <= n[0] + 10
