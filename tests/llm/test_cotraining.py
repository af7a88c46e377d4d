import random

import numpy as np
import pytest

from trawl.llm import cotraining as ct


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        good, text = rng.random() < 0.8, [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if not good:
            kind = rng.randrange(4)
            text = [t.upper() + "!!" for t in text] if kind == 0 else [t + "$$$" for t in text] if kind == 1 else text[:1] * len(text) if kind == 2 else [x for t in text for x in (t, "|")]
        rows.append((k, " ".join(text), "en", f"src{k % 5}" if good or rng.random() < 0.3 else "dump", good))
    return rows


def test_logistic_is_calibrated_and_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    m = ct.Logistic(x, y)
    assert np.allclose(m.w[:2] / m.spread[:2], [2, -1], atol=0.2)
    p = m.probability(x)
    assert abs(y[(p > 0.4) & (p < 0.6)].mean() - 0.5) < 0.08


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(score) - n))


def test_features_by_hand():
    x = dict(enumerate(ct.shares("AB ab ab\n||| a! é\n\nAB ab ab")))
    assert len(x) + 3 == ct.CONTENT and all(0 <= v <= 1 for v in x.values())
    assert (x[0], x[2]) == (pytest.approx(14 / 27), pytest.approx(3 / 27)) and x[9] == pytest.approx(2 / 9) and x[10] == pytest.approx(4 / 9) and x[15] == pytest.approx(1 / 3)
    words, pairs, runs = ct.grams("Ab aB ab")
    assert len(set(words.tolist())) == 1 and len(pairs) == 2 and len(runs) == 6
    assert all(v == 0 for v in ct.shares("")[:15]) and all(len(g) == 0 for g in ct.grams(""))
    assert list(ct.log_odds(np.array([0, 3]), np.array([0, 1]), 4, 4)) == [0, pytest.approx(np.log(2))]


def test_pieces_change_nothing(monkeypatch):
    text = "Ab!! 12 ||é漢 🙂x\nab ab..., " * 30
    whole = ct.shares(text), [g.tolist() for g in ct.grams(text)]
    monkeypatch.setattr(ct, "PIECE", 7)
    assert ct.grams(text)[2].tolist() == whole[1][2]
    assert ct.shares(text) == whole[0]


def test_cuts_take_the_surest_rows_of_each_class_up_to_their_quota():
    logit = np.array([9.0, 8, 5, 4, 1, -1, -4.5, -6, -6, 20])
    steps, n = np.unique(ct.steps_of(logit), return_counts=True)
    got = ct.cut(dict(zip(steps.tolist(), n.tolist(), strict=True)), (3, 1), 0.97)
    good, bad = got.taken(ct.steps_of(logit), np.linspace(0, 0.9, 10))
    assert np.flatnonzero(good).tolist() == [0, 1, 9] and got.some_low == 0.5 and set(np.flatnonzero(bad)) <= {7, 8}
    all_, none = ct.cut(dict.fromkeys(steps.tolist(), 1), (99, 99), 0.97), ct.cut({}, (5, 5), 0.97)
    assert np.flatnonzero(all_.taken(ct.steps_of(logit), np.zeros(10))[0]).tolist() == [0, 1, 2, 3, 9]
    assert not any(x.any() for x in none.taken(ct.steps_of(logit), np.zeros(10)))


KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


def test_views_teach_each_other_over_all_rows_as_if_they_lay_in_one_place(spark):
    rows = corpus(1500)
    df = spark.createDataFrame([(*r[:4], len(r[1]), 0.1, "x") for r in rows], KINDS).repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[4]), None if r[0] % 2 else 1) for r in rows if r[0] % 3 == 0] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model, features = ct.train(df, labels)
    assert min(model.taught) >= 0 and sum(model.taught) > 20
    got = {r.doc_id: r for r in ct.scored(features, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    unseen = [r for r in rows if r[0] % 3]
    assert sum(got[r[0]].keep == r[4] for r in unseen) > 0.98 * len(unseen)
    kept = ct.kept_documents(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.keep}

    # The plain version: the same rounds over one array, in another order of rows.
    table = features.toPandas().merge(labels.toPandas().dropna(subset=["doc_id", "quality"]).rename(columns={"doc_id": "id"}), "left", "id").sort_values("id")
    of = {r.known: r.part for r in spark.createDataFrame([(r[0],) for r in rows], "known long").selectExpr("known", "pmod(xxhash64(known, 7), 10) AS part").collect()}
    draw = {r.id: r.draw for r in spark.createDataFrame([(r[0],) for r in rows], "id long").selectExpr("id", "pmod(xxhash64(id, 1), 1048576) / 1048576D AS draw").collect()}
    x, label, part = np.array(table["x"].tolist(), float), table["quality"].to_numpy(), table["id"].map(of).to_numpy()
    known = ~np.isnan(label)
    fit, held = known & (part >= 3) & (part < 7), known & (part >= 7)
    plain = ct.CoTrained(model.lore, (x[fit], label[fit]), (x[held], label[held]), ct.Rows(x[~known], table["id"].map(draw).to_numpy()[~known]), int((~known).sum()))
    assert plain.taught == model.taught
    for one, two in zip(plain.models, model.models, strict=True):
        assert np.allclose(one.w, two.w, atol=1e-6)
    want = plain.score(x)[0]
    assert np.allclose(want, [got[k].score for k in table["id"]], atol=1e-6)


def test_held_out_accuracy_of_each_view_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, features = ct.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = ct.scored(features, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = np.array([r.quality == 1 for r in rows])
    found = {c: auc(np.array([r[c] for r in rows]), good) for c in ("score", "text_score", "page_score")}
    assert len(rows) > 100 and found["text_score"] > 0.97 and found["score"] > 0.97, found
    assert 0.3 < found["page_score"] <= 1  # the given metadata say next to nothing of quality


def test_a_page_view_that_knows_something_and_columns_under_other_names(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        good = rng.random() < 0.5
        rows.append((k, " ".join(rng.choice("abcdef") for _ in range(20)), None, "dump" if good == (rng.random() < 0.1) else "press", int(good)))
    df = spark.createDataFrame(rows, "k long, body string, tongue string, host string, good int")
    names = {"text": "body", "lang": "tongue", "source": "host"}
    model, features = ct.train(df, df.where("k % 2 = 0").select("k", "good"), "good", "k", **names)
    got = {r.k: r for r in ct.scored(features, model, "k").collect()}
    tested = [r for r in rows if r[0] % 2]
    assert auc(np.array([got[r[0]].page_score for r in tested]), np.array([r[4] == 1 for r in tested])) > 0.85
    assert np.mean([got[r[0]].keep == r[4] for r in tested]) > 0.8
    assert {r.k for r in ct.kept_documents(df, model, **names).collect()} == {k for k, r in got.items() if r.keep}


def test_nulls_repeats_and_nothing_to_learn(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, 4), (None, "", "en", "a", -3), (2, "x" * 300_000, "en", None, 300_000), (3, "a\n" * 9, None, "b", 18)]
    df = spark.createDataFrame([(*r, 0.5, "z") for r in rows], KINDS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, quality int")
    for labels in (none, one):
        model, features = ct.train(df, labels)
        got = ct.scored(features, model).collect()
        assert model is None and len(got) == 5 and all(r.keep and r.score == 0.5 for r in got)
        assert ct.kept_documents(df, model).count() == 5
    rng = np.random.default_rng(0)
    x, y = rng.random((80, ct.CONTENT + ct.PAGE)), np.array([0.0, 1.0] * 40)
    model = ct.CoTrained(ct.Lore(np.zeros((3, ct.SLOTS)), {}, {}), (x[:40], y[:40]), (x[40:], y[40:]), ct.Rows(x[:0], y[:0]), 0)
    assert ct.kept_documents(df, model, keep_from=0.0).count() == 5 and ct.kept_documents(df.limit(0), model).count() == 0
    assert ct.train(df.limit(0), one)[0] is None
    assert all(np.isfinite(model.score(model.lore.views(b))[0]).all() for b in df.select("text", "lang", "source", "n_chars").toArrow().to_batches())
