import math

import numpy as np
import pytest
from fixtures import DOCS, bank_entities, entities, entity, ids, queries

from trawl.operators.dense import LSAEncoder, ModelEncoder, VectorIndex, nearest
from trawl.operators.fusion import Hybrid, rrf
from trawl.operators.lexical import BM25
from trawl.operators.names import NameMatcher
from trawl.operators.rerank import DEFAULT_WEIGHTS, FeatureReranker, PairReranker, get_reranker, load_weights
from trawl.plans.training import fit, listwise_loss


def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")


def slow_bm25(query, k1=1.5, b=0.75):
    from trawl.functions.text import tokens_of

    d = {k: tokens_of(t) for k, t in DOCS.items()}
    avg = sum(map(len, d.values())) / len(d)
    out = {}
    for k, t in d.items():
        for w in set(tokens_of(query)):
            df = sum(w in x for x in d.values())
            if tf := t.count(w):
                out[k] = out.get(k, 0) + math.log(1 + (len(d) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25(spark, tmp_path):
    index = BM25().index(docs(spark))
    q = queries(spark, "Gazprombank", "", "ru bank bank of", "nothing known")
    run = index.search(q)
    assert ids(run)[0] == "e1" and ids(run, "1") == [] == ids(run, "3")
    got = {r.doc_id: r.score for r in run.where("query_id = '2'").collect()}
    want = slow_bm25("ru bank bank of")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    index.save(str(tmp_path))
    again = BM25().load(spark, str(tmp_path)).search(q)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, run.collect()))
    assert index.search(q, k=1).where("query_id = '2'").count() == 1


def test_rrf_is_symmetric_and_ties_go_to_the_first_run(spark):
    a = spark.createDataFrame([("0", "x", 9.0, 1), ("0", "y", 8.0, 2)], "query_id string, doc_id string, score double, rank long")
    b = spark.createDataFrame([("0", "y", 0.9, 1), ("0", "x", 0.1, 2)], "query_id string, doc_id string, score double, rank long")
    rows = rrf([a, b]).orderBy("rank").collect()
    assert rows[0].score == rows[1].score == pytest.approx(1 / 61 + 1 / 62) and [r.doc_id for r in rows] == ["x", "y"]
    assert ids(rrf([a, b], weights=[1, 2])) == ["y", "x"] and ids(rrf([a, b], top=1)) == ["x"]


def test_lsa_matches_a_dense_decomposition(spark):
    texts = [(k, t) for k, t in DOCS.items()] + [("e5", "Gazprombank ru bank sanction"), ("e6", "Central Bank sanction person")]
    df = spark.createDataFrame(texts, "id string, text string")
    enc = LSAEncoder(dim=3).fit(df)
    rows = {r.id: np.array(r.vector) for r in enc.encode(df).collect()}
    found = {r.id: r.features for r in enc.features(df).collect()}
    a = np.zeros((len(texts), len(enc.vocab)))
    for i, (k, _) in enumerate(texts):
        for f in found[k]:
            if f in enc.vocab:
                a[i, enc.vocab[f]] += enc.idf[enc.vocab[f]]
        a[i] /= np.linalg.norm(a[i])
    v = np.linalg.svd(a, full_matrices=False)[2][:3].T
    want = a @ v
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([rows[k] for k, _ in texts])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-4)
    index = VectorIndex(LSAEncoder(dim=3)).index(df.withColumnRenamed("id", "doc_id"))
    run = index.search(queries(spark, "Gazprombank bank", "zzz"), k=4)
    assert ids(run)[0] in ("e1", "e5") and len(ids(run, "1")) == 4  # an unknown query still gets documents
    assert ids(index.search(queries(spark, "zzz"), k=4, drop_zero=True)) == []


def test_dense_search_against_brute_force(spark, monkeypatch, tmp_path):
    import trawl.operators.dense as dense

    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)).astype(np.float32)
    v = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "doc_id long, vector array<float>").repartition(4)
    q = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x[:5])], "query_id long, vector array<float>")
    want = np.argsort(-(x.astype(float) @ x[:5].astype(float).T), axis=0)[:3]
    run = nearest(q, v, 3).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in run] == [int(i) for k in range(5) for i in want[:, k]]
    fake = ModelEncoder("fake", 2, lambda: lambda texts: [[len(t), 1] for t in texts])
    index = VectorIndex(fake).index(docs(spark), cache=str(tmp_path))
    assert index.search(queries(spark, "a"), k=9).count() == 4
    assert VectorIndex(fake).index(docs(spark), cache=str(tmp_path)).vectors.count() == 4


NAMED = [
    entity("gpb", "Gazprombank Joint Stock Company", alias=["Bank GPB JSC"]),
    entity("gpn", "Gazprom Neft PJSC"),
    entity("pe", "LIMITED LIABILITY COMPANY PROMELEKTRO ENGINEERING", alias=["Promelektro Engineering OOO"]),
    entity("js", "John Smith", "Person"),
]


def test_names(spark):
    matcher = NameMatcher().index(entities(spark, *NAMED))
    q = queries(spark, "Gazpronbank", "Газпромбанк", "Promelectro Engineering", "Smith John", "  ")
    rows = matcher.matches(q).orderBy("query_id", "rank").collect()
    by = {k: [r for r in rows if r.query_id == k] for k in "01234"}
    assert by["0"][0].doc_id == "gpb" and by["0"][0].score > by["0"][1].score + 10
    assert by["1"][0].doc_id == "gpb" and by["2"][0].doc_id == "pe"
    assert by["3"][0].doc_id == "js" and by["3"][0].token_sort == 100 and by["3"][0].score == 79.0
    assert by["4"] == [] and len(by["0"]) == 4 == len({r.doc_id for r in by["0"]})
    assert by["0"][0].matched_name == "Gazprombank Joint Stock Company" and by["0"][0].token_set == pytest.approx(92.5, abs=0.1) or by["0"][0].token_sort > 80
    high = matcher.matches(q, min_score=80).where("query_id = '0'").collect()
    assert high and all(r.score >= 80 for r in high)
    pool = spark.createDataFrame([("0", "gpb"), ("0", "js"), ("0", "gone")], "query_id string, doc_id string")
    scores = {r.doc_id: r.name_score for r in matcher.score_entities(pool, q).collect()}
    assert scores["gpb"] == pytest.approx(by["0"][0].score, abs=0.05) and scores["gone"] == 0


def test_rerank_features_and_order(spark, tmp_path):
    ents = bank_entities(spark)
    q = queries(spark, "Gazprombank ru")
    run = spark.createDataFrame([("0", "e4", 1.0, 1), ("0", "missing", 0.9, 2), ("0", "e1", 0.8, 3)], "query_id string, doc_id string, score double, rank long")
    rows = {r.doc_id: r for r in FeatureReranker().features(q, run, ents).collect()}
    assert set(rows) == {"e1", "e4"} and rows["e1"].coverage == 1 and rows["e1"].jaccard == pytest.approx(2 / 7) and rows["e1"].topic == 1
    assert rows["e1"].retriever_prior == pytest.approx(1 / 3) and rows["e4"].coverage == 0.5
    top = FeatureReranker().rerank(q, run, ents).orderBy("rank").collect()
    assert [r.doc_id for r in top] == ["e1", "e4"]
    f = rows["e1"]
    assert top[0].score == pytest.approx(sum(w * x for w, x in zip(DEFAULT_WEIGHTS, (f.coverage, f.jaccard, f.name_similarity, f.topic, f.retriever_prior), strict=True)))
    named = FeatureReranker(NameMatcher().index(ents)).features(q, run, ents).where("doc_id = 'e1'").first()
    assert 0.5 < named.name_similarity <= 1
    pairs = PairReranker(lambda: lambda qs, ts: [len(t) for t in ts]).rerank(q, run, ents)
    assert ids(pairs) == ["e4", "e1"] or ids(pairs) == ["e1", "e4"]
    assert load_weights(str(tmp_path / "none")) is None and get_reranker(learned=True).weights[0] == 0.4091
    assert ids(Hybrid(BM25().index(docs(spark)), None).search(q))[0] == "e1"


def test_fit_finds_the_feature_that_decides(spark):
    rng = np.random.default_rng(0)
    groups = [(x, int(x[:, 2].argmax())) for x in (rng.random((20, 5)) for _ in range(60))]
    w = fit(groups)
    assert int(np.argmax(w)) == 2
    names = ("coverage", "jaccard", "name_similarity", "topic", "retriever_prior")
    df = spark.createDataFrame([(g, bool(i == y), *map(float, r)) for g, (x, y) in enumerate(groups) for i, r in enumerate(x)], "query_id long, relevant boolean, " + ", ".join(f"{n} double" for n in names))
    near = [listwise_loss(df, w + d).first().loss for d in (np.zeros(5), np.eye(5)[0] * 0.3, -np.eye(5)[2] * 0.3)]
    assert near[0] < min(near[1:])
