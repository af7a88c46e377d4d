import json
import os
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from fixtures import entities, entity, queries, relations
from pyspark.sql import functions as F

from trawl import cli
from trawl.http import Refused, handler, respond
from trawl.operators.dense import LSAEncoder
from trawl.plans import adjudicate, agent, answer, evaluate, export, observability, tools
from trawl.plans.pipeline import Pipeline
from trawl.plans.training import train
from trawl.sources.records import Store


@pytest.fixture(scope="module")
def pipeline(spark):
    rows = [
        entity("A1", "Alpha Bank", alias=["AO Alpha"], registrationNumber=["123"], text="Alpha Bank AO Alpha ru sanction"),
        entity("B2", "Beta Holding", countries=["cy"], text="Beta Holding cy"),
        entity("C3", "Gamma Shipping LLC", text="Gamma Shipping LLC ru sanction"),
        entity("D4", "Rosneft Trading", "Organization", text="Rosneft Trading ch oil"),
        entity("P5", "Ivan Petrov", "Person", birthDate=["1958"], alias=["Petrov Ivan", "Vanya"], text="Ivan Petrov 1958 ru"),
    ]
    rel = relations(spark, ("r1", "Ownership", "B2", "A1", {"percentage": ["51"]}), ("r2", "Directorship", "P5", "B2"))
    return Pipeline(entities(spark, *rows).cache(), rel.cache(), encoder=LSAEncoder(dim=4, min_df=1))


def test_search_expands_and_hydrates(pipeline):
    top = pipeline.hits(pipeline.search("Alfa Bank", k=2)).collect()
    assert top[0].id == "A1" and [r.rank for r in top] == [1, 2]
    more = pipeline.search("Alpha Bank", k=1, expand=True).orderBy("rank").collect()
    assert [r.doc_id for r in more] == ["A1", "B2"] and more[1].score == pytest.approx(0.45 * more[0].score)
    both = pipeline.search(pipeline.queries("Rosneft", "Petrov"), k=1).orderBy("query_id").collect()
    assert [r.doc_id for r in both] == ["D4", "P5"]


def test_plan():
    subs = agent.plan("Which Russian banks are sanctioned and who owns them?")
    assert not any(s.lower().startswith("which") for s in subs) and any("Russian" in s for s in subs)
    assert "Gazprombank Joint Stock Company" in agent.plan('Who owns "Gazprombank Joint Stock Company"?')
    assert len(agent.plan("A B C D E F G H I J K L")) <= 4 and agent.plan("") == []
    assert agent.plan('"Acme Corp" and acme corp, Acme Corp')[0] == "Acme Corp"


def test_critique(spark):
    cases = [
        ([], ["Gazprombank"], (False, "no evidence retrieved", [])),
        (["Gazprombank"], ["Gazprombank", "Rosneft"], (False, "no evidence for: Rosneft", ["Rosneft"])),
        (["x"], ["aaaa", "bbbb", "cccc", "dddd"], (False, "no evidence for: aaaa, bbbb, cccc", ["aaaa", "bbbb"])),
        (["Gazprombank"], ["big Gazprombank"], (False, "thin evidence (<3 entities)", ["big Gazprombank"])),
        (["Gazprombank", "ROSNEFT holding", "Transneft group"], ["Gazprombank", "the rosneft"], (True, "all sub-questions have supporting evidence", [])),
        (["a", "b", "c"], [], (True, "all sub-questions have supporting evidence", [])),
        (["of x", "b", "c"], ["of"], (False, "no evidence for: of", ["of"])),
    ]
    df = spark.createDataFrame([(k, c, q) for k, (c, q, _) in enumerate(cases)], "k int, captions array<string>, subqueries array<string>")
    got = {r.k: (r.v.enough, r.v.reason, list(r.v.next)) for r in df.select("k", agent.critique(F.col("subqueries"), F.col("captions")).alias("v")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_investigate_and_link(pipeline):
    report = agent.investigate(pipeline, "Who owns Alpha Bank and what about Rosneft Trading?")
    assert {"A1", "D4"} <= {e["id"] for e in report["evidence"]} and "[A1]" in report["report"]
    assert report["trace"][0]["kind"] == "plan" and report["iterations"] >= 1 and report["stopped_because"]
    assert {"search", "critique"} <= {s["kind"] for s in report["trace"]} and json.dumps(report)
    found = agent.link(pipeline, "Ivan Petrov", "Alpha Bank")
    assert found["found"] and [p["id"] for p in found["path"]] == ["P5", "B2", "A1"] and found["hops"] == 2
    assert found["path"][0]["caption"] == "Ivan Petrov"
    assert agent.link(pipeline, "Ivan Petrov", "Rosneft Trading") == {"found": False, "reason": "no path within 3 hops", "from": "P5", "to": "D4"}


def test_answers(pipeline, spark):
    q = queries(spark, "alpha", "nothing")
    run = spark.createDataFrame([("0", "gone", 1.0, 1), ("0", "A1", 0.9, 2), ("0", "D4", 0.8, 3)], "query_id string, doc_id string, score double, rank long")
    texts = {r.query_id: r.text for r in answer.answer(q, run, pipeline.entities, 2).collect()}
    assert texts["0"] == "1 candidate entities for: alpha\n- Alpha Bank (Company; ru; sanction) — listed in test [A1]"
    assert texts["1"] == answer.NOTHING
    made = {r.query_id: (r.text, r.generator) for r in answer.answer(q, run, pipeline.entities, 3, lambda question, rows: f"{question}:{len(rows)}" if len(rows) else None).collect()}
    assert made["0"] == ("alpha:2", "model") and made["1"][1] == "extractive"


def test_tools(pipeline):
    box = tools.Ledger(pipeline)
    hits = box.call("search_entities", {"query": "Alpha Bank", "k": 500})["records"]
    assert hits[0]["id"] == "A1" and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert box.call("get_entity", {"entity_id": "nope"}) == {"records": [], "note": "no entity has this id"}
    assert box.call("get_entity", {"entity_id": "P5"})["records"][0]["properties"]["birthDate"] == ["1958"]
    near = box.call("get_neighbours", {"entity_id": "B2"})["records"]
    assert [(n["id"], n["relation"], n["direction"]) for n in near] == [("A1", "Ownership", "out"), ("P5", "Directorship", "in")]
    assert len(box.call("get_neighbours", {"entity_id": "B2", "most": 1})["records"]) == 1
    assert [p["id"] for p in box.call("find_path", {"from_id": "P5", "to_id": "A1"})["records"]] == ["P5", "B2", "A1"]
    assert "note" in box.call("find_path", {"from_id": "P5", "to_id": "D4", "max_hops": 99})
    assert "no such tool" in box.call("rm")["error"] and "missing: entity_id" in box.call("get_entity", {})["error"] and "error" in box.call("search_entities", {"query": "x", "k": "many"})
    assert {"A1", "B2", "P5"} <= set(box.shown) and len(box.calls) == 10
    assert tools.TOOLS["find_path"].schema()["required"] == ["from_id", "to_id"] and tools.TOOLS["search_entities"].schema()["properties"]["k"]["maximum"] == 20
    steps = iter([{"name": "get_neighbours", "arguments": {"entity_id": "B2"}}, {"name": "rm", "arguments": {}}, {"text": "Owns [A1], see [P5x] and [Q99]."}])
    out = tools.investigate(pipeline, "?", lambda q, m: next(steps))
    assert out["supported"] == [] and out["unsupported"] == ["P5x", "Q99"] and [c["hits"] for c in out["calls"]] == [2, 0] and out["finished"]
    endless = tools.investigate(pipeline, "?", lambda q, m: {"name": "get_entity", "arguments": {"entity_id": "A1"}}, most=2)
    assert not endless["finished"] and len(endless["calls"]) == 2


def test_adjudication(pipeline, spark):
    run = spark.createDataFrame([("0", "A1", 0.9, 1), ("0", "B2", 0.89, 2), ("0", "C3", 0.1, 3), ("1", "D4", 0.9, 1), ("1", "A1", 0.3, 2), ("2", "P5", 0.5, 1)], "query_id string, doc_id string, score double, rank long")
    q = spark.createDataFrame([("0", "beta", "alias"), ("1", "ros", "noisy"), ("2", "ivan", "noisy")], "query_id string, query string, family string")
    asked = adjudicate.keyed(adjudicate.prompts(q, run, pipeline.entities), "m")
    p = {r.query_id: r for r in asked.collect()}
    assert p["0"].prompt.startswith("QUERY: beta\n\nCANDIDATES (in retrieval order):\n[1] Alpha Bank | type=Company | countries=ru | aliases=AO Alpha | registrationNumber=123 | lists=test\n[2] Beta")
    cache = spark.createDataFrame([(p["0"].key, "beta", "B2", "high", "same")], "key string, query string, match_id string, confidence string, reason string")
    d = adjudicate.judged(asked, cache, lambda prompt: {"match": 2, "confidence": "low"} if "ros" in prompt else {"match": 0})
    got = {r.query_id: r for r in d.collect()}
    assert got["0"].cached and got["0"].match_id == "B2" and got["1"].match_id == "A1" and got["2"].match_id is None
    assert {r.match_id for r in adjudicate.judged(asked, cache).collect()} == {"B2", None}
    after = [(r.query_id, r.doc_id) for r in adjudicate.apply(run, d).orderBy("query_id", "rank").collect()]
    assert after == [("0", "B2"), ("0", "A1"), ("0", "C3"), ("1", "A1"), ("1", "D4"), ("2", "P5")]
    qrels = spark.createDataFrame([("0", "B2"), ("1", "D4"), ("2", "P5")], "query_id string, doc_id string")
    rows = {r.margin: r for r in adjudicate.sweep(run, d, qrels, q).collect()}
    assert (rows[0.02].calls, rows[0.02].recall_1) == (1, 1.0) and (rows[float("inf")].calls, rows[float("inf")].recall_1, rows[float("inf")].mrr_10) == (3, 0.667, 0.833)
    done = adjudicate.outcome(run, d, qrels, q)
    s = {r.family: r for r in adjudicate.summary(done).collect()}
    assert (s[None].fixed, s[None].broke, s[None].abstained, s[None].picked_wrong, s["noisy"].share_before, s["noisy"].share_after) == (1, 1, 1, 1, 1.0, 0.5)
    assert {(r.confidence, r.right, r.picked) for r in adjudicate.by_confidence(done).collect()} == {("high", 1, 1), ("low", 0, 1)}
    assert adjudicate.coverage(run, qrels) == 3


BASE = {"primary": "hybrid+rerank", "overall": {"bm25": {"recall@10": 0.85}, "hybrid+rerank": {"recall@10": 0.907}}}


@pytest.mark.parametrize(("bm25", "best", "want"), [
    (0.85, 0.907, []), (0.845, 0.9, []), (None, 0.907, ["bm25: missing from results"]),
    (0.85, 0.82, ["hybrid+rerank is no longer the best system by recall@10", "hybrid+rerank.recall@10: 0.820 < 0.907 - 0.02"]),
    (0.95, 0.9, ["hybrid+rerank is no longer the best system by recall@10"]),
])
def test_gate(spark, bm25, best, want):
    found = {"overall": {k: {"recall@10": v} for k, v in (("bm25", bm25), ("hybrid+rerank", best)) if v is not None}}
    assert sorted(r.failure for r in evaluate.gate(evaluate.long(spark, found), evaluate.long(spark, BASE)).collect()) == want


def test_evaluation_training_and_labelled_queries(pipeline, spark, tmp_path):
    labelled = evaluate.build_queries(pipeline.entities, 5)
    rows = labelled.collect()
    assert {r.family for r in rows} == {"alias", "partial", "attribute", "noisy"}
    assert [r.id for r in sorted(rows, key=lambda r: r.id[-4:])] == [f"{r.family}-{k:04d}" for k, r in enumerate(sorted(rows, key=lambda r: r.id[-4:]))]
    assert all(len(r.query) >= 4 and len(r.relevant) == 1 for r in rows)
    assert sorted(map(tuple, evaluate.build_queries(pipeline.entities, 5).select("id", "query").collect())) == sorted((r.id, r.query) for r in rows)
    assert "A1" not in {x for r in evaluate.build_queries(pipeline.entities, 5, exclude=pipeline.entities.where("id = 'A1'")).collect() for x in r.relevant}
    out = evaluate.run(pipeline, labelled, path=str(tmp_path / "r.json"))
    assert list(out["overall"]) == ["bm25", "vector", "hybrid-rrf", "hybrid+rerank", "names", "hybrid+names+rerank"]
    assert all(0 <= v <= 1 for m in out["overall"].values() for v in m.values()) and out["overall"]["hybrid+names+rerank"]["recall@5"] == 1
    assert evaluate.as_table(spark, out).count("\n") == 7 and json.loads((tmp_path / "r.json").read_text())["queries"] == len(rows)
    few = spark.createDataFrame([("t", "alias", "x", ["D4"], "")], "id string, family string, query string, relevant array<string>, entity_caption string")
    fitted = train(pipeline, few, per_family=3, pool=5, path=str(tmp_path / "w.json"))
    assert fitted["used"] + fitted["not_in_pool"] == fitted["train_queries"] > 5 and abs(sum(map(abs, fitted["weights"].values())) - 1) < 1e-3


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("0", "f"), ("1", "g")], "query_id string, family string")
    runs = spark.createDataFrame([("s", "0", "b", 1), ("s", "0", "a", 3), ("s", "1", "x", 1)], "system string, query_id string, doc_id string, rank long")
    rel = spark.createDataFrame([("0", "a"), ("1", "y")], "query_id string, doc_id string")
    rows = {r.family: r for r in evaluate.means(evaluate.per_query(runs, rel, q)).collect()}
    assert rows["f"]["mrr@10"] == 0.333 and rows["f"]["ndcg@10"] == 0.5 and rows["f"]["recall@1"] == 0 and rows["f"]["recall@5"] == 1
    assert rows[None]["recall@5"] == 0.5 and rows["g"]["mrr@10"] == 0


def test_observability(spark):
    m = observability.Registry()
    m.count("stage", stage='x "y"')
    m.count("stage", stage='x "y"')
    for seconds in (0.01, 0.012, 99):
        m.time("x", seconds)
    lines = m.exposition().splitlines()
    assert 'trawl_stage_total{stage="x \\"y\\""} 2' in lines and "# TYPE trawl_stage_total counter" in lines and "# TYPE trawl_x_seconds histogram" in lines
    assert "trawl_x_seconds_count 3" in lines and "trawl_x_seconds_sum 99.022000" in lines
    assert [x.rpartition(" ")[2] for x in lines if "_bucket" in x] == ["0", "1", "2", "2", "2", "2", "2", "2", "2", "2", "3"] and lines[-1].startswith('trawl_x_seconds_bucket{le="+Inf"}')
    before = observability.REGISTRY.value("stage", stage="y", outcome="failed")
    with pytest.raises(KeyError), observability.Timed("y"):
        raise KeyError
    assert observability.REGISTRY.value("stage", stage="y", outcome="failed") == before + 1
    import logging

    observability.begin_request("r1")
    record = logging.makeLogRecord({"name": "n", "levelname": "INFO", "msg": "m %s", "args": (1,), "k": {"é": 1}})
    observability.OfRequest().filter(record)
    line = json.loads(observability.JsonLines().format(record))
    assert (line["message"], line["request_id"], line["k"], line["level"]) == ("m 1", "r1", {"é": 1}, "INFO") and len(observability.begin_request()) == 12
    h = observability.histogram(spark.createDataFrame([("a", 0.01), ("a", 9.0)], "k string, v double"), "k", "v").first()
    assert (h.n, h.total, h.buckets[1], h.buckets[-1]) == (2, 9.01, 1, 1)


def test_vault(spark, tmp_path):
    rows = [entity("e1", "Alpha Bank", topics=["sanction"], datasets=["us_ofac_sdn"], alias=["AO Alpha"], registrationNumber=["1|2", "3"]), entity("e2", "Alpha/Beta: Holding?", countries=["cy"], topics=[], datasets=["gb"]), entity("e3", "Lonely Person", "Person", countries=[], topics=[], datasets=[])]
    ents, rel = entities(spark, *rows), relations(spark, ("r1", "Ownership", "e2", "e1", {"percentage": ["51"]}))
    out = str(tmp_path / "vault")
    assert export.export(ents, rel, out) == {"notes": 2, "relations": 1}
    one = (tmp_path / "vault/Entities/Company/Alpha Bank.md").read_text()
    assert "- owned by [[Alpha Beta Holding]] (51)" in one and "| registrationNumber | 1/2; 3 |" in one and 'aliases: ["AO Alpha"]' in one and "**Also listed as:** AO Alpha" in one
    assert 'tags: ["schema/company", "topic/sanction", "list/us_ofac_sdn"]' in one
    assert "- owns [[Alpha Bank]] (51)" in (tmp_path / "vault/Entities/Company/Alpha Beta Holding.md").read_text()
    assert "[[Alpha Bank]] (1 links)" in (tmp_path / "vault/Index.md").read_text()
    (tmp_path / "vault/.obsidian/graph.json").write_text("mine")
    assert export.export(ents, rel, out, "all") == {"notes": 3, "relations": 1} and (tmp_path / "vault/.obsidian/graph.json").read_text() == "mine"
    names = {r.id: r.name for r in export.note_names(entities(spark, entity("id-000001", "Same"), entity("id-000002", "same"), entity("x", "Other"))).collect()}
    assert names == {"id-000001": "Same (000001)", "id-000002": "same (000002)", "x": "Other"}
    os.makedirs(tmp_path / "own/Entities")
    with pytest.raises(SystemExit):
        export.export(ents, rel, str(tmp_path / "own"))


def test_cli(spark, tmp_path, capsys, pipeline):
    db = str(tmp_path / "store")
    lines = [{"id": "a", "schema": "Company", "caption": "Alpha Bank", "datasets": ["d"], "properties": {"name": ["Alpha Bank"], "alias": ["AO Alpha"], "country": ["ru"]}}, {"id": "b", "schema": "Company", "caption": "Beta Alpha Holding", "properties": {}}, {"id": "r", "schema": "Ownership", "properties": {"owner": ["b"], "asset": ["a"]}}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))

    def run(*argv):
        assert cli.main(["--db", db, *argv], spark) == 0
        return capsys.readouterr().out

    assert json.loads(run("ingest", str(tmp_path / "x.jsonl")))["entities"] == 2
    assert "Alpha Bank" in run("search", "alpha bank", "-k", "1") and "AO Alpha" in run("match", "ao alpha") and "[a]" in run("ask", "alpha bank")
    assert json.loads(run("link", "alpha bank", "beta alpha holding"))["hops"] == 1
    assert "2 notes" in run("export-vault", "--out", str(tmp_path / "v"), "--seed", "a", "--hops", "1")
    assert "queries" in run("build-eval", "--out", str(tmp_path / "q"))
    for name, data in (("r.json", {"overall": {"bm25": {"recall@10": 0.5}}}), ("b.json", {"primary": "bm25", "overall": {"bm25": {"recall@10": 0.9}}})):
        (tmp_path / name).write_text(json.dumps(data))
    assert cli.main(["gate", "--results", str(tmp_path / "r.json"), "--baseline", str(tmp_path / "b.json")], spark) == 1
    assert cli.main(["gate", "--results", str(tmp_path / "r.json"), "--baseline", str(tmp_path / "r.json")], spark) == 1  # another primary
    assert Store(spark, db).counts() == {"entities": 2, "relations": 1}


def test_http(pipeline):
    assert respond(pipeline, "GET", "/health", {}) == {"status": "ok", "entities": 5, "relations": 2}
    assert respond(pipeline, "GET", "/entity/A1", {})["neighbours"] == [{"id": "B2", "caption": "Beta Holding", "relation": "Ownership", "direction": "in"}]
    for method, path, given, status in (("GET", "/entity/none", {}, 404), ("GET", "/search", {"q": "a"}, 422), ("GET", "/search", {"q": "ab", "k": "99"}, 422), ("POST", "/investigate", {"question": "abc", "engine": "x"}, 422), ("GET", "/nope", {}, 404)):
        with pytest.raises(Refused) as e:
            respond(pipeline, method, path, given)
        assert e.value.status == status
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(pipeline))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(f"{at}/search?q=Alpha%20Bank&k=1&expand=true") as r:
        assert [x["id"] for x in json.load(r)] == ["A1", "B2"] and r.headers["x-request-id"]
    with urllib.request.urlopen(urllib.request.Request(f"{at}/ask", json.dumps({"question": "Alpha Bank", "k": 1}).encode())) as r:
        assert "[A1]" in json.load(r)["answer"]
    with urllib.request.urlopen(f"{at}/metrics") as r:
        assert b"http_request" in r.read()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/entity/none")
    server.shutdown()
