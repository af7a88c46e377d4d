import json

from pyspark.sql import functions as F

from trawl.sources import records as rec
from trawl.streaming.ingest import ingest_stream

LINES = [
    {"id": "c1", "schema": "Company", "caption": "Alpha", "datasets": ["d1"], "properties": {"name": ["Alpha", "Alpha AO"], "country": [], "jurisdiction": ["ru"], "topics": ["sanction"], "secret": ["x"], "notes": "no list", "alias": [f"a{k}" for k in range(12)]}},
    {"id": "p1", "schema": "Person", "caption": "", "properties": {"birthDate": ["1958"]}},
    {"id": "r1", "schema": "Ownership", "properties": {"owner": ["p1"], "asset": ["c1"], "role": [""], "percentage": ["51"], "startDate": ["2001"], "other": ["y"]}},
    {"id": "r2", "schema": "Ownership", "caption": "half", "properties": {"owner": ["p1"]}},
    {"id": "a1", "schema": "Address", "properties": {}},
    {"schema": "Person"},
    {"id": "n1"},
]


def write(folder, *files):
    for k, lines in enumerate(files):
        (folder / f"f{k}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return [f"{folder}/f{k}.jsonl" for k in range(len(files))]


def test_reading_and_routing(spark, tmp_path):
    paths = write(tmp_path, [*LINES, "", '{"id": "cut'])
    found = rec.read_records(spark, *paths)
    assert sorted(r.id for r in found.collect()) == ["a1", "c1", "n1", "p1", "r1", "r2"]
    e = {r.id: r for r in rec.entities_of(found).collect()}
    assert sorted(e) == ["c1", "n1", "p1", "r2"]
    assert e["c1"].countries == ["ru"] and e["c1"].topics == ["sanction"] and e["c1"].datasets == ["d1"]
    assert e["c1"].search_text == "Alpha Alpha Alpha AO " + " ".join(f"a{k}" for k in range(8)) + " ru sanction"
    assert set(e["c1"].properties) == {"name", "country", "jurisdiction", "topics", "alias"} and len(e["c1"].properties["alias"]) == 12
    assert e["p1"].caption == "p1" and e["n1"].schema == "Thing" and e["p1"].search_text == "1958"
    r = rec.relations_of(found).collect()
    assert [(x.id, x.source_id, x.target_id, x.role) for x in r] == [("r1", "p1", "c1", "51")]
    assert set(r[0].properties) == {"role", "percentage", "startDate"}
    assert sorted(x.id for x in rec.entities_of(found, strict_edges=True).collect()) == ["c1", "n1", "p1"]
    assert rec.limited(found, 2).count() == 2


def test_store_upserts_and_lookups(spark, tmp_path):
    store = rec.Store(spark, str(tmp_path / "store"))
    store.init_schema()
    assert store.counts() == {"entities": 0, "relations": 0} and store.get("c1") is None
    first = write(tmp_path, LINES)
    assert rec.load(store, *first) == {"records": 6, "entities": 4, "relations": 1}
    (tmp_path / "f1.jsonl").write_text("\n".join(json.dumps(x) for x in [{"id": "c1", "schema": "Vessel", "caption": "Beta", "datasets": ["d9"], "properties": {}}, {"id": "c1", "schema": "X", "caption": "Gamma"}, {"id": "r1", "schema": "Family", "properties": {"person": ["q"], "relative": ["w"]}}]))
    rec.load(store, str(tmp_path / "f1.jsonl"))
    c1 = store.get("c1")
    assert (c1.caption, c1.search_text, c1.schema, c1.datasets) == ("Gamma", "Gamma", "Company", ["d1"])
    assert store.counts() == {"entities": 4, "relations": 1}
    assert [tuple(r) for r in store.neighbours("p1").collect()] == [("c1", "Ownership", "out")]
    assert [tuple(r) for r in store.neighbours("c1").collect()] == [("p1", "Ownership", "in")]


def test_streaming_files_reach_the_store_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = rec.Store(spark, str(tmp_path / "store"))
    write(inbox, LINES[:2])
    for _ in range(2):
        q = ingest_stream(spark, str(inbox), store, str(tmp_path / "checkpoint"))
        q.awaitTermination()
        assert q.exception() is None
    assert store.counts() == {"entities": 2, "relations": 0}
    (inbox / "g.jsonl").write_text("\n".join(json.dumps(x) for x in LINES[2:]))
    ingest_stream(spark, str(inbox), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.counts() == {"entities": 4, "relations": 1}


def test_decisions_last_line_counts(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(json.dumps({"key": "k", "query": "q", "match_id": m, "confidence": "high", "reason": ""}) for m in ("a", "b")))
    assert [r.match_id for r in rec.read_decisions(spark, str(tmp_path / "d.json")).collect()] == ["b"]
    both = rec.read_decisions(spark, str(tmp_path / "d.json")).where(F.col("key") == "k")
    rec.append_json(both, str(tmp_path / "out"))
    assert rec.read_decisions(spark, str(tmp_path / "out")).count() == 1
