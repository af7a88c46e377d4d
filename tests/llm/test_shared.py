import os
import random

import pytest

from trawl.llm import shared


def components(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_random_graphs_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (1001, 1000), (1001, 1000)]
    rng.shuffle(edges)
    want = components({n for e in edges for n in e}, edges)
    for _ in range(70):
        want = {n: min([want[n], *(want[b] for a, b in edges if a == n), *(want[a] for a, b in edges if b == n)]) for n in want}
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(df).collect()}
    assert got == {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in edges)}
    assert shared.connected_components(df.limit(0)).count() == 0


class Session:
    """As much of a session as names its folder."""

    def __init__(self, master, runtime=None, static=None):
        self.conf = self
        self.sparkContext, self.master, self.runtime, self.static = self, master, runtime, static

    def getConf(self):
        return {"spark.checkpoint.dir": self.static} if self.static else {}

    def get(self, key, default=None):
        return self.runtime or default


def test_the_shared_folder_is_the_one_that_the_session_names():
    assert shared.shared_dir(Session("local[4]")) == shared.LOCAL_DEFAULT
    assert shared.shared_dir(Session("spark://x", static="hdfs://y/z/")) == "hdfs://y/z"
    assert shared.shared_dir(Session("local[2]", "file:///a", "b")) == "file:///a"
    for master in ("spark://x", "local-cluster[3,2,100]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(master))


def test_tables_lie_in_the_shared_folder_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(shared, "_made", [])
    made = shared.written(spark.range(5).toDF("x"), "tag")
    assert made.count() == 5 and len(os.listdir(tmp_path / "shared")) == 1
    shared.dropped(made)
    assert os.listdir(tmp_path / "shared") == []
    shared.written(spark.range(0).toDF("x"), "tag")
    shared.release(spark)
    assert os.listdir(tmp_path / "shared") == []


def test_few_edges_take_one_task_and_have_the_same_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k + 1, k) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 1), (-7, 1200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {r.node: r.component for r in shared.connected_components(df).collect()}
    for most in (10_000, 300, 1):  # the last two begin with rounds
        got = shared.connected_components(df, alone=most).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert shared.connected_components(df.limit(0), alone=10).count() == 0
    names = df.selectExpr("CAST(a AS STRING) AS a", "CAST(b AS STRING) AS b")
    assert shared.connected_components(names, alone=10_000).count() == len(want)
