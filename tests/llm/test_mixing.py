import hashlib
import re

import duckdb
import pytest

from trawl.llm import mixing, q_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, share=1.5, most=2):
    """taken by row number, from (doc_id, source, text), by plain resharing and a sort."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, rest = {}, set(sources), share * sum(sizes)
    while True:
        given = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if given[s] > most * own[s]}
        if not above:
            target |= given
            break
        for s in above:
            target[s] = most * own[s]
        rest -= sum(target[s] for s in above)
        free -= above
        if not free:
            break
    hashes = [int(hashlib.md5(f"0/{'null' if d is None else d}".encode()).hexdigest()[:15], 16) for d, _, _ in rows]
    taken = [0] * len(rows)
    for s in sources:
        budget = int(target[s] + 0.5)
        copies = budget // own[s] if own[s] else 0
        left = budget - copies * own[s]
        mine = [k for k, r in enumerate(rows) if r[1] == s]
        for h in sorted({hashes[k] for k in mine}):
            same = [k for k in mine if hashes[k] == h]
            total = sum(sizes[k] for k in same)
            for k in same:
                taken[k] = copies * sizes[k] + (sizes[k] if total <= left else sizes[k] * left // total if total else 0)
            left -= min(left, total)
    return sizes, own, target, taken


ROWS = [
    (k, s, " ".join(["w"] * ((k * 7919) % 40)) if k % 11 else None) for k in range(300) for s in [("a", "b", "c", None, "é", "hot")[k % 6 if k % 3 else 5]]
] + [(7, "a", "same id again"), (7, "a", "same id again"), (None, None, "no id x\x1cy z"), (900, "empty", ""), (901, "one", "x " * 3000)]


def test_against_a_sort(spark):
    df = spark.createDataFrame([(a, b, c, "clash", 0) for a, b, c in ROWS], "doc_id long, source string, text string, size string, target int").repartition(3)
    sizes, own, target, taken = slow(ROWS)
    got = sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect())
    assert got == sorted((str(d), sizes[k], own[s], round(target[s], 6), taken[k]) for k, (d, s, _) in enumerate(ROWS))
    for s in own:
        assert abs(sum(t for t, r in zip(taken, ROWS, strict=True) if r[1] == s) - target[s]) <= 3
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(WORD.findall(r.text or ""))
    want = {}
    for k, (d, s, _) in enumerate(ROWS):
        want[d, s] = want.get((d, s), 0) + taken[k]
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in words.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.mixed_documents(df.limit(0)).count()


@pytest.mark.parametrize("share, most", [(0.5, 2), (2.0, 2), (1.0, 1)])
def test_other_shares(spark, share, most):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    _, _, _, taken = slow(ROWS, share, most)
    assert sum(r.taken for r in mixing.mix(df, share, most).collect()) == sum(taken)


def test_registered_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, q_mixing.op5_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert got == sorted(db.execute(q_mixing.SQL).fetchall())
    plan = q_mixing.op5_mix(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
