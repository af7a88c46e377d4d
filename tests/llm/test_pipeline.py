"""The stages on the smallest tables, each against a plain version on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest
from test_simhash_similar import slow_set
from tokenizers import Tokenizer

import corpus_pipeline
from trawl.llm import cotraining
from trawl.llm.entry import oracle_sql, queries
from trawl.llm.shared import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), "test"))
    return docs


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing to target weights", "packing"]
    assert all(d.columns == steps[0].columns for d in steps[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_scores_high(spark, steps):
    model, features = cotraining.train(steps[0], table(spark, SF, "labels"))
    keep = {r.doc_id for r in cotraining.scored(features, model).collect() if r.keep}
    assert {r["doc_id"] for r in rows(steps[1])} == keep and 0 < len(keep) < steps[0].count()
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([(k in keep) == (q == 1) for k, q in truth.items()]) > 0.95


def test_near_duplicates_against_all_pairs(steps):
    docs = rows(steps[1])
    sets = [slow_set(d["text"]) for d in docs]
    n, label = len(docs), list(range(len(docs)))
    linked = [[j for j in range(n) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    want = {min(docs[i]["doc_id"] for i in range(n) if label[i] == g) for g in set(label)}
    assert {r["doc_id"] for r in rows(steps[2])} == want


def test_secrets_are_replaced_and_nothing_else(steps):
    before, after = {r["doc_id"]: r for r in rows(steps[2])}, {r["doc_id"]: r for r in rows(steps[3])}
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert after[k]["text"] == re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r["text"]) and after[k]["n_chars"] == len(after[k]["text"])


def test_mix_and_packing_account_for_every_word_and_id(steps):
    import collections

    from trawl.llm import mixing

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {r.doc_id: r.taken for r in mixing.mix(steps[3]).collect()}
    words = collections.Counter()
    for r in rows(steps[4]):
        words[r["doc_id"]] += count(r["text"])
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows(steps[4]))
    assert sum(r["length"] for r in rows(steps[5])) == ids


def test_entry_names_and_sql():
    found = queries()
    assert [n for n in sorted(found) if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in found and set(oracle_sql()) <= set(found)


def test_odd_rows_further_columns_and_empty_tables(spark, tmp_path):
    secret = "0123456789abcdef0123456789abcdef01234567"
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "a", 5, "x"), (2, text + " more", "en", "a", 5, "y"), (3, None, None, None, None, None), (4, "", "en", None, 0, "x"), (None, f'it says token = "{secret}" here', None, "b", 9, "x"), (1, "another text of the same id", "de", "b", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], str(tmp_path)), "test"))
    assert all(d.columns == docs.columns for d in steps[:5]) and steps[1].count() == len(rows)
    kept = sorted((str(r.doc_id), r.text or "") for r in steps[2].collect())
    assert kept == sorted([("1", text), ("3", ""), ("None", rows[4][1]), ("1", rows[5][1])])
    assert [r.text for r in steps[3].where("doc_id IS NULL").collect()] == ['it says token = "[SECRET]" here']
    assert {r.score for r in steps[4].collect()} <= {"x", None} and steps[5].count() >= steps[4].count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
