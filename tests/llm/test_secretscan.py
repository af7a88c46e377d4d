import re

import pytest

from trawl.llm import secretscan as ss

HEX = "3f786850e387550fdab836ed7e6dc881de23001b"


@pytest.fixture(scope="module")
def model(spark):
    return ss.scanner(spark.createDataFrame([("some thenth text thenth",)], "text string"))


def test_forest_separates_findings_it_has_not_seen(spark, model):
    names = ss.features("cand", "before", "after", "path", model.dictionary)
    new = ss.labelled_findings(spark, 2000, seed=99)
    x = "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in names.items()) + ")"
    rows = new.selectExpr("label", f"{x} AS x").selectExpr("label", f"{model.votes} AS score").collect()
    right = sum((r.score >= 0.5) == (r.label == 1) for r in rows)
    assert right > 0.97 * len(rows) > 1500 and {r.label for r in rows} == {0, 1}


def test_findings_and_redaction(spark, model):
    text = f'Ünïcode first. token = "{HEX}" then commit {HEX} and https://mail5.example.com/a/b/page.html, internationalization-of-words {HEX}'
    rows = [(1, text, "src0"), (2, None, "src0"), (3, "", None), (4, "nothing here", "x"), (4, "nothing here", "x"), (None, f'{HEX}', None), (5, f'api_key: "{HEX}"', "x"), (6, f'api_key = "{"x" * 40}"', "x"),
            (7, (f'a b secret = "{HEX}" ' * 300), "x")]
    df = spark.createDataFrame([(a, b, c, "clash", 3) for a, b, c in rows], "doc_id long, text string, source string, found string, n_secrets int")
    got = ss.findings(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(s.start, s.secret) for s in by[1].secrets] == [(text.index(HEX), HEX)] and by[1].n_candidates == len(re.findall(r"[A-Za-z0-9_+/.\-]{16,}", text))
    assert by[2].n_candidates == by[2].n_secrets == by[3].n_secrets == by[6].n_secrets == 0 and by[2].secrets == []
    assert by[5].n_secrets == 1 and by[7].n_secrets == 300
    assert [s.start for s in by[7].secrets] == [m.start() for m in re.finditer(HEX, rows[8][1])]
    clean = {r.doc_id: r for r in ss.redacted(df, model).collect()}
    assert clean[1].text == text.replace(f'"{HEX}"', '"[SECRET]"') and clean[2].text is None and clean[3].text == "" and clean[1].found == "clash"
    assert clean[7].text == rows[8][1].replace(HEX, "[SECRET]")
    assert ss.redacted(df, model).columns == df.columns
    assert ss.findings(df.limit(0), model).count() == 0


def test_names_values_and_short_passwords(spark, model):
    texts = {
        f'AWS_SECRET_ACCESS_KEY = "{HEX}"': [HEX], f"client_secret={HEX}": [HEX], f"x AUTH_TOKEN={HEX}; y": [HEX], f"INTERNATIONAL_ORGANIZATION={HEX} is a commit": None,
        'password = "Xk7!pq2Zt"': ["Xk7!pq2Zt"], "the password is international": [], "key: value, token = x": [], 'TOKEN = "' + HEX.upper() + '"': [HEX.upper()],
        "secret=" + "QUJD" * 8 + "QQ== and more": None,  # of one pattern eight times over, so the forest may decide either way
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [s.secret for s in r.secrets] for r in ss.findings(df, model).collect()}
    for k, (text, want) in enumerate(texts.items()):
        assert want is None or got[k] == want, (text, got[k])
    found = {r.text: [(c.cand, c.before, c.after) for c in r.z] for r in ss.candidates(df).select("row.text", "z").collect()}
    assert [c for c, _, _ in found["secret=" + "QUJD" * 8 + "QQ== and more"]] == ["QUJD" * 8 + "QQ=="]
    assert found[f'AWS_SECRET_ACCESS_KEY = "{HEX}"'] == [("AWS_SECRET_ACCESS_KEY", "", f' = "{HEX}'[:32]), (HEX, 'AWS_SECRET_ACCESS_KEY = "', '"')]


def test_frequent_words_equal_a_count(spark):
    import collections

    texts = ["aaaa bbbb Bbbb cc", None, "", "bbbb-dddd dddd", "aaaa eeee x1yyyy"]
    counts = collections.Counter(w for t in texts if t for w in re.findall("[a-z]{4,}", t.lower()))
    want = tuple(sorted(counts, key=lambda w: (-counts[w], w))[:4])
    assert ss.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"), most=4) == want


def test_planted_secrets_of_the_documents_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {(r.doc_id, s) for r in docs.collect() for s in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    found = {(r.doc_id, s.secret) for r in ss.findings(docs).collect() for s in r.secrets}
    assert len(truth) > 5 and found == truth  # precision and recall are both 1


def test_no_python_in_the_plan(spark, model):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = ss.findings(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
