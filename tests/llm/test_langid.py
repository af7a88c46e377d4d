import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import langid

SAMPLE = {"en": "the house of the old man and this was that with all from".split(), "de": "das haus und der alte mann mit über schön nicht ein".split(), "fr": "la maison de le vieux homme avec été où très pour".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(SAMPLE[lang]) for _ in range(rng.randrange(3, 30))), lang) for k in range(n) for lang in [rng.choice(sorted(SAMPLE))]]


def test_only_letters_are_letters():
    model = langid.Model(["en"], {}, np.zeros((0, 1)), {}, np.zeros((0, 1)), np.zeros(1))
    for text in ("½ ²", "Ⅷ ⅓ ①", "12_3 — ₤", "٣", ""):
        assert model.predict(text) == ("und", 0.0)
    assert langid.words_of("A½b Ⅷé 漢字 ไทย É") == ["a", "b", "é", "漢字", "ไทย", "é"] and langid.words_of("a_1b") == ["a", "b"]


def brute_force(rows, langs, text):
    """The definition, without tables, parts or memory: all words and n-grams are known."""
    words, grams, prior = Counter(), Counter(), Counter(c for _, _, c in rows if c)
    for _, t, c in rows:
        for w in langid.words_of(t or "") if c else []:
            words[c, w] += 1
            grams.update((c, g) for g in langid.grams(w))
    vocabulary, seen = {w for _, w in words}, {g for _, g in grams}

    def log_of(counts, lang, name, like):
        own = {k: n for k, n in counts.items() if k[0] == lang and like(k[1])}
        return math.log((counts[lang, name] + langid.SMOOTH) / (sum(own.values()) + len(own) + langid.SMOOTH))

    scores = []
    for lang in langs:
        total = math.log(prior[lang] / sum(prior.values()))
        for w in langid.words_of(text):
            if w in vocabulary:
                total += log_of(words, lang, w, lambda _: True)
                continue
            for n in range(langid.LONGEST, 0, -1):
                known = [g for g in langid.grams(w) if len(g) == n and g in seen]
                if known:
                    total += sum(log_of(grams, lang, g, lambda x, n=n: len(x) == n) for g in known) / len(known)
                    break
        scores.append(total)
    return langs[scores.index(max(scores))], 1 / sum(math.exp(x - max(scores)) for x in scores)


def test_predictions_equal_brute_force(spark):
    rows = corpus(25, seed=8)
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text"))
    langs = sorted({c for _, _, c in rows})
    assert model.langs == langs
    for text in ("the haus maison", "thehaus unseenwords qqq", "schönes où x", "zzz", "hous mans avec", rows[0][1]):
        got, want = model.predict(text), brute_force(rows, langs, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-9)


def test_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 5)
    rows = [*corpus(60), (90, None, "en"), (91, "x", None), (92, "", "de"), (93, "Ärger 3x a_b É", "de"), (93, "Ärger 3x a_b É", "de"), (94, "q" * 90, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    words, grams = Counter(), Counter()
    for _, text, lang in rows:
        if text and lang:
            for w in langid.words_of(text):
                words[lang, w] += 1
                for g in langid.grams(w):
                    grams[lang, g] += 1
    counted = langid.word_counts(df)
    assert {(r.lang, r.word): r.n for r in counted.collect()} == words
    assert {(r.lang, r.gram): r.n for r in langid.gram_counts(counted).collect()} == grams


def test_known_words_then_shorter_and_shorter_grams():
    grams = {"<cat": [-5.0, -1.0], "cat>": [-3.0, -3.0], "at": [-9.0, -1.0], "z": [-2.0, -1.0]}
    model = langid.Model(["a", "b"], {"dog": 0}, np.array([[-1.0, -2.0]]), {g: k for k, g in enumerate(grams)}, np.array(list(grams.values())), np.zeros(2))
    assert model.scores_of(["cat", "bath", "zo", "qq"]).tolist() == [[-4, -2], [-9, -1], [-2, -1], [0, 0]]  # the mean of both of four letters; only one of two; a letter; none
    assert model.scores_of(["qq"]).tolist() == [[0, 0]]
    lang, score = model.predict("Dog dog")
    assert lang == "a" and score == pytest.approx(1 / (1 + math.exp(-2)))
    assert model.predict("qq")[0] == "a"  # a tie
    assert model.predict(None) == model.predict("12 _ !") == model.predict("") == ("und", 0.0)


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 10)
    rows = corpus(400)
    df = spark.createDataFrame([*((a, b, c, 1.0) for a, b, c in rows), (None, None, None, 0.0), (1000, "?", "en", 0.0), (1, "x" * 100_000, None, 0.0)], "doc_id long, text string, lang string, score double")
    held = langid.is_held_out(F.col("doc_id"))
    model = langid.learn(df.where(~held).select("lang", "text"))
    got = langid.predict(df, model).withColumn("held_out", held).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    truth = {a: c for a, _, c in rows}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) > 0.97 * len(tested) > 50
    assert {r.doc_id: r.lang_pred for r in got}[1000] == "und"
    nothing = langid.learn(df.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_long_runs_of_letters_teach_and_score_as_a_whole(spark):
    rows = [("en", "q" * 30 + "abcd" * 500 + "q" * 30), ("de", "q" * 30 + "wxyz" * 500 + "q" * 30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    counts = {(r.lang, r.gram): r.n for r in langid.gram_counts(langid.word_counts(df)).collect()}
    assert counts["en", "abcd"] == counts["de", "wxyz"] == 500
    model = langid.learn(df)
    assert model.predict("q" * 40 + "bcda" * 20_000 + "q" * 40)[0] == "en" and model.predict("q" * 40 + "xyzw" * 20_000 + "q" * 40)[0] == "de"
    assert not any(len(w) > langid.LONGEST_WORD for w in model.kept)


def test_a_rare_language_keeps_its_own_words_and_grams(spark):
    frequent = " ".join("".join(chr(97 + (k * 7 + j * (k % 5 + 1)) % 13) for j in range(5)) for k in range(60))
    df = spark.createDataFrame([("en", frequent)] * 50 + [("xx", "zyzz yzyy zzyz")], "lang string, text string")
    model = langid.learn(df, words=20, most_grams=40)
    assert {"zyzz", "yzyy", "zzyz"} <= set(model.words) and {"zyzz", "zy", "y"} & set(model.tables)
    assert any(set(w) - set("zy") for w in model.words) and len(model.words) <= 23
    assert model.predict("zyzz zzyzy")[0] == "xx"
