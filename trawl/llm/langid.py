"""Language identification: words first, then ever shorter character n-grams.

Learning counts the words of every language over all labelled texts, and from
those word counts the character n-grams (1 to ``LONGEST`` letters, with word
borders). The model keeps ``WORDS`` words and ``GRAMS`` n-grams, shared out equally:
of each language its own most frequent ones, so that frequent languages never
crowd out a rare one. Both bounds are parameters, and fix the size of what is
broadcast; what lies beyond them is scored as unseen.

A known word scores its smoothed log frequency in each language. An unseen word
scores the mean of its known n-grams of the greatest length that has any; only if
no n-gram of that length is known, the next shorter length is tried, down to
single letters. A text's score is the sum over its words; the prediction is the
best language, ties going to the smaller name, and its score the posterior
probability under the languages' shares of the learned texts.

Words are maximal runs of letters (of any script; numbers such as fractions are
none), in lower case; texts are read whole.

Nulls, empty and odd input: null or letterless text gives ``und`` with score 0,
and so does everything if nothing could be learned; rows with a null language
teach nothing; a null id hashes as an empty name; repeated rows count each; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import schema_of, written

#: The words and n-grams that the model keeps, shared out equally to the languages; letters of the longest n-gram.
WORDS, GRAMS, LONGEST = 200_000, 100_000, 4
#: Runs of letters longer than this are never kept or remembered as words: all their n-grams teach and score, so many at once.
LONGEST_WORD, PART = 40, 16_384
#: Unseen words that a worker remembers, and counters that a task holds before it hands them on.
REMEMBERED, HELD = 400_000, 400_000
SMOOTH = 0.5
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case. The pattern also takes numbers that are no digits, such as
    fractions and Roman numerals: the few runs that have some are cut there."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def word_counts(labelled: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``lang, text``; counted within each task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > HELD:
                yield table(counts)
                counts = {}
        yield table(counts)

    def table(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    some = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    return some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counted: DataFrame) -> DataFrame:
    """``lang, gram, n``: the n-grams of the words, with their borders, as often as the words occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = counts.setdefault(lang, Counter())
                for gram in grams(word):
                    own[gram] += n
                    if len(own) > HELD:
                        yield table(counts)
                        counts = {}
                        own = counts.setdefault(lang, Counter())
            if sum(map(len, counts.values())) > HELD:
                yield table(counts)
                counts = {}
        yield table(counts)

    def table(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, gram, n) for lang, c in counts.items() for gram, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "gram", "n"])

    return counted.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grams(word: str) -> Iterator[str]:
    """All n-grams of a word, single letters without the borders."""
    yield from word
    edged = f"<{word}>"
    for n in range(2, LONGEST + 1):
        for k in range(len(edged) - n + 1):
            yield edged[k : k + n]


class Model:
    """Log frequencies: ``words`` and ``tables`` (n-grams) give rows of the matrices, which have a column for each language."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, tables: dict[str, int], gram_rows: np.ndarray, prior: np.ndarray):
        self.langs, self.words, self.word_rows, self.tables, self.gram_rows, self.prior = langs, words, word_rows, tables, gram_rows, prior
        self.forget()

    def __reduce__(self):
        return Model, (self.langs, self.words, self.word_rows, self.tables, self.gram_rows, self.prior)

    def forget(self) -> None:
        """Empties the memory of unseen words; known words are its first rows."""
        self.kept, self.rows = dict(self.words), self.word_rows

    def longest_known(self, word: str) -> list[int]:
        """Rows of the word's known n-grams of the greatest length that has any."""
        edged, known = f"<{word}>", self.tables
        for n in range(LONGEST, 1, -1):
            if found := [known[g] for g in (edged[k : k + n] for k in range(len(edged) - n + 1)) if g in known]:
                return found
        return [known[g] for g in word if g in known]

    def score_of_run(self, word: str) -> np.ndarray:
        """The score of an unseen word of any length, its n-grams taken in parts."""
        known, edged = self.tables, f"<{word}>"
        for n in range(LONGEST, 0, -1):
            run, total, count = edged if n > 1 else word, np.zeros(len(self.langs)), 0
            for at in range(0, len(run) - n + 1, PART):
                if found := [known[g] for g in (run[k : k + n] for k in range(at, min(at + PART, len(run) - n + 1))) if g in known]:
                    total, count = total + self.gram_rows[found].sum(0), count + len(found)
            if count:
                return total / count
        return np.zeros(len(self.langs))

    def scores_of(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words, a row each."""
        found = [self.longest_known(w) for w in words]
        sizes = np.array([len(x) for x in found])
        out = np.zeros((len(words), len(self.langs)))
        some = sizes > 0
        if some.any():
            flat = np.fromiter((k for x in found for k in x), np.int64, int(sizes.sum()))
            out[some] = np.add.reduceat(self.gram_rows[flat], (sizes.cumsum() - sizes)[some]) / sizes[some, None]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else []
        if not found or not self.langs:
            return "und", 0.0
        if len(self.kept) > len(self.words) + REMEMBERED:
            self.forget()
        kept, runs = self.kept, np.zeros(len(self.langs))
        if max(map(len, found)) > LONGEST_WORD:
            for w in found:
                if len(w) > LONGEST_WORD:
                    runs = runs + self.score_of_run(w)
            found = [w for w in found if len(w) <= LONGEST_WORD]
        if new := list(set(found).difference(kept)):
            size = len(kept)
            if size + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:size], np.zeros((max(4096, size // 2, len(new)), len(self.langs)))])
            self.rows[size : size + len(new)] = self.scores_of(new)
            kept.update(zip(new, range(size, size + len(new)), strict=True))
        total = self.rows[np.fromiter(map(kept.__getitem__, found), np.int64, len(found))].sum(0) + runs + self.prior
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def most_of_each(df: DataFrame, name: str, quota: int) -> DataFrame:
    """The names that are among the ``quota`` most frequent of any language (rows ``lang, name, n``). The step of a
    histogram in which a quota ends is taken in part, by hash. Nothing is sorted, and no task gathers candidates."""
    step, parts = F.floor(F.log2("n") * 32), 1 << 20
    left, floors = {}, {}
    for r in sorted(df.groupBy("lang", step.alias("step")).count().collect(), key=lambda r: (r.lang, -r.step)):
        room = left.setdefault(r.lang, quota)
        if room > 0:
            floors[r.lang] = (r.lang, r.step, min(parts, -(-parts * room // r["count"])))
        left[r.lang] = room - r["count"]
    spark = df.sparkSession
    bounds = F.broadcast(spark.createDataFrame(list(floors.values()), "lang string, floor long, share long"))
    near = (step > F.col("floor")) | ((step == F.col("floor")) & (F.pmod(F.xxhash64(name), F.lit(parts)) < F.col("share")))
    return df.join(bounds, "lang").where(near).select(name).distinct()


def learn(labelled: DataFrame, words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """The model of all rows of ``lang, text``."""
    counted = written(word_counts(labelled), "langid-words")
    grammed = written(gram_counts(counted), "langid-grams")
    prior_rows = labelled.where("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()
    langs = sorted(r.lang for r in prior_rows)
    shares = {r.lang: r["count"] for r in prior_rows}
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros(0))

    def frequencies(df: DataFrame, name: str, most: int, size: Column) -> tuple[dict[str, int], np.ndarray]:
        totals = {(r.lang, r.size): r.n + r.kinds for r in df.groupBy("lang", size.alias("size")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
        chosen = written(most_of_each(df, name, max(1, most // len(langs))), "langid-chosen")
        found = df.join(chosen, name, "left_semi").select(name, "lang", "n", size.alias("size")).toArrow().combine_chunks()
        coded = pc.dictionary_encode(found.column(name)).combine_chunks()
        column = pc.index_in(found.column("lang"), pa.array(langs)).to_numpy()
        row, sizes = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        sizes[row] = found.column("size").to_numpy()
        counts = np.zeros((len(sizes), len(langs)))
        counts[row, column] = found.column("n").to_numpy()
        kinds = np.unique(sizes)
        of_size = np.array([[totals.get((x, int(k)), 0) for x in langs] for k in kinds], np.float64).reshape(len(kinds), len(langs))
        rows = np.log((counts + SMOOTH) / (of_size[np.searchsorted(kinds, sizes)] + SMOOTH))
        return {x: k for k, x in enumerate(coded.dictionary.to_pylist())}, rows

    some_words = frequencies(counted.where(F.length("word") <= LONGEST_WORD), "word", words, F.lit(0))
    some_grams = frequencies(grammed, "gram", most_grams, F.length("gram"))
    prior = np.log([shares[x] / sum(shares.values()) for x in langs])
    return Model(langs, *some_words, *some_grams, prior)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row. No shuffle."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    out = T.StructType([schema_of(texts, "id"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(score, out).withColumnRenamed("id", id_col)
