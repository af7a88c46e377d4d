"""Quality classifier by co-training.

Two views of a document are kept apart. The content view has only what the text
says: shares of kinds of characters, words and lines, and how far its words, pairs
of words and three-letter runs speak for either class. The page view has only
metadata: language, source, and the length that the table states; the text is not
read for it. A share of the labelled documents teaches what n-grams, languages and
sources speak for; a logistic regression of each view is fitted on others.

In each round every view scores all unlabelled documents, and those that it is
surest of (``SURE``, and at most ``PER_ROUND`` more of the documents each round,
classes in their labelled proportion) teach the other view. Nothing but sums
leaves the executors: histograms of scores, from which the least certain score
still taken follows, and gradients and curvatures for Newton steps. Of a step of
a histogram that is taken in part, a hash of the id decides which rows. All
unlabelled documents together never weigh more than the labelled ones.

At the end each view is calibrated on labelled documents that neither was fitted
on, and a logistic combination of the calibrated views scores every document. A
view that knows little gets little weight there.

``LABELLED`` bounds the labelled documents that are used; nothing else is bounded.

Nulls, empty and odd input: a null text counts as empty; null metadata, and a
language, source or length that was never seen, are values of their own; labels
that are null are ignored, and an id with several labels takes their mean; rows
that repeat an id are scored each, and a labelled id teaches once; unless each of
the three parts of the labelled documents has both classes, nothing can be learned,
and every document is kept with score 0.5; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import schema_of, written

#: Most labelled documents that are used; of them, the parts of ten that teach n-grams, fit, and calibrate.
LABELLED, PARTS = 12_000, (3, 4, 3)
ROUNDS, SURE, PER_ROUND, STEPS = 2, 0.97, 0.1, 5
RIDGE, KEEP_FROM = 1.0, 0.5
#: Hashed places of each kind of n-gram; bounds of their log odds; steps of a histogram in a unit of log odds.
SLOTS, MOST_ODDS, FINE = 1 << 15, 3.0, 16
LETTER, DIGIT, SYMBOL, SHOUT, STOP, OTHER = range(6)
CONTENT, PAGE = 20, 7
#: Rows described at once, and letters looked at at once.
SLICE, PIECE = 256, 1 << 20
_SYMBOLS = re.compile(r"[|#$%&*@^~<>={}\[\]\\_+]+")


@cache
def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    one = lambda c: SYMBOL if _SYMBOLS.match(c) else SHOUT if c in "!?" else STOP if c in ".,;:" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return np.array([one(chr(k)) for k in range(1 << 16)], np.uint8)


def _letters(text: str) -> Iterator[np.ndarray]:
    """The code points in pieces, each with the last two of the piece before it."""
    for at in range(0, len(text), PIECE):
        yield np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> list[np.ndarray]:
    """The places of the words, pairs of words, and three-letter runs of a text, repeats included."""
    each = np.fromiter(map(crc32, text.lower().encode("utf-8", "surrogatepass").split()), np.uint64)
    place = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64) % SLOTS
    runs = [place(x[:-2].astype(np.uint64) << np.uint64(42) ^ x[1:-1].astype(np.uint64) << np.uint64(21) ^ x[2:].astype(np.uint64)) for x in _letters(text) if len(x) > 2]
    return [place(each), place(each[:-1] * np.uint64(31) + each[1:]), np.concatenate(runs) if runs else np.zeros(0, np.int64)]


def shares(text: str) -> list[float]:
    """What kinds of characters, words and lines a text is made of; all between 0 and 1, none of them its length."""
    found, n_chars = text.split(), max(1, len(text))
    kinds, runs, before = np.zeros(6), np.zeros(6), 255
    for k, x in enumerate(_letters(text)):
        kind = np.where(x < 1 << 16, _kinds()[np.minimum(x, 0xFFFF)], LETTER)[2 * (k > 0) :]
        kinds += np.bincount(kind, minlength=6)
        runs += np.bincount(kind[np.flatnonzero(np.diff(kind, prepend=before))], minlength=6)
        before = kind[-1]
    words, often = np.unique(np.fromiter(map(hash, found), np.int64, len(found)), return_counts=True)
    n, lengths = max(1, len(found)), [*map(len, found)]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *(kinds[:SHOUT] / n_chars), kinds[SHOUT] / n_chars,
        min(1.0, kinds[SYMBOL] / n), min(1.0, runs[SYMBOL] / n), min(1.0, runs[SHOUT] / n), min(1.0, kinds[STOP] / n),
        sum(x.isupper() and len(x) > 1 for x in found) / n,
        sum(map(str.__eq__, found, found[1:])) / n,
        often.max() / n if found else 0.0,
        len(words) / n,
        math.log1p(len(words)) / math.log1p(n) if found else 0.0,
        min(1.0, sum(lengths) / n / 20),
        sum(x <= 3 for x in lengths) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n),
    ]


@dataclass
class Lore:
    """What n-grams, languages and sources speak for: log odds, positive for the good class."""

    odds: np.ndarray  # three rows of SLOTS
    langs: dict[str | None, float]
    sources: dict[str | None, float]

    def content(self, text: str | None) -> list[float]:
        text = text or ""
        return shares(text) + [float(own[at].mean()) if len(at) else 0.0 for own, at in zip(self.odds, grams(text), strict=True)]

    def page(self, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
        length = math.log1p(max(0, n_chars or 0)) / 12
        return [self.langs.get(lang, 0.0), float(lang in self.langs), self.sources.get(source, 0.0), float(source in self.sources), length, length * length, float(n_chars is None)]

    def views(self, batch: pa.RecordBatch) -> np.ndarray:
        """From columns text, lang, source, n_chars: both views, side by side."""
        columns = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
        return np.array([self.content(t) + self.page(*m) for t, *m in zip(*columns, strict=True)], np.float64).reshape(batch.num_rows, CONTENT + PAGE)


def split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :CONTENT], x[:, CONTENT:]]


def log_odds(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """Of what is found in so many good and bad documents, by that; 0 for what is found in none."""
    return np.clip(np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2)), -MOST_ODDS, MOST_ODDS) * (good + bad > 0)


class Logistic:
    """Ridge logistic regression on columns standardised by their labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.w = np.zeros(x.shape[1] + 1)
        self.penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(25):
            if np.abs(self.step(*self.sums(x, y))).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.spread, -8, 8), np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of these rows."""
        z = self._design(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return (z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)

    def step(self, curvature: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        step = np.linalg.solve(curvature + np.diag(self.penalty), gradient - self.penalty * self.w)
        self.w += step
        return step

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class Cut:
    """Which rows one view is sure of, in steps of its calibrated log odds: all from ``high + 1`` up and ``low - 1`` down,
    and of these two steps the shares ``some_high`` and ``some_low``."""

    high: int
    some_high: float
    low: int
    some_low: float

    def taken(self, step: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = (step > self.high) | (step == self.high) & (draw < self.some_high)
        return good, ((step < self.low) | (step == self.low) & (draw < self.some_low)) & ~good


def steps_of(logit: np.ndarray) -> np.ndarray:
    return np.floor(logit * FINE).astype(np.int64)


def cut(histogram: dict[int, int], quotas: tuple[float, float], sure: float) -> Cut:
    """From how many rows each step has: the surest rows of each class, as many as its quota."""
    bound = math.ceil(math.log(sure / (1 - sure)) * FINE)
    ends = []
    for sign, quota in zip((1, -1), quotas, strict=True):
        last, share = sign * (1 << 20), 0.0
        for step in sorted(histogram, reverse=sign > 0):
            if quota <= 0 or (step if sign > 0 else -step - 1) < bound:
                break
            last, share = step, min(1.0, quota / histogram[step])
            quota -= histogram[step]
        ends += [last, share]
    return Cut(*ends)


class Rows:
    """Unlabelled rows in memory: what the rounds ask of them. ``Table`` asks a DataFrame the same."""

    def __init__(self, x: np.ndarray, draw: np.ndarray):
        self.x, self.draw = x, draw

    def histograms(self, model: CoTrained) -> list[dict[int, int]]:
        """How many rows each step of each view has."""
        out = []
        for logit in model.calibrated(split(self.x)).T:
            steps, n = np.unique(steps_of(logit), return_counts=True)
            out.append(dict(zip(steps.tolist(), n.tolist(), strict=True)))
        return out

    def sums(self, judge: CoTrained, cuts: list[Cut], models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each view: curvature, gradient and number of the rows that the other view, as it was when ``judge`` was made, is sure of."""
        views, out = split(self.x), []
        logits = judge.calibrated(views)
        for k in (0, 1):
            good, bad = cuts[1 - k].taken(steps_of(logits[:, 1 - k]), self.draw)
            some = good | bad
            out.append((*models[k].sums(views[k][some], good[some].astype(float)), float(some.sum())))
        return out


class Table:
    """The same of a table ``x, draw``, summed where its rows are."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, made) -> list:
        """``name, at, value`` of what ``made`` yields for the rows of a batch, added up."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], float] = {}
            for batch in batches:
                x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, CONTENT + PAGE)
                for key, value in made(Rows(x, batch.column(1).to_numpy())):
                    total[key] = total.get(key, 0) + value
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([float(total[k]) for k in keys], pa.float64())], ["name", "at", "value"])

        return self.table.mapInArrow(part, "name int, at long, value double").groupBy("name", "at").agg(F.sum("value").alias("value")).collect()

    def histograms(self, model: CoTrained) -> list[dict[int, int]]:
        out: list[dict[int, int]] = [{}, {}]
        for r in self._summed(lambda rows: (((k, step), n) for k, h in enumerate(rows.histograms(model)) for step, n in h.items())):
            out[r["name"]][r["at"]] = int(r["value"])
        return out

    def sums(self, judge: CoTrained, cuts: list[Cut], models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        def flat(rows: Rows):
            for k, (curvature, gradient, n) in enumerate(rows.sums(judge, cuts, models)):
                yield from (((k, at), v) for at, v in enumerate([*curvature.ravel().tolist(), *gradient.tolist(), n]))

        sizes = [len(m.w) for m in models]
        found = [np.zeros(n * n + n + 1) for n in sizes]
        for r in self._summed(flat):
            found[r["name"]][r["at"]] = r["value"]
        return [(v[: n * n].reshape(n, n), v[n * n : -1], float(v[-1])) for v, n in zip(found, sizes, strict=True)]


class CoTrained:
    """Both views after the rounds, their calibrations, and the combination. ``taught``: how many rows each view taught the other in the last round."""

    def __init__(self, lore: Lore, fit: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], pool: Rows | Table, n_pool: int, rounds: int = ROUNDS, sure: float = SURE):
        self.lore, self.taught = lore, [0.0, 0.0]
        views, y = split(fit[0]), fit[1]
        self.models = [Logistic(v, y) for v in views]
        self._calibrate(held)
        for turn in range(1, rounds + 1 if n_pool else 1):
            quota = PER_ROUND * turn * n_pool
            cuts = [cut(h, (quota * y.mean(), quota * (1 - y.mean())), sure) for h in pool.histograms(self)]
            judge = CoTrained._as_is(self)
            for model in self.models:  # from the start: a step from where a model is sure of all would go astray
                model.w = np.zeros_like(model.w)
            for _ in range(STEPS):
                for k, (curvature, gradient, n) in enumerate(pool.sums(judge, cuts, self.models)):
                    weight = min(1.0, len(y) / n) if n else 0.0
                    own = self.models[k].sums(views[k], y)
                    self.models[k].step(own[0] + weight * curvature, own[1] + weight * gradient)
                    self.taught[1 - k] = n
            self._calibrate(held)

    @classmethod
    def _as_is(cls, other: CoTrained) -> CoTrained:
        """A copy whose models no longer change."""
        out = cls.__new__(cls)
        out.__dict__ |= other.__dict__ | {"models": [Logistic.__new__(Logistic) for _ in other.models]}
        for new, old in zip(out.models, other.models, strict=True):
            new.__dict__ |= old.__dict__ | {"w": old.w.copy()}
        return out

    def _calibrate(self, held: tuple[np.ndarray, np.ndarray]) -> None:
        self.scales = [Logistic(m.logit(v)[:, None], held[1]) for m, v in zip(self.models, split(held[0]), strict=True)]
        self.joint = Logistic(self.calibrated(split(held[0])), held[1])

    def calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        """The calibrated log odds of each view, a column each."""
        return np.column_stack([s.logit(m.logit(v)[:, None]) for s, m, v in zip(self.scales, self.models, views, strict=True)])

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Combined probability, and those of the calibrated views."""
        both = self.calibrated(split(x))
        return self.joint.probability(both), 1 / (1 + np.exp(-both))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _named(docs: DataFrame, names: dict[str, str]) -> list[Column]:
    """The four columns that the views are made of; one that ``docs`` lacks is null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    names = {c: c for c in kinds} | names
    return [(F.col(names[c]) if names[c] in docs.columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in kinds.items()]


def _lore(rows: DataFrame) -> Lore | None:
    """From labelled rows (bounded by ``LABELLED``); None if they lack a class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 3 * SLOTS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for k, at in enumerate(grams(text.as_py() or "")):
                    seen[int(label), k * SLOTS + np.unique(at)] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["at", "bad", "good"])

    counts = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    both = counts[1], counts[0]
    found = rows.select("text", "label").mapInArrow(counted, "at long, bad long, good long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    odds = np.zeros(3 * SLOTS)
    odds[found.column("at").to_numpy()] = log_odds(found.column("good").to_numpy(), found.column("bad").to_numpy(), *both)

    def spoken(column: str) -> dict:
        counted = rows.groupBy(column).agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
        return {r[0]: float(log_odds(np.array(r.good), np.array(r.bad), *both)) for r in counted}

    return Lore(odds.reshape(3, SLOTS), spoken("lang"), spoken("source"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", labelled: int = LABELLED, **columns: str) -> tuple[CoTrained | None, DataFrame]:
    """The classifier (None: nothing can be learned), and the features of every row (``id, x``), from which ``scored`` needs no text."""
    mean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("label"))
    # At most so many rows: small enough to broadcast.
    some = written(mean.orderBy(F.xxhash64("known"), "known").limit(labelled).withColumn("part", F.pmod(F.xxhash64("known", F.lit(7)), F.lit(sum(PARTS)))), "quality-labels")
    rows = docs.select(F.col(id_col).alias("id"), *_named(docs, columns)).join(F.broadcast(some), F.col("id") == F.col("known"), "left").drop("known")
    lore = _lore(rows.where(F.col("part") < PARTS[0]))
    if lore is None:
        return None, docs.select(F.col(id_col).alias("id"), F.array().cast("array<float>").alias("x"))
    shared = docs.sparkSession.sparkContext.broadcast(lore)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = shared.value.views(batch).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "part", "draw")), pa.array(list(x), pa.list_(pa.float32()))], ["id", "label", "part", "draw", "x"])

    rows = rows.withColumn("draw", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20))
    out = T.StructType([schema_of(rows, "id"), *(T.StructField(n, t) for n, t in (("label", T.DoubleType()), ("part", T.LongType()), ("draw", T.DoubleType()), ("x", T.ArrayType(T.FloatType()))))])
    table = written(rows.mapInArrow(described, out), "quality-features")
    known = table.where(F.col("part") >= PARTS[0]).groupBy("id").agg(F.min(F.struct("part", "label", "x")).alias("s")).select("id", "s.*").orderBy("id").toArrow()
    x, y = np.array(known.column("x").to_pylist(), np.float64).reshape(known.num_rows, CONTENT + PAGE), known.column("label").to_numpy()
    fitted = known.column("part").to_numpy() < PARTS[0] + PARTS[1]
    if min(len(set(y[fitted])), len(set(y[~fitted]))) < 2:
        return None, table.select("id", "x")
    pool = table.where("label IS NULL").select("x", "draw")
    return CoTrained(lore, (x[fitted], y[fitted]), (x[~fitted], y[~fitted]), Table(pool), pool.count()), table.select("id", "x")


def scored(features: DataFrame, model: CoTrained | None, id_col: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """``id_col, score, keep, text_score, page_score`` of every row that ``train`` described. No shuffle."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, both = np.full(batch.num_rows, 0.5), np.full((batch.num_rows, 2), 0.5)
            if shared.value and batch.num_rows:
                p, both = shared.value.score(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, CONTENT + PAGE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= keep_from), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["id", "score", "keep", "text_score", "page_score"])

    out = T.StructType([schema_of(features, "id"), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("text_score", T.DoubleType()), T.StructField("page_score", T.DoubleType())])
    return features.mapInArrow(score, out).withColumnRenamed("id", id_col)


def kept_documents(docs: DataFrame, model: CoTrained | None, keep_from: float = KEEP_FROM, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``keep_from``. No shuffle and no join: a batch is filtered where it is scored."""
    if model is None:
        return docs
    shared, n = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns)
    numbered = docs.toDF(*(f"c{k}" for k in range(n)))  # so that no name clashes
    at = {c: f"c{docs.columns.index(columns.get(c, c))}" if columns.get(c, c) in docs.columns else "" for c in ("text", "lang", "source", "n_chars")}
    wide = numbered.select("*", *_named(numbered, at))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            # In single precision, like the features that train writes.
            p, _ = shared.value.score(shared.value.lore.views(batch).astype(np.float32).astype(np.float64))
            yield pa.RecordBatch.from_arrays(batch.columns[:n], batch.schema.names[:n]).filter(pa.array(p >= keep_from))

    return wide.mapInArrow(filtered, numbered.schema).toDF(*docs.columns)
