"""Quality classifier by co-training of two views, a text's content and its page's metadata.

Fitting looks at a bounded sample of the labelled documents (``sample`` of those in the table, by the order of a hash of their ids, and as many of their distinct rows at most).
Spark makes their features, the driver fits two logistic models. In each round Spark scores every unlabelled document with
both, and either model labels those that it is surest of, if it is surer than ``confidence``; they join the other model's
training rows. The surest are found by a distributed top-k; only their features reach the driver (``added`` of the training rows per view and round, none twice). A third of the labelled rows, by the order of a hash of the row, is held back: on one half of it each view is calibrated (a logistic
map of its margin) and the calibrated views are combined, on the other the threshold is set where the share of good documents kept plus the share of
bad ones rejected is largest. The models are a few hundred thousand numbers at most; all documents are scored in one pass with them.

A document is good if its quality is 1 and it isn't toxic. Content: which words of letters occur, by hash, and shares of symbols, capitals,
marks, digits and distinct words. Metadata: language, source, length.

Edge cases: a null text is empty; null metadata is a category of its own; labels without quality are left out, toxic null is 0;
of several labels of a document the lowest counts; documents with a null id are unlabelled, equal rows count once to fit; without good or without bad labels all documents are kept with score 1;
an empty table gives no rows; repeated rows are scored each; texts of any length are read whole; columns besides those named are kept by keep_documents().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm._words import NOT_LETTERS, Words, text_chunks
from assetlens.scratch import Scratch

#: Most labelled documents that are looked at to fit.
SAMPLE = 12_000
BITS, META = 18, 1 << 10
SHARES = 6
#: Ones of a sparse matrix that are worked on at once.
PART = 1 << 20
_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_DIGIT[48:58] = True


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and column of each distinct word (sorted by both), and a row of SHARES numbers per text."""
    w = Words(texts, lower=True, separators=NOT_LETTERS)
    cell = np.unique((w.of.astype(np.int64) << BITS) | (w.hash >> np.uint64(64 - BITS)).astype(np.int64))
    of, col = cell >> BITS, cell & ((1 << BITS) - 1)
    raw = np.append(np.frombuffer(w.buffer, np.uint8), 0).astype(np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    size = np.maximum(np.diff(at) - 1, 1)
    words = np.maximum(np.diff(w.first), 1)
    out = np.zeros((len(texts), SHARES))
    for k, table in enumerate((_SYMBOL, _UPPER, _MARK, _DIGIT)):
        out[:, k] = np.log1p(100 * np.add.reduceat(table[raw], at[:-1], dtype=np.int64) / size)
    out[:, 4] = 2 * np.bincount(of, minlength=len(texts)) / words
    out[:, 5] = np.log1p(words) / 4
    return of, col, out


def meta_columns(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Three columns per document: one of its language, of its source and of its length."""
    import zlib

    def column(kind: str, value) -> int:
        return zlib.crc32(f"{kind}:{value}".encode()) % META

    return np.array([[column("lang", a), column("source", b), column("size", None if c is None else int(np.log2(max(c, 0) + 1)))] for a, b, c in zip(lang, source, n_chars)], np.int64).reshape(-1, 3)


class Rows:
    """A sparse matrix of ones, with some dense columns behind."""

    def __init__(self, n: int, width: int, of: np.ndarray, col: np.ndarray, dense: np.ndarray | None = None):
        self.n, self.width, self.of, self.col = n, width, of, col
        self.dense = np.zeros((n, 0)) if dense is None else dense

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ones in slices, so that 64-bit copies of them stay small."""
        for at in range(0, len(self.of), PART):
            yield self.of[at : at + PART], self.col[at : at + PART]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.width : -1] + weights[-1]
        for of, col in self.parts():
            out += np.bincount(of, weights[col], self.n)
        return out

    def gradient(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for of, col in self.parts():
            out += np.bincount(col, g[of], self.width)
        return np.concatenate([out, self.dense.T @ g, [g.sum()]])

    def take(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1, np.int32)
        new[rows] = np.arange(len(rows))
        of = new[self.of]
        keep = of >= 0
        return Rows(len(rows), self.width, of[keep], self.col[keep], self.dense[rows])


def fit_logistic(x: Rows, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, by Adam on the whole sample."""
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.margins(w), -30, 30)))
        g = x.gradient(weight * (p - y) / total)
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class CoModel:
    text: np.ndarray
    meta: np.ndarray
    views: np.ndarray  # (2, 2): factor and offset of each view's calibrated margin
    mix: np.ndarray  # of the two calibrated margins, and an offset
    threshold: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the text view, of the metadata view, and of both."""
        a, b = text * self.views[0, 0] + self.views[0, 1], meta * self.views[1, 0] + self.views[1, 1]
        return 1 / (1 + np.exp(-np.clip(np.stack([a, b, a * self.mix[0] + b * self.mix[1] + self.mix[2]]), -30, 30)))


def _dense_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    none = np.zeros(0, np.int64)
    return fit_logistic(Rows(len(y), 0, none, none, x), y, np.ones(len(y)), 1e-4, 400, 0.05)


@dataclass
class Sample:
    """Features of some rows: words of row i are size[i] columns, one row's after the other's."""

    key: np.ndarray
    size: np.ndarray
    words: np.ndarray
    shares: np.ndarray
    meta: np.ndarray

    def __add__(self, other: Sample) -> Sample:
        return Sample(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("key", "size", "words", "shares", "meta")))

    def views(self) -> tuple[Rows, Rows]:
        """Text without the words of fewer than four rows, and metadata."""
        n = len(self.key)
        of = np.repeat(np.arange(n, dtype=np.int32), self.size)
        keep = (np.bincount(self.words, minlength=1 << BITS) >= 4)[self.words]
        return Rows(n, 1 << BITS, of[keep], self.words[keep], self.shares), Rows(n, META, np.repeat(np.arange(n), 3), self.meta.ravel())


#: The two views' weights, how many rows per view, and per view the keys that it may not name again, to: per view key and label of its surest, and their features.
Surest = Callable[[list[np.ndarray], int, list[np.ndarray]], tuple[list[dict[int, float]], Sample]]


def co_train(pool: Sample, good: np.ndarray, surest: Surest, rounds: int = 3, added: float = 0.1) -> CoModel | None:
    """good: 1 or 0 for each row of pool. None if one of the labels is missing."""
    labelled = np.arange(len(good))
    held, train = labelled[labelled % 3 == 0], labelled[labelled % 3 > 0]
    if any(len(set(good[part].tolist())) < 2 for part in (held, train)):
        return None
    known = [(train, good[train].astype(float)), (train, good[train].astype(float))]
    views = pool.views()
    for k in range(rounds + 1):
        models = []
        for x, (rows, y) in zip(views, known):
            share = np.clip(y.mean(), 0.01, 0.99)
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
            models.append(fit_logistic(x.take(rows), y, weight))
        if k == rounds:
            break
        named, features = surest(models, max(1, int(added * len(train))), [pool.key[known[1 - v][0][len(train) :]] for v in (0, 1)])
        if not any(named):
            break
        del views
        pool += features
        place = {h: i for i, h in enumerate(pool.key.tolist())}
        for view in (0, 1):
            rows, y = known[1 - view]
            known[1 - view] = (np.append(rows, np.array([place[h] for h in named[view]], rows.dtype)), np.append(y, list(named[view].values())))
        views = pool.views()
    # one half of the held rows calibrates and mixes the views, the other sets the threshold; if a half lacks a label, all of them do both
    halves = held[::2], held[1::2]
    if any(len(set(good[part].tolist())) < 2 for part in halves):
        halves = held, held
    y = good[halves[0]].astype(float)
    margins = [x.take(halves[0]).margins(m) for x, m in zip(views, models)]
    maps = np.array([_dense_fit(m[:, None], y) for m in margins])
    both = np.stack([m * a + b for m, (a, b) in zip(margins, maps)], axis=1)
    mix = _dense_fit(both, y)
    model = CoModel(models[0], models[1], maps, mix, 0.5)
    y = good[halves[1]].astype(float)
    p = model.scores(*[x.take(halves[1]).margins(m) for x, m in zip(views, models)])[2]
    cuts = np.unique(np.quantile(p, np.linspace(0, 1, 201)))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    gain = [(p[y == 1] >= c).mean() + (p[y == 0] < c).mean() for c in cuts]
    model.threshold = float(cuts[int(np.argmax(gain))])
    return model


_FEATURES = ("text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_FEATURES, F.xxhash64("doc_id", *_FEATURES).alias("_h"))


def _features(rows: DataFrame, extra: str) -> tuple[Sample, np.ndarray]:
    """Of distinct rows by _h, in its order: the features, and the column extra (int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, 2):
            of, col, shares = text_features(texts)
            meta = meta_columns(*(batch.column(k).to_pylist() for k in (3, 4, 5)))
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(col.astype(np.int32))), pa.array(list(shares), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int64()))], names=["_h", "extra", "words", "shares", "meta"])

    got = rows.select("_h", F.col(extra).cast("int").alias("extra"), *_FEATURES).mapInArrow(run, "_h bigint, extra int, words array<int>, shares array<double>, meta array<bigint>").toArrow()
    key, first = np.unique(got.column("_h").to_numpy(), return_index=True)
    got = got.take(pa.array(first)).combine_chunks()
    words, shares, meta = (got.column(c).combine_chunks() for c in ("words", "shares", "meta"))
    n = len(key)
    sample = Sample(key, words.value_lengths().to_numpy().astype(np.int64), words.flatten().to_numpy(), shares.flatten().to_numpy().reshape(n, SHARES), meta.flatten().to_numpy().reshape(n, 3))
    return sample, got.column("extra").to_numpy().astype(int)


def surest_unlabelled(docs: DataFrame, judged: DataFrame, models: list[np.ndarray], most: int, known: list[np.ndarray], confidence: float) -> tuple[list[dict[int, float]], Sample]:
    """Per view the keys and labels of its `most` surest documents outside judged and known, and the features of all of them."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sure")
    plain = CoModel(models[0], models[1], np.array([[1.0, 0.0], [1.0, 0.0]]), np.zeros(3), 0.0)
    sure = lambda c: F.abs(F.col(c) - 0.5)
    columns = ("text_score", "meta_score")
    s = score(_keyed(docs), plain, ("doc_id", "_h")).where((sure(columns[0]) > confidence - 0.5) | (sure(columns[1]) > confidence - 0.5))
    s = scratch.written(s.join(judged.select("doc_id"), "doc_id", "left_anti").select("_h", *columns).distinct(), "scores")
    named: list[dict[int, float]] = []
    for c, before in zip(columns, known):
        seen = set(before.tolist())
        top = s.where(sure(c) > confidence - 0.5).orderBy(sure(c).desc(), "_h").select("_h", c).limit(most + len(seen)).collect()
        named.append(dict([(r[0], float(r[1] > 0.5)) for r in top if r[0] not in seen][:most]))
    scratch.close()
    chosen = spark.createDataFrame([(h,) for h in sorted({*named[0], *named[1]})], "_h bigint")
    return named, _features(_keyed(docs).join(F.broadcast(chosen), "_h").dropDuplicates(["_h"]).withColumn("good", F.lit(-1)), "good")[0]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, confidence: float = 0.97, **options) -> CoModel | None:
    """docs: doc_id, text, lang, source, n_chars. labels: doc_id, quality, toxic. Labels without a document in docs take no place in the sample."""
    scratch = Scratch(docs.sparkSession, "judged")
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    judged = scratch.written(judged.join(docs.select("doc_id"), "doc_id", "left_semi"), "judged")
    some = judged.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    # an id may stand for many rows: equal ones count once, and no more than `sample` rows are looked at
    rows = _keyed(docs).join(F.broadcast(some), "doc_id").dropDuplicates(["_h"])
    keys = rows.select("_h").orderBy("_h").limit(sample)
    pool, good = _features(rows.join(F.broadcast(keys), "_h"), "good")
    model = co_train(pool, good, lambda models, most, known: surest_unlabelled(docs, judged, models, most, known, confidence), **options)
    del pool
    pa.default_memory_pool().release_unused()  # the sample's memory: what runs next in this driver may need it
    scratch.close()
    return model


def score(docs: DataFrame, model: CoModel | None, others: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """others, text_score, meta_score, score and kept for each row of docs."""
    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in others)
    schema = f"{kinds}, text_score double, meta_score double, score double, kept boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    sent = [*others, *(c for c in _FEATURES if c not in others)]  # no column twice: texts are most of what goes to Python
    text, *meta_at = (sent.index(c) for c in _FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in text_chunks(batches, text):
            if m is None:
                p, limit = np.ones((3, len(texts))), 0.0
            else:
                of, col, shares = text_features(texts)
                meta = meta_columns(*(batch.column(k).to_pylist() for k in meta_at))
                n, limit = len(texts), m.threshold
                p = m.scores(Rows(n, 1 << BITS, of, col, shares).margins(m.text), Rows(n, META, np.repeat(np.arange(n), 3), meta.ravel()).margins(m.meta))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(x) for x in p), pa.array(p[2] >= limit)], names=[*others, "text_score", "meta_score", "score", "kept"])

    return docs.select(*sent).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept."""
    return score(docs, fit(docs, labels, sample, **options))


def keep_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    return score(docs, fit(docs, labels, sample, **options), tuple(docs.columns)).where("kept").select(*docs.columns)
