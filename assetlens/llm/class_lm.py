"""Scores of a class-based language model: words in classes by exchange clustering, smoothed class transitions, word emissions.

The model takes a token's probability as P(class | class before) P(unit | class) P(word | unit). Units are what is clustered: the end of a text,
the commonest words (at most ``clustered``, each at least ``least`` times), and for all rarer words one unit per last two
bytes, so that a rare or unknown word still has a class. Within a unit of rare words P(word | unit) = (c + 1) / (n + types + 1), c being the word's count;
an ending that training never saw has a unit of its own that counts once. Class transitions are smoothed towards the class's share
(mu pseudo-counts). All probabilities of a history add up to one, unknown words included.

Counting is three passes over the texts in Arrow batches: words by hash; neighbours of units, summed per task before they are
shuffled and stored as one list per unit; scores. Exchange clustering runs over the stored lists: the commonest units seed the classes, each other
unit joins the class whose neighbours are most like its own; then in each round half of the units propose the class they fit best, and move if the
likelihood of all class bigrams, taken exactly with the round's counts, rises. Executors get the classes and the matrix of class bigrams, which don't
grow with the corpus; a table of the commonest words (at most ``known``), whose bound doesn't either, is broadcast for scoring, and words beyond it
are joined by their hash. Lists of units that make up a two-thousandth of the corpus are summed in salted parts first.

Edge cases: a null text is empty: one token, its end; a null id trains; without training texts every score is 0, as the base score is; texts of any length count whole; repeated
rows count and are scored each; words are told apart by 64-bit hashes; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm._words import _LOWER, Words, text_chunks
from assetlens.scratch import Scratch, written

#: The hash that stands for the end of a text, endings that rare words can have, and tokens that a task holds before it sums them.
END, ENDINGS, HELD = -1, 1 << 16, 1 << 20
#: Rows of a neighbour table, and entries of their lists, that are taken together.
ROWS, ENTRIES = 512, 1 << 18


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of each word of the texts, and each text's first word."""
    w = Words(texts, lower=True)
    raw = np.frombuffer(w.buffer, np.uint8)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.first
    last = _LOWER[raw[w.end - 1]].astype(np.int64)
    before = np.where(w.end - w.start > 1, _LOWER[raw[np.maximum(w.end - 2, 0)]], 0).astype(np.int64)
    return w.hash.view(np.int64), before << 8 | last, w.first


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' values, each text followed by an end, and where each text begins in it."""
    out = np.full(len(values) + len(first) - 1, end, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = values
    return out, first[:-1] + np.arange(len(first) - 1)


def _trained(batches: Iterator[pa.RecordBatch], folds: int, fold: int) -> Iterator[list[bytes]]:
    for batch, texts in text_chunks(batches):
        own = [t for i, t in zip(batch.column(0).to_pylist(), texts) if not held_out(i, folds, fold)]
        if own:
            yield own


def vocabulary(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """h, ending and n of each token of the training texts; the end of a text is one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def summed() -> pa.RecordBatch:
            h, ending = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[h, END]), pa.array(np.r_[ending[at], 0].astype(np.int32)), pa.array(np.r_[n, ends].astype(np.int64))], names=["h", "ending", "n"])

        for texts in _trained(batches, folds, fold):
            h, ending, _ = hashed(texts)
            held.append((h, ending))
            ends += len(texts)
            if sum(len(x[0]) for x in held) >= HELD:
                yield summed()
                held, ends = [], 0
        yield summed()

    rows = docs.select("doc_id", "text").mapInArrow(counted, "h bigint, ending int, n bigint").where("n > 0")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Units:
    """h, n, unit: the known words by hash; words: hashes of clustered words in order; count, types: by unit; vocabulary and tokens of training."""

    h: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    words: np.ndarray
    count: np.ndarray
    types: np.ndarray
    size: int
    tokens: int
    cut: int

    @property
    def other(self) -> int:
        return len(self.count) - 1

    def rare(self, ending: np.ndarray) -> np.ndarray:
        """The units of words that aren't clustered."""
        unit = ending + len(self.words) + 1
        return np.where(self.count[unit] > 0, unit, self.other)


def _least_count(steps: list, most: int, least: int) -> int:
    """The least count such that no more than most words have it or a higher one; steps: (count, words) of classes of counts, falling."""
    total, cut = 0, None
    for start, words in steps:
        total += words
        if total > most or start < least:
            break
        cut = start
    return cut or (max(start for start, _ in steps) + 1 if steps else 1) * 2


def units(vocab: DataFrame, clustered: int, known: int, least: int) -> Units:
    """Sizes come from one small aggregation; then the commonest words, no more than ``known``, are collected."""
    words = vocab.where(F.col("h") != END)
    total = vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("h") == END, F.col("n"))).alias("ends")).first()
    # counts up to 32 stand alone, beyond they go by eighths of a power of two
    step = F.when(F.col("n") <= 32, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 1000)
    steps = words.groupBy(step.alias("s")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect()
    steps = [(r["least"], r["words"]) for r in steps]
    cut, cut_known = _least_count(steps, clustered, least), _least_count(steps, known, 1)
    table = words.where(F.col("n") >= min(cut, cut_known)).select("h", "n", "ending").toArrow()
    h, n, ending = (table.column(k).to_numpy().astype(np.int64) for k in range(3))
    order = np.argsort(h)
    h, n, ending = h[order], n[order], ending[order]
    common = np.flatnonzero(n >= cut)
    common = common[np.lexsort((h[common], -n[common]))]
    count, types = np.zeros(1 + len(common) + ENDINGS + 1, np.int64), np.zeros(1 + len(common) + ENDINGS + 1, np.int64)
    count[0], count[1 : len(common) + 1], count[-1] = total["ends"] or 0, n[common], 1
    for r in words.where(F.col("n") < cut).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toLocalIterator():
        count[1 + len(common) + r["ending"]], types[1 + len(common) + r["ending"]] = r["n"], r["types"]
    unit = ending + len(common) + 1
    unit[common] = np.arange(len(common)) + 1
    return Units(h, n, unit, h[common], count, types, total["size"], total["n"] or 0, min(cut, cut_known))


def _found(h: np.ndarray, sorted_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_h, h), max(len(sorted_h) - 1, 0))
    return at, sorted_h[at] == h if len(sorted_h) else np.zeros(len(h), bool)


def _lists(key: np.ndarray, value: np.ndarray, n: np.ndarray, names: tuple[str, ...], *more: np.ndarray) -> pa.RecordBatch:
    """One row per run of equal keys: the key, what more says of it, and lists of its values and counts."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[first, len(key)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value.astype(np.int32), n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(key[first].astype(np.int32)), *(pa.array(m[key[first]]) for m in more), *lists], names=list(names))


def _counted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, value and count of each distinct number key << 32 | value; sorts its argument."""
    both.sort()
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    n = np.diff(np.r_[first, len(both)])
    both = both[first]
    return both >> 32, both & 0xFFFFFFFF, n


def _summed(key: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = key << 32 | value
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    return both[first] >> 32, both[first] & 0xFFFFFFFF, np.add.reduceat(n, first) if len(first) else n


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unit, value and count of each entry of rows (unit, values, counts)."""
    values = batch.column(1)
    size = np.diff(values.offsets.to_numpy())
    return np.repeat(batch.column(0).to_numpy(), size).astype(np.int64), values.flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (unit, values, counts, salt) summed per unit, in each part that keys deal out."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("unit", "at", "n")
        key = value = n = np.zeros(0, np.int64)
        for part in (batch.slice(s, ROWS) for batch in batches for s in range(0, batch.num_rows, ROWS)):
            k, v, c = _flat(part)
            if not len(k):
                continue
            key, value, n = _summed(np.r_[key, k], np.r_[value, v], np.r_[n, c])
            done = int(np.searchsorted(key, k[-1]))  # rows are sorted: the last unit may go on
            if done:
                yield _lists(key[:done], value[:done], n[:done], names)
                key, value, n = key[done:], value[done:], n[done:]
        yield _lists(key, value, n, names)

    return rows.repartition(*keys).sortWithinPartitions("unit").select("unit", "at", "n").mapInArrow(merged, "unit int, at array<int>, n array<bigint>")


def neighbours(docs: DataFrame, u: Units, scratch: Scratch, folds: int = 7, fold: int = 2) -> DataFrame:
    """unit, at, n: for each unit the units after it (at = 2 unit) and before it (at = 2 unit + 1), with their counts in training."""
    spark = docs.sparkSession
    words = np.sort(u.words)
    sent = spark.sparkContext.broadcast((words, u.words.argsort() + 1, u.count, u.count * 2000 > u.tokens, len(u.words)))
    salts = max(8, math.isqrt(u.tokens // HELD))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, count, hot, n_words = sent.value
        rng = np.random.default_rng(1)
        held: list[np.ndarray] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            key, value, n = _counted(np.concatenate(held))
            held.clear()
            yield _lists(key, value, n, ("unit", "salt", "at", "n"), np.where(hot, rng.integers(0, salts), -1).astype(np.int32))

        for texts in _trained(batches, folds, fold):
            h, ending, first = hashed(texts)
            at, found = _found(h, words)
            unit = np.where(found, ids[at] if len(ids) else 0, ending + n_words + 1)
            seq, _ = with_ends(unit, first, 0)
            before = np.r_[0, seq[:-1]]
            held += [before << 32 | 2 * seq, seq << 32 | 2 * before + 1]
            size += len(seq)
            if size >= HELD:
                yield from summed()
                size = 0
        if held:
            yield from summed()

    rows = scratch.written(docs.select("doc_id", "text").mapInArrow(paired, "unit int, salt int, at array<int>, n array<bigint>"), "pairs")
    often = _merged(rows.where("salt >= 0"), "unit", "salt")
    out = scratch.written(_merged(rows.where("salt < 0").select("unit", "at", "n").unionByName(often), "unit"), "neighbours")
    scratch.drop("pairs")
    return out


def _profiles(batch: pa.RecordBatch, cls: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: units, counts of the classes after and before each (rows, 2, k), and how often each follows itself."""
    entries = batch.column(1).offsets.to_numpy()
    s = 0
    while s < batch.num_rows:  # a row's list alone may be longer: it has two entries per unit at most
        e = int(np.clip(np.searchsorted(entries, entries[s] + ENTRIES, "right") - 1, s + 1, s + ROWS))
        part = batch.slice(s, min(e, batch.num_rows) - s)
        s += part.num_rows
        own = part.column(0).to_numpy()
        size = np.diff(part.column(1).offsets.to_numpy())
        row = np.repeat(np.arange(len(own)), size)
        at, n = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
        unit, side = at >> 1, at & 1
        sums = np.bincount((row * 2 + side) * k + cls[unit], n, len(own) * 2 * k).reshape(len(own), 2, k)
        itself = np.bincount(row, n * ((unit == own[row]) & (side == 0)), len(own))
        yield own, sums, itself


def class_bigrams(table: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    sent = table.sparkSession.sparkContext.broadcast(cls)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        for batch in batches:
            for own, sums, _ in _profiles(batch, sent.value, k):
                np.add.at(m, sent.value[own], sums[:, 0])
        i, j = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j].astype(np.int64))], names=["i", "j", "n"])

    m = np.zeros((k, k))
    t = table.mapInArrow(counted, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    m[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("n").to_numpy()
    sent.destroy()
    return m


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gain(m: np.ndarray, a: np.ndarray, b: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Change of the class bigrams' log likelihood for each unit that moves alone from class a to class b."""
    f, at = _xlogx, np.arange(len(a))
    rows, columns = m.sum(axis=1), m.sum(axis=0)
    change = f(m[a] - after) - f(m[a]) + f(m[b] + after) - f(m[b])
    across = f(m[:, a].T - before) - f(m[:, a].T) + f(m[:, b].T + before) - f(m[:, b].T)
    for x in (a, b):
        change[at, x] = across[at, x] = 0
    ra, rb, la, lb = after[at, a], after[at, b], before[at, a], before[at, b]
    corner = f(m[a, a] - ra - la + itself) - f(m[a, a]) + f(m[a, b] - rb + la - itself) - f(m[a, b])
    corner += f(m[b, a] - lb + ra - itself) - f(m[b, a]) + f(m[b, b] + rb + lb + itself) - f(m[b, b])
    out = change.sum(axis=1) + across.sum(axis=1) + corner
    for total, own in ((rows, after.sum(axis=1)), (columns, before.sum(axis=1))):
        out -= f(total[a] - own) - f(total[a]) + f(total[b] + own) - f(total[b])
    return out


def moves(table: DataFrame, cls: np.ndarray, m: np.ndarray, classes: int, turn: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Units and the classes they move to. turn: None in the first pass, when each unit without a class takes one."""
    sent = table.sparkSession.sparkContext.broadcast((cls, m))

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, m = sent.value
        k = len(m)
        like = lambda x: np.log((x + 0.5) / (x.sum(axis=1, keepdims=True) + 0.5 * k))[:classes]
        follow, lead = like(m), like(m.T)
        for batch in batches:
            for own, sums, itself in _profiles(batch, cls, k):
                at = np.flatnonzero((own > 0) & ((cls[own] == k - 1) if turn is None else (own % 2 == turn % 2)))
                after, before, own = sums[at, 0], sums[at, 1], own[at]
                fit = after @ follow.T + before @ lead.T
                now = cls[own]
                if turn is not None:
                    fit[np.arange(len(own)), now] = -np.inf
                best = fit.argmax(axis=1)
                if turn is not None:
                    better = gain(m, now, best, after, before, itself[at]) > 1e-9
                    own, best = own[better], best[better]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(best.astype(np.int32))], names=["unit", "class"])

    t = table.mapInArrow(proposed, "unit int, class int").toArrow()
    sent.destroy()
    return t.column(0).to_numpy(), t.column(1).to_numpy()


def exchange(table: DataFrame, u: Units, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the class bigrams. Class ``classes`` is that of ends; the one after it holds what has no class yet."""
    k = classes + 2
    cls = np.full(len(u.count), k - 1, np.int32)
    cls[0] = classes
    seeds = np.argsort(-u.count[1:-1], kind="stable")[:classes] + 1
    cls[seeds] = np.arange(len(seeds))
    m = class_bigrams(table, cls, k)
    for turn in [None, *range(rounds)]:
        unit, to = moves(table, cls, m, classes, turn)
        cls[unit] = to
        m = class_bigrams(table, cls, k)
        if turn is not None and not len(unit):
            break
    cls[u.other] = cls[seeds[0]] if len(seeds) else 0
    return cls, m


@dataclass
class ClassModel:
    units: Units
    cls: np.ndarray
    #: log10 P(class | class before), log10 P(unit | class).
    transition: np.ndarray
    emission: np.ndarray
    vocabulary: DataFrame
    folds: int
    fold: int


def fit(docs: DataFrame, scratch: Scratch, classes: int = 256, clustered: int = 1 << 16, known: int = 1 << 20, least: int = 4, rounds: int = 6, mu: float = 64.0, folds: int = 7, fold: int = 2) -> ClassModel:
    vocab = scratch.written(vocabulary(docs, folds, fold), "vocabulary")
    u = units(vocab, clustered, known, least)
    table = neighbours(docs, u, scratch, folds, fold)
    cls, m = exchange(table, u, classes, rounds)
    size = np.bincount(cls, u.count, len(m))
    share = (size + 1) / (size + 1).sum()
    transition = np.log10((m + mu * share) / (m.sum(axis=1, keepdims=True) + mu))
    with np.errstate(divide="ignore"):
        emission = np.log10(u.count / np.maximum(size[cls], 1))
    return ClassModel(u, cls, transition, emission, vocab, folds, fold)


def score(docs: DataFrame, model: ClassModel, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of docs."""
    u = model.units
    sent = docs.sparkSession.sparkContext.broadcast((u, model.cls, model.transition, model.emission))
    folds, fold = model.folds, model.fold
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, model double, h array<bigint>, m array<bigint>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, cls, transition, emission = sent.value
        ends = math.log10(u.count[0] + 1)
        within = np.log10(u.count + u.types + 1.0)
        within[u.other] = 0
        for batch, texts in text_chunks(batches):
            h, ending, first = hashed(texts)
            at, found = _found(h, u.h)
            unit = np.where(found, u.unit[at], 0) if len(u.h) else np.zeros(len(h), np.int64)
            clustered = found & (unit <= len(u.words))
            unit = np.where(clustered, unit, u.rare(ending))
            log_n = np.where(found, np.log10(np.where(found, u.n[at] if len(u.n) else 0, 0) + 1.0), 0.0)
            own = emission[unit] + np.where(clustered, 0, log_n - within[unit])
            seq, begin = with_ends(unit, first, 0)
            place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(first))
            total, logs = np.full(len(seq), emission[0]), np.full(len(seq), ends)
            total[place], logs[place] = own, log_n
            c = cls[seq]
            total += transition[np.r_[cls[0], c[:-1]], c]
            known = np.full(len(seq), int(u.count[0] > 0))
            known[place] = found
            # words beyond the broadcast table: distinct ones of each text with their counts
            rest = np.flatnonzero(~found)
            doc = np.repeat(np.arange(len(texts)), np.diff(first))[rest]
            order = np.lexsort((h[rest], doc))
            d, x = doc[order], h[rest][order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])]) if len(x) else np.zeros(0, np.int64)
            many = np.diff(np.r_[new, len(x)])
            offsets = pa.array(np.searchsorted(d[new], np.arange(len(texts) + 1)).astype(np.int32))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([held_out(i, folds, fold) for i in ids.to_pylist()]), pa.array(np.diff(np.r_[begin, len(seq)])), pa.array(np.add.reduceat(known, begin)), pa.array(np.add.reduceat(logs, begin)), pa.array(np.add.reduceat(total, begin)),
                 pa.ListArray.from_arrays(offsets, pa.array(x[new])), pa.ListArray.from_arrays(offsets, pa.array(many.astype(np.int64)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "model", "h", "m"],
            )

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, schema)
    parts = scratch.written(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    rest = parts.select("row", F.explode(F.arrays_zip("h", "m")).alias("e")).select("row", "e.h", "e.m")
    beyond = model.vocabulary.where((F.col("n") < u.cut) & (F.col("h") != END)).select("h", "n")
    more = rest.join(beyond, "h").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("m").alias("found"))
    out = parts.drop("h", "m").join(more, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "found": F.coalesce("found", F.lit(0))})
    least = math.log10(u.tokens + u.size + 1)
    result = F.col("model") + F.col("more") if u.tokens else F.lit(0.0)
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("found")).alias("n_known"), F.lit(u.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(least)).alias("base_score"), result.alias("score"), F.pow(F.lit(10.0), -result / F.col("n_tokens")).alias("perplexity"),
    )
    return out


def score_texts(docs: DataFrame, **options: object) -> DataFrame:
    """Fits on the rows of docs (doc_id, text) that aren't held out and scores all."""
    scratch = Scratch(docs.sparkSession, "class-lm")
    out = written(score(docs, fit(docs, scratch, **options), scratch), "language-scores")
    scratch.close()
    return out
