"""Hard-negative mining with rotated one-bit codes and deterministic score intervals.

Vectors become integers floor(scale * x). A vector z is turned by a fixed random rotation, and its signs make a unit code c of one
bit per dimension; stored with it are its alignment <z, c> and the length of what the code leaves over. What is left over gets a code of its
own, ``levels`` times: z = a1 c1 + ... + aL cL + rest, with the rest at right angles to cL. An anchor q is quantised to 8 bits per
dimension, so <q, c> comes from popcounts of its bit planes with the codes, and

    |<q, z> - sum a_l <q', c_l>|  <=  |q - q'| sum |a_l| + |q - <q, cL> cL| |rest|        (Cauchy-Schwarz)

always holds. A row whose interval can't reach the places that better rows of its block have taken, or the window, is dropped; every row that survives is scored
as an integer inner product, so the result is exact whatever the codes say.

Rows are dealt into blocks by a hash of their id and anchors into blocks of at most ``anchor_block``; a task meets one pair of blocks, so
no label, vector or anchor gathers rows in one task. Each pair of blocks gives its best rows per anchor, and those are ranked once more.

Edge cases: rows without id or label, with a null or empty vector or a null or non-finite component take no part, nor do vectors whose integer form is
longer than 2^31 (their scores could leave 64 bits); vectors of unlike lengths aren't compared; labels are compared by
their 64-bit hashes and may be of any type that Spark can hash; an id names one vector: of repeated rows one counts, of unlike rows with
one id that with the smallest hash; a positive with a negative score has no negatives, one with the score 0 those with the score 0; equal scores go by smaller id; an empty table
gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.scratch import Scratch, written

#: Longest integer vector: two of them have a product below 2^62.
LONGEST = float(1 << 31)
#: Pairs whose intervals, and pairs whose scores, are held at once.
AT_ONCE, SCORED = 1 << 19, 1 << 15


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans (n, dims) as 64-bit words (n, ceil(dims / 64))."""
    n, dims = bits.shape
    full = np.zeros((n, -(-dims // 64) * 64), bool)
    full[:, :dims] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def codes(z: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits (n, levels, words), alignments (n, levels) and the length of the rest (n) of integer vectors."""
    rest = z.astype(np.float64) @ rotation(z.shape[1])
    root = np.sqrt(z.shape[1])
    bits, align = [], []
    for _ in range(levels):
        up = rest >= 0
        sign = np.where(up, 1.0, -1.0) / root
        a = (rest * sign).sum(axis=1)
        rest = rest - a[:, None] * sign
        bits.append(_words(up))
        align.append(a)
    return np.stack(bits, 1), np.stack(align, 1), np.sqrt((rest * rest).sum(axis=1))


def intervals(q: np.ndarray, bits: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of each anchor (rows of q) with each coded row."""
    dims = q.shape[1]
    turned = q.astype(np.float64) @ rotation(dims)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / 255, 1e-300)
    level = np.rint((turned - low) / step)
    lost = np.sqrt(((turned - (low + step * level)) ** 2).sum(axis=1))[:, None]
    planes = [_words(level.astype(np.int64) >> b & 1 == 1) for b in range(8)]
    middle, width = np.zeros((len(q), len(rest))), lost * np.abs(align).sum(axis=1)[None, :]
    for k in range(align.shape[1]):
        inside = np.zeros(middle.shape, np.int32)
        for b, plane in enumerate(planes):
            for w in range(plane.shape[1]):
                met = np.bitwise_count(plane[:, w, None] & bits[None, :, k, w]).astype(np.int32)
                inside += met << (b + 1)
        ones = np.bitwise_count(bits[:, k]).sum(axis=1, dtype=np.int64)
        at = (low * (2 * ones - dims)[None, :] + step * (inside - level.sum(axis=1, keepdims=True))) / np.sqrt(dims)
        middle += at * align[None, :, k]
    norm = np.sqrt((turned * turned).sum(axis=1))[:, None]
    beside = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(at) - lost, 0) ** 2, 0))
    length = np.sqrt((align * align).sum(axis=1) + rest * rest)
    width += beside * rest[None, :] + 1e-9 * norm * length[None, :] + 1e-6
    return middle - width, middle + width


def dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows i of x with rows j of y."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), SCORED):
        out[a : a + SCORED] = np.einsum("ij,ij->i", x[i[a : a + SCORED]], y[j[a : a + SCORED]])
    return out


def best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best per i: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, i))
    i = i[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return order[rank < k]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _seeded(lower: np.ndarray, middle: np.ndarray, q: np.ndarray, z: np.ndarray, k: int, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """A score that k rows are known to reach: from lower bounds inside the window, or from the scores of the rows whose estimates are best."""
    known = _kth(lower, k)
    n = min(middle.shape[1], 2 * k)
    if n < k:
        return known
    at = np.argpartition(-middle, n - 1, axis=1)[:, :n]
    i = np.repeat(np.arange(len(q)), n)
    score = dots(q, i, z, at.ravel()).reshape(at.shape)
    fits = np.isfinite(np.take_along_axis(middle, at, 1)) & (score >= floor[:, None]) & (score <= ceiling[:, None])
    return np.maximum(known, _kth(np.where(fits, score, -np.inf), k))


class _Side:
    """A block's rows with vectors of one length."""

    def __init__(self, t: pa.Table, at: np.ndarray, dims: int):
        t = t.take(pa.array(at)).combine_chunks()
        get = lambda name: t.column(name).to_numpy()
        flat = lambda name, kind: np.asarray(t.column(name).combine_chunks().flatten(), kind)
        self.table, self.id, self.label, self.rest = t, get("vec_id"), get("l"), get("rest")
        n, words = len(at), -(-dims // 64)
        self.z, self.align = flat("z", np.int64).reshape(n, dims), flat("align", np.float64).reshape(n, -1)
        self.bits = flat("bits", np.int64).view(np.uint64).reshape(n, -1, words)


def _sides(left: pa.Table, right: pa.Table) -> Iterator[tuple[_Side, _Side]]:
    da, dr = left.column("dims").to_numpy(), right.column("dims").to_numpy()
    for dims in np.intersect1d(da, dr):
        yield _Side(left, np.flatnonzero(da == dims), dims), _Side(right, np.flatnonzero(dr == dims), dims)


def _best_of_label(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best other rows of an anchor's label in a block."""
    out = [[np.zeros(0, np.int64)] * 3]
    for a, r in _sides(left, right):
        for label in np.intersect1d(a.label, r.label):
            rows = np.flatnonzero(r.label == label)
            anchors = np.flatnonzero(a.label == label)
            step = max(1, AT_ONCE // len(rows))
            for s in range(0, len(anchors), step):
                at = anchors[s : s + step]
                lower, upper = intervals(a.z[at], r.bits[rows], r.align[rows], r.rest[rows])
                other = a.id[at][:, None] != r.id[rows][None, :]
                middle = np.where(other, (lower + upper) / 2, -np.inf)
                any_score = np.full(len(at), np.inf)
                reach = _seeded(np.where(other, lower, -np.inf), middle, a.z[at], r.z[rows], k, -any_score, any_score)
                i, j = np.nonzero(other & (upper >= reach[:, None]))
                score = dots(a.z[at], i, r.z[rows], j)
                keep = best(i, score, r.id[rows][j], k)
                out.append([a.id[at][i[keep]], r.id[rows][j[keep]], score[keep]])
    return pa.table([np.concatenate(x) for x in zip(*out)], names=["anchor_id", "positive_id", "positive_score"])


def _best_in_windows(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Per anchor and positive the k best rows of other labels in a block whose scores lie in the positive's window."""
    out = [[np.zeros(0, np.int64)] * 5]
    for a, r in _sides(left, right):
        flat = lambda name, a=a: a.table.column(name).combine_chunks()
        many = np.diff(flat("floor").offsets.to_numpy())
        slots = np.arange(many.max())
        used = slots[None, :] < many[:, None]
        window = {}
        for name, empty in (("positive", 0), ("score", 0), ("floor", 1), ("ceiling", 0)):
            window[name] = np.full(used.shape, empty, np.int64)
            window[name][used] = flat(name).flatten().to_numpy()
        step = max(1, AT_ONCE // len(r.id))
        for s in range(0, len(a.id), step):
            at = np.arange(s, min(s + step, len(a.id)))
            floor, ceiling, here = window["floor"][at], window["ceiling"][at], used[at]
            lower, upper = intervals(a.z[at], r.bits, r.align, r.rest)
            unlike = a.label[at][:, None] != r.label[None, :]
            middle, alive = (lower + upper) / 2, np.zeros(unlike.shape, bool)
            for p in slots:
                f, c = floor[:, p, None], ceiling[:, p, None]
                sure = unlike & (lower >= f) & (upper <= c)
                likely = np.where(unlike & (middle >= f) & (middle <= c), middle, -np.inf)
                reach = _seeded(np.where(sure, lower, -np.inf), likely, a.z[at], r.z, k, floor[:, p], ceiling[:, p])
                alive |= unlike & here[:, p, None] & (upper >= np.maximum(reach[:, None], f)) & (lower <= c)
            i, j = np.nonzero(alive)
            score = dots(a.z[at], i, r.z, j)
            for p in slots:
                fits = np.flatnonzero(here[i, p] & (score >= floor[i, p]) & (score <= ceiling[i, p]))
                keep = fits[best(i[fits], score[fits], r.id[j[fits]], k)]
                x = at[i[keep]]
                out.append([a.id[x], window["positive"][x, p], window["score"][x, p], r.id[j[keep]], score[keep]])
    return pa.table([np.concatenate(x) for x in zip(*out)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def coded(vectors: DataFrame, scale: int = 256, levels: int = 3) -> DataFrame:
    """vec_id, l (hash of the label), dims, z, bits, align and rest of each row that takes part, one per id."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    z = F.transform(x, lambda v: F.floor(v * scale))
    length = F.sqrt(F.aggregate(F.transform(x, lambda v: v * scale), F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.where(sound).where(length + F.size(x) < LONGEST).select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("l"), z.cast("array<bigint>").alias("z"))
    rows = rows.groupBy("vec_id").agg(F.min_by(F.struct("l", "z"), F.xxhash64("l", "z")).alias("r")).select("vec_id", "r.l", "r.z")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(size):
                own = batch.take(pa.array(np.flatnonzero(size == dims)))
                z = np.asarray(own.column(2).flatten(), np.int64).reshape(-1, dims)
                bits, align, rest = codes(z, levels)
                listed = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.size // len(z)).cast(pa.list_(pa.array(m.ravel()[:1]).type))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(z), dims), pa.int32()), own.column(2), listed(bits.reshape(len(z), -1).view(np.int64)), listed(align), pa.array(rest)], names=["vec_id", "l", "dims", "z", "bits", "align", "rest"])

    return rows.mapInArrow(made, "vec_id bigint, l bigint, dims int, z array<bigint>, bits array<bigint>, align array<double>, rest double")


def mine(vectors: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, levels: int = 3, row_block: int = 8192, anchor_block: int = 2048, least_blocks: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for anchors whose id is divisible by anchors_every.

    vectors has vec_id, label and embedding. A negative's score lies between low and high percent of the positive's.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.written(coded(vectors, scale, levels), "coded")
    anchors = rows.where(F.col("vec_id") % anchors_every == 0)
    per, blocks = -(-anchors.count() // anchor_block) or 1, max(least_blocks, -(-rows.count() // row_block))
    i, j = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(per)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = rows.withColumns({"i": i, "j": every(per)})
    dealt = lambda df: df.withColumns({"j": j, "i": every(blocks)}).groupBy("i", "j").cogroup(grid.groupBy("i", "j"))

    found = dealt(anchors).applyInArrow(lambda a, r: _best_of_label(a, r, positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).where("positive_score >= 0")
    hundreds, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100
    floor, ceiling = hundreds * low + F.ceil(rest * low / 100), hundreds * high + F.floor(rest * high / 100)
    held = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", floor.alias("floor"), ceiling.alias("ceiling"))).alias("p"))
    held = held.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive"), F.col("p.positive_score").alias("score"), F.col("p.floor").alias("floor"), F.col("p.ceiling").alias("ceiling"))
    held = scratch.written(anchors.join(held, "vec_id"), "positives")

    out = dealt(held).applyInArrow(lambda a, r: _best_in_windows(a, r, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    scratch.close()
    return out
