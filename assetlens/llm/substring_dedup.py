"""Substring deduplication by prefix-partitioned suffix trees over the word windows that can repeat.

A window of ``window`` words is repeated if its word sequence starts anywhere else too; every word that a repeated
window covers is removed. The letters of the trees are windows: the letter at a word is the digest of the ``window`` words
from there on, so two suffixes with n letters in common have window + n - 1 words in common.

1. Each window has one leading gram: the least-hashed of its ``gram``-word sequences, the leftmost among equals. Equal windows
   have equal leading grams at equal places, so a window whose leading gram occurs once can't repeat. The
   places of leading grams are counted over all documents.
2. The documents that hold a gram found twice or more are read again. The letters that such a gram leads make a string,
   and its suffixes are dealt out by prefix: the gram, as long as at most ``subtree`` of its strings have it, else
   the longer prefix of a whole window as well. So each group fits into memory.
3. For the strings of a group the suffixes are sorted (by prefix doubling) and the longest common prefixes of
   neighbours taken: the tree's internal nodes are the runs of neighbours with common letters. What the deepest node
   above a leaf is deep is the longest repeat that starts there; its words go.
   Below a prefix that is a whole window there is nothing to sort: the prefix is a node, and it has two leaves if two
   suffixes have it. Those are counted with map-side sums: equal strings first, then the letters of the distinct ones. What
   is found goes back to the strings by a join that may be split by size, as one of them may hold any share of all rows.

Edge cases: null texts and texts shorter than a window lose nothing; a window that repeats within its own document counts; repeated
rows are copies of each other and lose all that lies in windows; empty tables give no rows; very long texts are compared
whole; columns besides doc_id and text are kept by remove_repeats(). A row is known by a hash of id and text, so a null
id is as good as any and rows equal in both are treated alike. Sequences are compared by two 64-bit digests, of the gram and of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm._words import Words, text_chunks
from assetlens.scratch import Scratch, written

#: Words of a leading gram, and most strings below one prefix in one group.
GRAM, SUBTREE = 12, 50_000
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def led_windows(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, its digest, and the place of its leading gram; with the grams' hashes by place."""
    starts, digests = w.windows(window)
    if not len(starts):
        return starts, digests, starts
    places, hashes = w.windows(gram)
    full = np.full(len(w.hash) + window, FAR)
    full[places] = hashes
    span = window - gram + 1
    lead = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(full, span)
    for k in range(0, len(starts), 1 << 15):
        part = starts[k : k + (1 << 15)]
        lead[k : k + (1 << 15)] = part + view[part].argmin(axis=1)
    w.gram = full
    return starts, digests, lead


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")


def leading_grams(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """row, place (of the word in its text) and gram, for each leading gram of each text. docs: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            w = Words(texts)
            _, _, lead = led_windows(w, window, gram)
            if len(lead):
                lead = np.unique(lead)
                of = w.of[lead]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(lead - w.first[of], pa.int32()), pa.array(w.gram[lead].astype(np.int64))], names=["row", "place", "gram"])

    return docs.mapInArrow(run, "row bigint, place int, gram bigint")


def suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, hot, row, start and paths: the digests of the neighbouring windows from start on that the gram leads. docs: row, text, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            w = Words(texts)
            starts, digests, lead = led_windows(w, window, gram)
            if not len(lead):
                continue
            at = batch.column(2)
            flat = at.flatten()
            wanted = np.repeat(w.first[:-1], at.value_lengths().to_numpy()) + flat.field(0).to_numpy()
            order = np.argsort(wanted)
            wanted, hot = wanted[order], np.asarray(flat.field(1).to_numpy(zero_copy_only=False))[order]
            cut = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
            stop = np.append(cut[1:], len(lead))
            find = np.minimum(np.searchsorted(wanted, lead[cut]), len(wanted) - 1)
            keep = wanted[find] == lead[cut]
            cut, stop, find = cut[keep], stop[keep], find[keep]
            size = stop - cut
            index = np.repeat(cut - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            of = w.of[starts[cut]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(w.gram[lead[cut]].astype(np.int64)),
                    pa.array(hot[find], pa.bool_()),
                    batch.column(0).take(pa.array(of)),
                    pa.array(starts[cut] - w.first[of], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(digests[index].astype(np.int64))),
                ],
                names=["gram", "hot", "row", "start", "paths"],
            )

    return docs.select("row", "text", "at").mapInArrow(run, "gram bigint, hot boolean, row bigint, start int, paths array<bigint>")


def suffix_tree(letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings, given one after the other with their sizes: the sorted suffixes' places, the common letters of each with the one before, and for each place the depth of the deepest internal node above its leaf.

    Prefix doubling: the rank of a suffix by its first 2k letters comes from those of its first k and the k after them.
    The ranks of each doubling stay; two neighbours are compared by them from the longest to the shortest.
    """
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(size), size)
    place = np.arange(n)
    levels = [np.unique(letters, return_inverse=True)[1].astype(np.int64) + 1]
    k = 1
    while k < size.max():
        rank = levels[-1]
        after = np.where(place + k < end, rank[np.minimum(place + k, n - 1)], 0)  # 0: the string has ended
        levels.append(np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[1:].copy(), order[:-1].copy()
        ea, eb, got = end[a], end[b], np.zeros(n - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            step = 1 << level
            fits = (a + step <= ea) & (b + step <= eb)
            same = fits & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
            a, b, got = a + step * same, b + step * same, got + step * same
        common[1:] = got
    depth = np.zeros(n, np.int64)
    depth[order] = np.maximum(common, np.append(common[1:], 0))
    return order, common, depth


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, start and repeats (bits: which of the windows from start on a repeat covers). Rows come sorted by gram."""
    held: list[pa.RecordBatch] = []

    def built(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(part).combine_chunks()
        if not t.num_rows:
            return
        lists = t.column("paths").chunk(0)
        size = lists.value_lengths().to_numpy()
        first = np.cumsum(size) - size
        _, _, depth = suffix_tree(lists.flatten().to_numpy(), size)
        # a leaf below a node of d letters: the d windows from there on are repeats
        edge = np.zeros(len(depth) + 1, np.int64)
        leaf = np.flatnonzero(depth)
        np.add.at(edge, leaf, 1)
        np.add.at(edge, leaf + depth[leaf], -1)
        repeated = np.cumsum(edge[:-1]) > 0
        bit = np.arange(len(depth)) - np.repeat(first, size)
        filled = np.flatnonzero(size)
        bits = np.zeros(len(size), np.int64)
        bits[filled] = np.add.reduceat(np.where(repeated, np.int64(1) << bit, 0), first[filled]) if len(filled) else 0
        some = pa.array(np.flatnonzero(bits))
        yield pa.RecordBatch.from_arrays([t.column("row").chunk(0).take(some), t.column("start").chunk(0).take(some), pa.array(bits[bits != 0])], names=["row", "start", "repeats"])

    # a batch's last gram may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        at = int(np.searchsorted(gram, gram[-1]))
        if at == 0 and (not held or held[-1].column(0)[0].as_py() == gram[0]):
            held.append(batch)
            continue
        yield from built([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield from built(held)


def repeated_windows(docs: DataFrame, window: int = 35, gram: int = GRAM, subtree: int = SUBTREE) -> DataFrame:
    """row, start and repeats for the places in docs (row, text) where repeated windows start. Equal rows count as often as they occur."""
    if not 0 <= window - gram < 62:
        raise ValueError("a window may have up to 61 words more than a gram")
    scratch = Scratch(docs.sparkSession, "substrings")
    grams = leading_grams(docs, window, gram)
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", (F.col("c") > subtree).alias("hot"))
    counts = scratch.written(counts, "counts")  # a table: so the join may split a gram that very many places have
    found = grams.join(counts, "gram").groupBy("row").agg(F.collect_set(F.struct("place", "hot")).alias("at"))
    leaves = scratch.written(suffixes(docs.join(found, "row"), window, gram), "suffixes")
    scratch.drop("counts")
    cool = leaves.where("not hot").select("gram", "row", "start", "paths").repartition("gram").sortWithinPartitions("gram")
    out = cool.mapInArrow(_subtrees, "row bigint, start int, repeats bigint")
    hot = leaves.where("hot").withColumn("string", F.xxhash64("paths"))
    strings = scratch.written(hot.groupBy("gram", "paths").agg(F.count(F.lit(1)).alias("c")), "strings")
    letters = strings.withColumn("string", F.xxhash64("paths")).select("gram", "string", "c", F.posexplode("paths").alias("bit", "path"))
    nodes = scratch.written(letters.groupBy("gram", "path").agg(F.sum("c").alias("c")).where("c > 1").select("gram", "path"), "nodes")
    found = letters.join(nodes, ["gram", "path"]).groupBy("gram", "string").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("repeats"))
    hot = hot.join(scratch.written(found, "found"), ["gram", "string"]).select("row", "start", "repeats")
    out = written(out.unionByName(hot), "repeats")
    scratch.close()
    return out


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], Words, np.ndarray]]:
    """Batches of text (column 0) and repeats (column 1), with their words and which of them are kept."""
    for batch, texts in text_chunks(batches, 0):
        w = Words(texts)
        edge = np.zeros(len(w.hash) + 1, np.int32)
        at = batch.column(1)
        of = np.repeat(np.arange(len(texts)), np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        flat = at.flatten()
        start, bits = w.first[of] + flat.field(0).to_numpy(), flat.field(1).to_numpy()
        for k in range(int(bits.max()).bit_length() if len(bits) else 0):
            s = start[(bits >> k) & 1 == 1] + k
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
        yield batch, texts, w, np.cumsum(edge[:-1]) == 0


def _with_repeats(docs: DataFrame, window: int, **options) -> DataFrame:
    """docs with the column repeats: where repeated windows start in the row's text."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = repeated_windows(_keyed(docs), window, **options)
    found = found.groupBy(F.col("row").alias("_of")).agg(F.collect_set(F.struct("start", "repeats")).alias("_repeats"))
    return keyed.join(found, F.col("_row") == F.col("_of"), "left").drop("_of", "_row")


def repeat_digests(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by blanks) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, w, keep in _kept(batches, window):
            n, kept = np.diff(w.first), np.add.reduceat(np.append(keep, False), w.first[:-1]) * (np.diff(w.first) > 0) if len(texts) else []
            digests = []
            for k, t in enumerate(texts):
                words = t.split()
                if kept[k] < n[k]:
                    words = [x for x, ok in zip(words, keep[w.first[k] : w.first[k + 1]].tolist()) if ok]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return _with_repeats(docs.select("doc_id", "text"), window, **options).select("text", "_repeats", "doc_id").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """docs with the repeated words cut out of text. What is kept stays as it was; where words were cut, one blank stands."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, w, keep in _kept(batches, window):
            out: list = []
            offset = np.cumsum([0] + [len(t) + 1 for t in texts])
            for k, t in enumerate(texts):
                own = keep[w.first[k] : w.first[k + 1]]
                if own.all():
                    out.append(batch.column(0)[k].as_py())
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                start, end = w.start[w.first[k] : w.first[k + 1]] - offset[k], w.end[w.first[k] : w.first[k + 1]] - offset[k]
                out.append(b" ".join([t[start[a] : end[b - 1]] for a, b in zip(edge[::2], edge[1::2])]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *others])

    marked = _with_repeats(docs, window, **options).select("text", "_repeats", *others)
    return marked.mapInArrow(run, marked.drop("_repeats").schema).select(*docs.columns)
