"""Order-preserving packing into fixed windows by dynamic programming.

The documents of a partition form one stream of tokens, in the table's order. Windows may be cut at document ends for
free, at sentence ends for ``sentence_cost`` and, inside stretches longer than ``stride`` without such an end, every
``stride`` tokens for ``word_cost``. With S(i) the tokens before cut i, the cheapest packing up to cut i is

    f(i) = cost(i) + min over j of f(j) + pad(S(i) - S(j)),   pad(n) = 0 where n is a power of two, else window - n.

The second case is window - S(i) + min(f(j) + S(j)) over the cuts within one window, a sliding minimum that a monotone
queue gives in constant time; the powers of two are looked up. A partition is solved in blocks of ``block`` tokens;
the last window of a block is carried into the next one, so a block's end costs nothing. What is left at the
end of a partition is cut into powers of two where that is cheaper than padding it.

Each worker takes its partition as a stream and holds one block and one document: no shuffle. Window numbers
are made of the partition's number and a running number, so they are unique.

Edge cases: a null text is empty and has only the closing id; a document longer than a window is cut into several
pieces; an empty table gives no rows; repeated rows are packed each; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assetlens.llm._words import KEPT, give_back, slices

#: Parts of words kept per worker in each of two generations, the longest that is kept, and bytes of text that are encoded at once.
CACHE, LONG, CHUNK = 200_000, 64, 1 << 21
#: Signs that the tokenizer parts from a letter before them, and two-byte letters that NFC and lower-casing leave letters.
SIGNS, LATIN = b".,;:!?#*$%&|()", rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: What the tokenizer takes as one part; letters and then signs, which are two. Marks are no letters, and the tokenizer makes them of U+0130 and of letters that aren't NFC.
ONE_PART = re.compile(rb"(?:[a-z]|%s)+|[%s]+" % (LATIN, SIGNS))
LETTERS = re.compile(r"([^\W\d_\u0130]+)([.,;:!?#*$%&|()]*)")
SPACE, LETTER, SIGN, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[97:123] = LETTER
_KIND[list(SIGNS)] = SIGN
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Pool:
    """Runs of ids one after the other: run k is ids[stops[k] : stops[k + 1]]."""

    def __init__(self):
        self.ids, self.stops, self.n = np.zeros(1 << 14, "<u4"), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Appends runs, and returns their numbers."""
        n, size = self.n + len(lengths), self.stops[self.n]
        if n >= len(self.stops):
            self.stops = np.append(self.stops, np.zeros(n, np.int64))
        if size + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(size + len(ids), "<u4"))
        self.ids[size : size + len(ids)] = ids
        self.stops[self.n + 1 : n + 1] = size + np.cumsum(lengths)
        numbers, self.n = np.arange(self.n, n), n
        return numbers

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs with these numbers, and the runs' lengths."""
        start = self.stops[numbers]
        lengths = self.stops[numbers + 1] - start
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(start - before, lengths) + np.arange(lengths.sum())], lengths


class Kept:
    """A bounded cache: numbers of runs in a pool by word, in two generations, the older one dropped when the newer is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old, self.pool, self.older = most, {}, {}, Pool(), Pool()

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.new, self.old, self.pool, self.older = {}, self.new, Pool(), self.pool


class WordEncoder:
    """Token ids of whole texts; a part of a word has its ids from the library once while it stays in a bounded cache.

    Texts are cut at blanks and between a letter and a sign, where the tokenizer always cuts; equal parts of many texts are told by
    Arrow's dictionary encoding, so a part is looked up once per CHUNK of text, and ids are gathered by numpy.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.words = Kept(CACHE)
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.sentence_end = np.zeros(len(self.closes), bool)
        self.sentence_end[[vocab[t] for t in (".</w>", "!</w>", "?</w>", "...</w>") if t in vocab]] = True
        self.special = list({t.content.encode()[:2] for t in self.library.get_added_tokens_decoder().values()})

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has."""
        runs = self._whole([w.decode() for w in words])
        return np.frombuffer(b"".join(runs), "<u4"), np.array([len(r) // 4 for r in runs], np.int64)

    def _joined(self, words: list[bytes], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of so many parts, encoded as one text: each part ends with the only token that closes it."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops, last = np.flatnonzero(self.closes[ids]) + 1, np.cumsum(parts)
        if len(stops) != last[-1]:
            return self._alone(words)
        return ids, np.diff(stops[last - 1], prepend=0)

    def _learn(self, missing: list[bytes]) -> np.ndarray:
        """Numbers of the runs of words that the newer generation doesn't have. Long words' runs are the pool's last and have no entry."""
        w, numbers = self.words, np.fromiter(map(self.words.old.get, missing, repeat(-1)), np.int64, len(missing))
        at = np.flatnonzero(numbers >= 0)
        groups = [(at, w.older.take(numbers[at]))]
        known, joined, parts, odd, long = at.tolist(), [], [], [], []
        for k in np.flatnonzero(numbers < 0).tolist():
            word = missing[k]
            if len(word) >= LONG:
                long.append(k)
            elif ONE_PART.fullmatch(word):
                joined.append(k)
                parts.append(1)
            elif not word.isascii() and is_normalized("NFC", t := word.decode()) and (m := LETTERS.fullmatch(t)):
                joined.append(k)
                parts.append(2 if m[2] else 1)
            else:
                odd.append(k)
        for i in range(0, len(joined), 500):
            groups.append((joined[i : i + 500], self._joined([missing[k] for k in joined[i : i + 500]], parts[i : i + 500])))
        groups += [(g, self._alone([missing[k] for k in g])) for g in (odd, long)]
        for g, (ids, lengths) in groups:
            numbers[g] = w.pool.add(ids, lengths)
        for g in (known, joined, odd):
            w.new.update(zip([missing[k] for k in g], numbers[g].tolist()))
        return numbers

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids. ASCII letters are lower-cased before the lookup, as the tokenizer itself does."""
        self.words.turn()
        special = {k: self._whole([t.decode()])[0] for k, t in enumerate(texts) if any(s in t for s in self.special)}
        texts = [b"" if k in special else t for k, t in enumerate(texts)]
        raw = np.frombuffer(b" ".join(texts).lower(), np.uint8)
        kind = _KIND[raw]
        inside = kind != SPACE
        letter = kind == LETTER
        two = np.flatnonzero(raw[:-1] == 0xC3) + 1
        letter[two[(raw[two] != 0x97) & (raw[two] != 0xB7)]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (letter[:-1] & (kind[1:] == SIGN))
        data = raw[inside]
        offsets = np.append(np.flatnonzero(begins[inside]), len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        words = parts.dictionary.to_pylist()
        numbers = np.fromiter(map(self.words.new.get, words, repeat(-1)), np.int64, len(words))
        lacking, pool = np.flatnonzero(numbers < 0), self.words.pool
        if len(lacking):
            numbers[lacking] = self._learn([words[k] for k in lacking.tolist()])
        ids, lengths = pool.take(numbers[parts.indices.to_numpy()])
        pool.n = len(self.words.new)  # without the long words' runs
        first = np.searchsorted(np.flatnonzero(begins), np.cumsum([0] + [len(t) + 1 for t in texts]))
        stops = np.append(0, np.cumsum(lengths))[first].tolist()
        return [special[k] if k in special else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(stops, stops[1:]))]


def candidate_cuts(sizes: np.ndarray, sentence_ends: np.ndarray, stride: int, sentence_cost: float, word_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and costs of the cuts of one block: sizes are the documents' token counts, sentence_ends places in the block."""
    document_ends = np.cumsum(sizes)
    stops = np.union1d(sentence_ends, document_ends)
    cost = np.where(np.isin(stops, document_ends, assume_unique=True), 0.0, sentence_cost)
    before = np.append(0, stops[:-1])
    inside = (stops - before - 1) // stride
    if inside.any():
        k = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
        inner = np.repeat(before, inside) + stride * (k + 1)
        place = np.append(inner, stops)
        order = np.argsort(place, kind="stable")
        stops, cost = place[order], np.append(np.full(len(inner), word_cost), cost)[order]
    return np.append(0, stops), np.append(0.0, cost)


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """The places at which the cheapest packing cuts, first and last included. Neighbouring places are at most a window apart."""
    S, C = places.tolist(), costs.tolist()
    exact: dict[int, list[int]] = {}  # for a cut, those that lie a power of two before it
    for p in [1 << k for k in range(window.bit_length()) if 1 << k <= window]:
        j = np.searchsorted(places, places - p)
        for i, k in zip(*(x.tolist() for x in (np.flatnonzero(places[j] == places - p), j[places[j] == places - p]))):
            exact.setdefault(i, []).append(k)
    f, came = [0.0] * len(S), [0] * len(S)
    queue: deque[int] = deque([0])  # cuts within a window, f + S rising
    for i in range(1, len(S)):
        s = S[i]
        while S[queue[0]] < s - window:
            queue.popleft()
        j = queue[0]
        best, at = f[j] + S[j] - s + window, j
        for j in exact.get(i, ()):
            if f[j] < best:
                best, at = f[j], j
        f[i] = value = best + C[i]
        came[i] = at
        value += s
        while queue and f[queue[-1]] + S[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    out, i = [S[-1]], len(S) - 1
    while i:
        i = came[i]
        out.append(S[i])
    return out[::-1]


def tail_cuts(n: int, window: int, cut_cost: float) -> list[int]:
    """Lengths that n tokens are cut into at a partition's end: whole windows, then powers of two and at most one padded rest."""
    out, rest = [window] * (n // window), n % window
    best, parts, left, chosen = float("inf"), [], rest, []
    while left:
        padded = cut_cost * len(chosen) + (0 if left & (left - 1) == 0 else window - left)
        if padded < best:
            best, parts = padded, [*chosen, left]
        chosen.append(1 << (left.bit_length() - 1))
        left -= chosen[-1]
    return out + parts


def pack_partition(batches: Iterator[pa.RecordBatch], tokenizer_file: str, closing: int, window: int, block: int, stride: int, sentence_cost: float, word_cost: float, with_ids: bool) -> Iterator[pa.RecordBatch]:
    give_back()  # what an operator before held in this worker
    e = _encoder(tokenizer_file)
    closing_bytes = np.array([closing], "<u4").tobytes()
    number = TaskContext.get().partitionId() << 40
    held: list[list] = []  # of the open block: [key, ids as bytes, from which token on]
    size = 0

    def emit(cuts: list[int]):
        """Pieces of the held documents between neighbouring cuts; what lies after the last cut stays held."""
        nonlocal held, size, number
        rows, at, d = [], 0, 0
        for lo, hi in zip(cuts, cuts[1:]):
            offset = 0
            while lo < hi:
                key, ids, first = held[d]
                n = len(ids) // 4
                take = min(hi - lo, n - first)
                piece = ids[4 * first : 4 * (first + take)]
                rows.append((key, first, take, zlib.crc32(piece), n, number, offset, piece))
                held[d][2] = first + take
                d += held[d][2] == n
                lo, offset = lo + take, offset + take
            number += 1
        size -= cuts[-1] - cuts[0]
        held = held[d:]
        return rows

    def solve(last: bool):
        sizes = np.array([len(ids) // 4 - first for _, ids, first in held])
        ids = np.frombuffer(b"".join([ids[4 * first :] for _, ids, first in held]), "<u4")
        ends = np.flatnonzero(e.sentence_end[ids]) + 1
        cuts = best_cuts(*candidate_cuts(sizes, ends, stride, sentence_cost, word_cost), window)
        if not last:
            return emit(cuts[:-1]) if len(cuts) > 2 else []
        tail = tail_cuts(cuts[-1] - cuts[-2], window, word_cost)
        return emit(cuts[:-1] + (cuts[-2] + np.cumsum(tail)).tolist())

    def batch_of(keys: pa.Array | None, rows: list) -> pa.RecordBatch:
        cols = [pa.array([r[0] for r in rows], key_type)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7)]
        names = ["doc_id", *COLUMNS]
        if with_ids:
            cols.append(pa.array([np.frombuffer(r[7], "<i4") for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    key_type = pa.int64()
    for batch in batches:
        key_type = batch.schema.field(0).type
        for part, texts in slices(iter([batch]), chunk=CHUNK, rows=2048):
            for key, ids in zip(part.column(0).to_pylist(), e.encode(texts)):
                ids += closing_bytes
                held.append([key, ids, 0])
                size += len(ids) // 4
                if size >= block and (rows := solve(False)):
                    yield batch_of(None, rows)
    if held:
        yield batch_of(None, solve(True))


_encoders: dict[str, WordEncoder] = {}


KEPT.append(lambda: _encoders.clear())


def _encoder(tokenizer_file: str) -> WordEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def pack(docs: DataFrame, tokenizer_file: str, closing: int = 1, window: int = 2048, block: int = 1 << 18, stride: int = 64, sentence_cost: float = 2.0, word_cost: float = 24.0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for. docs: doc_id, text."""

    def run(batches):
        return pack_partition(batches, tokenizer_file, closing, window, block, stride, sentence_cost, word_cost, with_ids)

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, " + ", ".join(f"{c} bigint" for c in COLUMNS) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
