"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text becomes symbols (characters, blanks as U+2581, one in front). The agenda holds each adjacent pair whose
concatenation is a piece; the best-scored pair, the leftmost among equals, is merged until none is left. Symbols that
are no piece become byte pieces. No piece has U+2581 after another character, so a text's segments (a run of U+2581
and what follows up to the next) are encoded independently, and equal segments once per worker while they stay in a
bounded cache. Short segments run in lockstep: each round takes the top of every segment's agenda at once; long ones
use a heap. The sentencepiece library encodes each new segment of an Arrow batch too. Where the two differ the
library's ids count, and encode_digests() returns the number of such segments in n_differences, at the first row of the slice of rows in which
they were new: its sum over all rows is 0 unless the agenda is wrong.

Edge cases: a null text is empty and has only the begin and end ids; empty tables give no rows; repeated rows are
encoded each; texts of any length are encoded whole; the output has only the columns named, so others can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assetlens.llm._words import KEPT, slices

MARK = "▁"
#: Segments kept per worker in each of two generations, and the longest that is kept or runs in lockstep.
CACHE, LONG = 400_000, 48
#: Words that the library checks at once, and the multiplier of the pair table's hash.
CHECKED, MIX = 256, np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 62


class PieceEncoder:
    def __init__(self, model_file: str, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check, self.differences = check, 0
        size = self.size = sp.get_piece_size()
        if sp.encode("a  b", out_type=str)[0][:1] != MARK or sp.decode(sp.encode(" a  b ")) != " a  b ":
            raise ValueError("the model must keep blanks and put one in front")
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in usable}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces with a blank after another character aren't supported")
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.symbols = dict(pieces)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, len(self.symbols) - len(pieces) + size)
        score = np.array([sp.get_score(i) for i in range(size)])
        rank_of = {s: k for k, s in enumerate(sorted({score[i] for i in usable}, reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (rank_of[score[i]], i)
        self.base = np.int64(len(self.symbols) + size + 1)
        # the pairs as an open-addressing table, so that a whole array of pairs is looked up at once
        bits = max(4, (4 * len(self.pairs) + 1).bit_length())
        self.shift, self.probes = np.uint64(64 - bits), 1
        self.keys, self.ranks, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER >> 32, np.int64), np.full(1 << bits, -1, np.int64)
        for (x, y), (r, i) in self.pairs.items():
            key = x * int(self.base) + y
            at, n = ((key * int(MIX)) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & ((1 << bits) - 1), n + 1
            self.keys[at], self.ranks[at], self.merged[at], self.probes = key, r, i, max(self.probes, n)
        self.by_char = np.full(0x110000, -1, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.by_char[ord(c)] = i
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left * self.base + right, -2)
        at = ((key.view(np.uint64) * MIX) >> self.shift).astype(np.int64)
        for _ in range(self.probes - 1):
            on = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
            if not len(on):
                break
            at[on] = (at[on] + 1) & (len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER >> 32), np.where(hit, self.merged[at], -1)

    def _ids(self, symbols, chars) -> bytes:
        out = array("I")
        for s, c in zip(symbols, chars):
            if 0 <= s < self.size:
                out.append(s)
            else:
                out.extend(self.bytes_at + b for b in chr(c).encode())
        return out.tobytes()

    def by_heap(self, segment: str) -> bytes:
        """One segment with a heap as its agenda; entries of symbols that have changed since are skipped."""
        chars = [ord(c) for c in segment]
        sym = [int(self.by_char[c]) for c in chars]
        n = len(sym)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(agenda, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = after[i]
            if not live[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], live[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        keep = [i for i in range(n) if live[i]]
        return self._ids([sym[i] for i in keep], [chars[i] for i in keep])

    def in_lockstep(self, segments: list[str]) -> list[bytes]:
        """Many short segments: in each round, every segment merges the top pair of its agenda."""
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        char = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        seg, sym = np.repeat(np.arange(len(segments)), lens), self.by_char[char]
        rank, made = self._pairs_of(seg, sym)
        done: list[tuple] = []
        while len(seg):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat((rank << 32) | np.arange(len(seg)), starts)
            over = best >= NEVER
            if over.any():
                stop = np.repeat(over, np.diff(np.r_[starts, len(seg)]))
                done.append((seg[stop], sym[stop], char[stop]))
                seg, sym, char, rank, made = (x[~stop] for x in (seg, sym, char, rank, made))
                if not len(seg):
                    break
                starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                best = np.minimum.reduceat((rank << 32) | np.arange(len(seg)), starts)
            at = best & 0xFFFFFFFF
            sym[at] = made[at]
            keep = np.ones(len(seg), bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))  # one symbol has gone before each of the later ones
            seg, sym, char, rank, made = (x[keep] for x in (seg, sym, char, rank, made))
            for near in (new_at, new_at[new_at > 0] - 1):
                nxt = np.minimum(near + 1, len(seg) - 1)
                r, m = self._look_up(sym[near], sym[nxt])
                r[(nxt == near) | (seg[near] != seg[nxt])] = NEVER >> 32
                rank[near], made[near] = r, m
        seg, sym, char = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(seg, kind="stable")
        seg, sym, char = seg[order], sym[order], char[order]
        cuts = np.searchsorted(seg, np.arange(len(segments) + 1))
        flat = sym.astype(np.uint32).tobytes()
        odd = {int(s) for s in seg[(sym < 0) | (sym >= self.size)]}
        return [self._ids(sym[cuts[i] : cuts[i + 1]].tolist(), char[cuts[i] : cuts[i + 1]].tolist()) if i in odd else flat[4 * cuts[i] : 4 * cuts[i + 1]] for i in range(len(segments))]

    def _pairs_of(self, seg: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(seg), NEVER >> 32, np.int64), np.full(len(seg), -1, np.int64)
        if len(seg) > 1:
            r, m = self._look_up(sym[:-1], sym[1:])
            same = seg[:-1] == seg[1:]
            rank[:-1][same], made[:-1][same] = r[same], m[same]
        return rank, made

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, without begin and end, as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            words = t.split(" ") if t else []
            if MARK in t or "" in words:
                words = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))]
            cut.append(words)
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new, own = [], {}
        for w in {w for words in cut for w in words if w not in cache}:
            if w in older:
                cache[w] = older[w]
            else:
                new.append(w)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            short = [w for w in part if len(w) < LONG]
            found = dict(zip(short, self.in_lockstep([MARK + w for w in short]))) if short else {}
            found |= {w: self.by_heap(MARK + w) for w in part if len(w) >= LONG}
            if self.check:
                self._checked(found)
            for w, ids in found.items():
                (cache if len(w) < LONG else own)[w] = ids
        if own:
            return [b"".join([cache[w] if w in cache else own[w] for w in words]) for words in cut]
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def _checked(self, found: dict[str, bytes]) -> None:
        """Holds the segments against the library, many at once; only where a run differs, one by one."""

        def theirs(words: list[str]) -> bytes:
            ids = self.library.encode(" ".join(words).replace(MARK, " "))
            return struct.pack(f"<{len(ids)}I", *ids)

        words = [w for w in found if w]
        for k in range(0, len(words), CHECKED):
            part = words[k : k + CHECKED]
            if theirs(part) != b"".join([found[w] for w in part]):
                for w in part:
                    if (ids := theirs([w])) != found[w]:
                        self.differences += 1
                        found[w] = ids


_encoders: dict[str, PieceEncoder] = {}


KEPT.append(lambda: _encoders.clear())


def encoder(model_file: str) -> PieceEncoder:
    """One per worker process."""
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for part, texts in slices(batches):
        yield part.column(0), [t.decode() for t in texts]


def encode_ids(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int), with the begin and end ids."""

    def run(batches):
        e = encoder(model_file)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (e.library.bos_id(), e.library.eos_id()))
        for keys, texts in _slices(batches):
            ids = [np.frombuffer(bos + x + eos, "<i4") for x in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>")


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and n_differences; the ids stay in the worker, which decodes them with the library."""

    def run(batches):
        e = encoder(model_file)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (e.library.bos_id(), e.library.eos_id()))
        for keys, texts in _slices(batches):
            before = e.differences
            ids = [bos + x + eos for x in e.encode(texts)]
            differ = [e.differences - before] + [0] * (len(ids) - 1)
            decoded = [e.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array(differ, pa.int64()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_differences"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_differences bigint")


def decode_ids(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and text, by the library's decode()."""

    def run(batches):
        e = encoder(model_file)
        for batch in batches:
            texts = [e.library.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")
