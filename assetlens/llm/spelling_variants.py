"""Spelling variants: words that differ by one inserted, deleted or replaced letter, by asymmetric q-chunks.

A word of l letters contributes two disjoint chunks, its first l // 2 letters and the rest; the other word, as long or one letter longer, contributes
positional grams. One edit lies in one of the chunks at most, so the other chunk is a gram of the other word, at its own
place or shifted by one: the first chunk at place 0, the second at its place or, in a longer word, one further. Of all positional grams only
these can meet, so only these are made: two per length. Candidates that share chunk and place are verified by their edit distance.

A chunk with more than ``hot`` grams isn't joined as it is. There the edit is placed too: each word contributes what is left of it without one letter
outside the chunk, with that letter's place, and a shorter word itself; what then shares a key differs in that letter only,
so a group holds no more words than there are letters.

Edge cases: null texts have no words; of a row with a null id no letter is deleted; runs of any length count whole; repeated rows count each time; a word without near words is
its own root; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.llm._shared import LOWER, UPPER
from assetlens.llm._words import text_chunks
from assetlens.scratch import Scratch, written

#: A run of letters, after A-Z have been lowered.
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Distinct words that a task counts before it sends them on.
HELD = 200_000


def runs_with_typos(doc_id: object, text: bytes, every: int | None) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts; a run whose crc32 with the id is divisible by ``every`` loses a letter."""
    counts = Counter(RUN.findall(text.translate(_LOWERED).decode("utf-8", "replace")))
    if every is None or doc_id is None:
        yield from counts.items()
        return
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, typo_every: int | None = 97) -> DataFrame:
    """word and n: words of at least least_letters letters that occur at least least_count times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch, texts in text_chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                for word, n in runs_with_typos(doc_id, text, typo_every):
                    if len(word) >= least_letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield sent()
                    held.clear()
        yield sent()

    return docs.select("doc_id", "text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(word, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def _keys(words: DataFrame, longer: int) -> DataFrame:
    """l, place and chunk for the words as grams of words with ``longer`` letters less: with 0 a word's own two chunks."""
    l = F.length("word") - longer  # noqa: E741
    half = F.floor(l / 2).cast("int")
    first, second = _part(F.col("word"), 1, half), _part(F.col("word"), half + 1 + longer, l - half)
    pair = F.array(F.struct(F.lit(0).alias("place"), first.alias("chunk")), F.struct(F.lit(1).alias("place"), second.alias("chunk")))
    return words.select("word", "n", l.alias("l"), F.explode(pair).alias("k")).select("l", "k.place", "k.chunk", "word", "n")


def _less_one(keys: DataFrame, longer: int) -> DataFrame:
    """For each letter outside the chunk what is left of the word without it, and the letter's place."""
    length = F.length("word")
    half = F.floor(F.col("l") / 2).cast("int")
    # the letters after a chunk at the start, or before one at the end
    start, end = F.when(F.col("place") == 0, half + 1).otherwise(1), F.when(F.col("place") == 0, length).otherwise(half + longer)
    at = keys.where(start <= end).select("l", "place", "word", "n", F.explode(F.sequence(start, end)).alias("at"))
    left = F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring(F.col("word"), F.col("at") + 1, F.length("word")))
    return at.select("l", "place", "word", "n", "at", F.xxhash64(left).alias("left"))


def near_pairs(words: DataFrame, scratch: Scratch, hot: int = 256) -> DataFrame:
    """u, nu, v and nv for each two near words, once. words: distinct, written."""
    chunks, grams = _keys(words, 0), _keys(words, 1)
    key = ["l", "place", "chunk"]
    full = chunks.select(*key).unionByName(grams.select(*key)).groupBy(*key).count().where(F.col("count") > hot).select(*key)
    full = scratch.written(full, "hot")
    calm = lambda df: df.join(full, key, "left_anti")
    busy = lambda df: scratch.written(df.join(full, key, "left_semi"), f"busy-{len(made)}")
    made: list[DataFrame] = []
    x = lambda df: df.withColumnsRenamed({"word": "u", "n": "nu"})
    y = lambda df: df.withColumnsRenamed({"word": "v", "n": "nv"})
    cold, cold_grams = calm(chunks), calm(grams)
    made.append(x(cold).join(y(cold), key).where("u < v"))
    made.append(x(cold).join(y(cold_grams), key))
    own = busy(chunks)
    less = _less_one(own, 0)
    made.append(x(less).join(y(less), ["l", "place", "at", "left"]).where("u < v"))
    longer = _less_one(busy(grams), 1)
    whole = own.select("l", "place", "word", "n", F.xxhash64("word").alias("left"))
    made.append(x(whole).join(y(longer), ["l", "place", "left"]))
    out = None
    for pairs in made:
        pairs = pairs.where(F.levenshtein("u", "v", 1) == 1).select("u", "nu", "v", "nv")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def with_roots(words: DataFrame, scratch: Scratch) -> DataFrame:
    """root for each word: where its forms end. Forms at least double n, so chains are short; each round doubles the steps taken."""
    steps = scratch.written(words.where("form is not null").select("word", F.col("form").alias("at")), "steps0")
    k = 0
    while True:
        next_step = steps.select(F.col("word").alias("at"), F.col("at").alias("beyond"))
        moved = scratch.written(steps.join(next_step, "at", "left").select("word", F.coalesce("beyond", "at").alias("at"), F.col("beyond").isNotNull().alias("moved")), f"steps{k + 1}")
        scratch.drop(f"steps{k}")
        k += 1
        if moved.where("moved").isEmpty():
            break
        steps = moved.select("word", "at")
    return words.join(moved.select("word", F.col("at").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, typo_every: int | None = 97, hot: int = 256) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of docs (doc_id, text).

    form is the near word of largest n, if that is twice the word's own or more. typo_every plants deletions, so that grouping can be measured; None plants none.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.written(word_counts(docs, least_letters, least_count, typo_every), "words")
    pairs = scratch.written(near_pairs(words, scratch, hot), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("m")), F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("m")))).alias("e")).select("e.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("top"))
    joined = words.join(near, "word", "left")
    strong = -F.col("top.less") >= 2 * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.near")).alias("form"), F.when(strong, -F.col("top.less")).alias("form_n"))
    joined = scratch.written(joined, "forms")
    out = written(with_roots(joined, scratch).select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    scratch.close()
    return out
