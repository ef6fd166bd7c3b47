"""N-gram Jaccard self-join by a token-group matrix: which documents are linked at 100 * common >= percent * united.

1. Every text's set of word shingles is hashed. Counts of shingles in a fixed table (all documents, a few million
   counters) order the shingles from rare to frequent, ties by hash. A document's lead is its first
   n - ceil(percent n / 100) + 8 shingles in that order; two linked documents share 8 shingles of their leads, or as
   many as either one needs for a link if those are fewer.
2. Documents with equal sets are one class. A class that shares fewer of its lead shingles than that with classes of like
   size links with nothing: lead shingles are shuffled once, but for those whose counter is so high that one may be in
   very many leads; these are counted first and joined.
   Whole sets are made again from the texts for the documents that a later step compares, and only for those.
3. Each class is checked against one pivot for each of two pairs of min-hashes (a few where very many classes have the
   pair); what links makes the first components.
4. Classes are put into groups of similar ones, of bounded number and about equal set size: those of a component,
   else those that share their commonest lead shingle; within these, those with the same rarest one. The matrix holds each group's lead shingles, and a group's
   union of whole sets travels with it.
5. A query meets a group only through enough common lead shingles (the more, the closer the sizes are: may_link()), in a compatible size, if the group isn't all of the query's own
   component, and from the smaller component's side. If the query has fewer shingles in the union than a link
   needs, the group stays closed; else its members are compared exactly. Links between components join them.

So every link is either found or lies inside a component that other links already join. Hot groups: classes take out
copies, components take out near copies, groups and their queries are dealt out in blocks of bounded size, and the
joins on shingles may be split by size.

Edge cases: a null or wordless text has an empty set and links with nothing; a text with fewer words than a shingle has its
whole sequence as one; equal sets link; rows with a null id link with nothing and come back as their own component (null); repeated rows
come back each; rows with one id and unlike texts are one document as to links, whose component has the smallest id that any of its texts reaches, and each row has its own n_shingles; an empty table gives no rows; texts of any length count whole.
Sets hold 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.llm._components import components
from assetlens.llm._shared import BROADCAST_IDS, rows_with_ids
from assetlens.llm._words import Words, mixed, sums_of_runs, text_chunks
from assetlens.scratch import Scratch, written

#: Counters of the shingle table (a bounded broadcast of 16 MB), how many of them make a row while they are added up, and shingles that leads must have in common.
#: Any order of shingles gives right leads. On a large corpus each counter holds many shingles; the table then sets the frequent ones apart, which is what keeps leads selective.
COUNTERS, ROW, SHARED = 1 << 22, 1 << 13, 8
PLACE = np.uint64(64 - COUNTERS.bit_length() + 1)
#: A shingle whose counter is higher may be in so many leads that its rows should be split; a counter is never too low.
HEAVY = 100_000


@dataclass(frozen=True)
class Limits:
    """Sizes of the work that one task gets; the links found don't depend on them."""

    pivots: int = 8  # of a min-hash pair that more than `large` documents have
    large: int = 64
    members: int = 48  # most members of a group, and most queries that meet one group in one task, on average
    queries: int = 1500
    ids: int = BROADCAST_IDS  # most ids that are broadcast
    heavy: int = HEAVY  # a shingle's counter beyond which its rows may be split


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, sorted by both."""
    w = Words(texts, lower=True)
    starts, hashes = w.windows(n)
    of = w.of[starts]
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        of = np.append(of, short)
        hashes = np.append(hashes, sums_of_runs(w.hash, w.first[short], w.first[short + 1]))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents each counter's shingles occur: COUNTERS numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, texts in text_chunks(batches, 0):
            np.add.at(total, (shingle_sets(texts, n)[1] >> PLACE).astype(np.int64), 1)
        # a byte per counter, and what doesn't fit beside it: sums stay exact
        low, over = np.minimum(total, 255).astype(np.uint8), np.maximum(total - 255, 0)
        rows = [k for k in range(COUNTERS // ROW) if low[k * ROW : (k + 1) * ROW].any()]
        cells = [low[k * ROW : (k + 1) * ROW].tobytes() for k in rows]
        more = [np.flatnonzero(over[k * ROW : (k + 1) * ROW]) for k in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cells, pa.binary()), pa.array(more, pa.list_(pa.int64())), pa.array([over[k * ROW + at] for k, at in zip(rows, more)], pa.list_(pa.int64()))], names=["row", "counts", "at", "over"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k, x, at, over in zip(*(batch.column(c).to_pylist() for c in range(4))):
                part = sums.setdefault(k, np.zeros(ROW, np.int64))
                part += np.frombuffer(x, np.uint8)
                part[at] += np.array(over, np.int64)
        cells = [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(cells, pa.binary())], names=["row", "counts"])

    out = np.zeros(COUNTERS, np.uint32)
    parts = docs.select("text").mapInArrow(count, "row int, counts binary, at array<bigint>, over array<bigint>")
    for r in parts.repartition(COUNTERS // ROW, "row").mapInArrow(add, "row int, counts binary").collect():
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["counts"], "<u4")
    return out


def signatures(docs: DataFrame, n: int, percent: int, counts: np.ndarray, most: int = HEAVY) -> DataFrame:
    """doc_id, n, k1 and k2 (a hash of the set), m1 and m2 (hashes of pairs of min-hashes), lead in order, and heavy (from which place on its shingles are heavy)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    salts = np.random.default_rng(5).integers(1, 1 << 63, 4).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            of, h = shingle_sets(texts, n)
            size = np.bincount(of, minlength=len(texts))
            first = np.cumsum(size) - size
            some = np.flatnonzero(size)
            keys = np.zeros((4, len(texts)), np.int64)
            if len(some):
                keys[0, some] = np.add.reduceat(mixed(h), first[some]).astype(np.int64)
                keys[1, some] = np.add.reduceat(mixed(h ^ np.uint64(0xABCDEF0123456789)), first[some]).astype(np.int64)
                low = [np.minimum.reduceat(mixed(h ^ s), first[some]) for s in salts]
                keys[2, some] = mixed(low[0] + mixed(low[1])).astype(np.int64)
                keys[3, some] = mixed(low[2] + mixed(low[3])).astype(np.int64)
            often = shared.value[(h >> PLACE).astype(np.int64)]
            order = np.lexsort((h, often, of))
            heavy = np.bincount(of, often <= most, len(texts)).astype(np.int32)
            lead = np.minimum(size, size - (-(-percent * size // 100)) + SHARED)
            place = np.arange(len(h)) - np.repeat(first, size)
            taken = h[order][place < np.repeat(lead, size)].astype(np.int64)
            cols = [pa.array(size, pa.int64()), *[pa.array(k, pa.int64()) for k in keys], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lead)), pa.int32()), pa.array(taken)), pa.array(heavy)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n", "k1", "k2", "m1", "m2", "lead", "heavy"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, m1 bigint, m2 bigint, lead array<bigint>, heavy int")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and set, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            of, h = shingle_sets(texts, n)
            s = h.astype(np.int64)
            s = s[np.lexsort((s, of))]
            cuts = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(s))], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, set array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, n: int, scratch: Scratch, name: str, limits: Limits) -> DataFrame:
    """The whole sets of the documents in ids (doc_id), written."""
    ids = scratch.written(ids.distinct(), f"{name}-ids")
    out = scratch.written(whole_sets(rows_with_ids(docs, ids, "doc_id", limits.ids), n), name)
    scratch.drop(f"{name}-ids")
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def shared_leads(reps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n and leads (at, t, heavy; in order) of the classes that may link: the lead shingles that others of like size have too, if they are enough for a link; written."""
    lead = reps.select("doc_id", "n", "heavy", F.posexplode("lead").alias("at", "t")).withColumn("heavy", F.col("at") >= F.col("heavy"))
    # rows of a shingle that few leads can hold meet in one task, and one shuffle tells which are shared; the others are counted and joined
    sizes = W.partitionBy("t").orderBy("n")
    light = lead.where("not heavy").drop("heavy").withColumns({"below": F.lag("n").over(sizes), "above": F.lead("n").over(sizes)}).where(f"100 * below >= {percent} * n or 100 * n >= {percent} * above")
    heavy = lead.where("heavy")
    common = scratch.written(heavy.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"), "common")
    columns = ["t", "doc_id", "n", "at", "heavy"]
    leads = light.withColumn("heavy", F.lit(False)).select(*columns).unionByName(heavy.join(common, "t").select(*columns))
    leads = leads.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("at", "t", "heavy"))).alias("leads"))
    # a link is of percent * n / 100 shingles at least, and SHARED of them are in both leads or all
    out = scratch.written(leads.where(f"100 * size(leads) >= least({100 * SHARED}, {percent} * n)"), "leads")
    scratch.drop("common")
    return out


def may_link(common: str, n: str, lo: str, hi: str, percent: int) -> str:
    """SQL: whether a set of n shingles with so many common lead shingles may link with one of lo to hi shingles.

    Sets of n and m link by o >= p (n + m) / (100 + p) common shingles. Of the two leads take the one that ends first: what it
    has of them is in the other lead too, and it lacks ceil(p max(n, m) / 100) - SHARED at most. So common >= o, or common >
    SHARED - 1 + p (n + m) / (100 + p) - p max(n, m) / 100; over the sizes m that can link, the latter is least at an end.
    """
    lo, hi = f"greatest({lo}, ceil({percent} * {n} / 100))", f"least({hi}, floor(100 * {n} / {percent}))"
    least = ", ".join(f"{100 * percent} * ({n} + {m}) - {percent * (100 + percent)} * greatest({n}, {m})" for m in (lo, hi))
    return f"({100 + percent} * {common} >= {percent} * ({n} + {lo}) or {100 * (100 + percent)} * ({common} - {SHARED - 1}) > least({least}))"


def pivot_links(sigs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, limits: Limits) -> DataFrame:
    """Links (a, b) between a document and the pivots of its min-hash pairs: the smallest ids that have the pair."""
    key = F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("m1").alias("m")), F.struct(F.lit(2).alias("t"), F.col("m2").alias("m"))))
    keyed = sigs.select("doc_id", "n", key.alias("key"))
    # the smallest id of each of a few parts of a key's documents; a small key has one pivot, a large one all of them
    parts = keyed.groupBy("key", F.pmod(F.xxhash64("doc_id"), F.lit(limits.pivots)).alias("part")).agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("p"), F.count(F.lit(1)).alias("c"))
    pivots = parts.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sum("c").alias("c")).where("c > 1")
    pivots = pivots.select("key", F.explode(F.when(F.col("c") > limits.large, F.col("ps")).otherwise(F.slice("ps", 1, 1))).alias("p"))
    pivots = scratch.written(pivots, "pivots")  # a table: so the join may split a key that very many documents have
    pairs = keyed.join(pivots, "key").where(f"doc_id <> p.doc_id and 100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    pairs = scratch.written(pairs.select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    scratch.drop("pivots")
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), words, scratch, "pivot-sets", limits)
    sa, sb = (sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = _common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = scratch.written(pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")
    scratch.drop("pairs", "pivot-sets")
    return out


def group_links(leads: DataFrame, docs_text: DataFrame, first: DataFrame, words: int, percent: int, scratch: Scratch, limits: Limits) -> DataFrame:
    """Links (a, b) between components of first (node, component) by the token-group matrix. leads: as of shared_leads()."""
    docs = leads.select("doc_id", "n", F.element_at("leads", 1)["t"].alias("rarest"), F.element_at("leads", -1)["t"].alias("commonest"))
    docs = docs.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    sizes = docs.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("comp_size"))
    docs = docs.join(sizes, "component", "left").withColumn("comp_size", F.coalesce("comp_size", F.lit(1)))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    docs = docs.select("doc_id", "n", "comp", "comp_size", "rarest", F.struct(F.col("component").isNotNull().alias("linked"), F.coalesce("component", "commonest").alias("v"), band.alias("band")).alias("family"))
    near = docs.groupBy("family", "rarest").agg(F.count(F.lit(1)).alias("near"))
    families = near.groupBy("family").agg(F.sum("near").alias("c"))
    # documents with the same rarest shingle share a block of their family, unless they alone fill one
    dealt = F.xxhash64(F.when(F.col("near") > limits.members, F.col("doc_id")).otherwise(F.col("rarest")))
    docs = docs.join(near, ["family", "rarest"]).join(families, "family").withColumn("block", F.xxhash64("family", F.pmod(dealt, F.ceil(F.col("c") / limits.members))))
    docs = scratch.written(docs.select("doc_id", "n", "comp", "comp_size", F.col("family.linked").alias("linked"), "block"), "grouped")
    columns = ["t", "doc_id", "n", "comp", "comp_size", "block"]
    rows = leads.select("doc_id", "leads").join(docs, "doc_id").select(F.explode("leads").alias("l"), *columns[1:]).select("l.t", "l.heavy", *columns[1:])
    # shingles of one component only can't lead to a new link
    light = rows.where("not heavy").withColumns({"lo": F.min("comp").over(W.partitionBy("t")), "hi": F.max("comp").over(W.partitionBy("t"))}).where("lo <> hi")
    heavy = rows.where("heavy")
    open_tokens = scratch.written(heavy.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t"), "open")
    rows = scratch.written(light.select(*columns).unionByName(heavy.join(open_tokens, "t").select(*columns)), "matrix")
    scratch.drop("open")
    matrix = rows.groupBy("t", "block").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("comp").alias("c_min"), F.max("comp").alias("c_max"), F.max("comp_size").alias("c_size"))
    q = rows.select("t", F.col("doc_id").alias("q"), F.col("n").alias("qn"), F.col("comp").alias("qc"), F.col("comp_size").alias("qs"))
    met = q.join(matrix, "t").where(
        f"""100 * n_max >= {percent} * qn and {percent} * n_min <= 100 * qn and not (c_min = c_max and c_min = qc)
            and (c_size > qs or (c_size = qs and c_max > qc))"""
    )
    pairs = met.groupBy("block", "q").agg(F.first("qn").alias("qn"), F.first("qc").alias("qc"), F.min("n_min").alias("lo"), F.max("n_max").alias("hi"), F.count(F.lit(1)).alias("common"))
    pairs = scratch.written(pairs.where(may_link("common", "qn", "lo", "hi", percent)).select("block", "q", "qc"), "met")
    scratch.drop("matrix")
    open_blocks = docs.join(pairs.select("block").distinct(), "block")
    sets = sets_of(docs_text, open_blocks.select("doc_id").unionByName(pairs.select(F.col("q").alias("doc_id"))), words, scratch, "group-sets", limits)
    load = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / limits.queries).alias("parts"))
    queries = pairs.join(load, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
    queries = queries.select("block", "part", F.lit(1).alias("asks"), F.col("q").alias("doc_id"), F.col("qc").alias("comp"))
    members = docs.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.select("block", "part", F.lit(0).alias("asks"), "doc_id", "comp")
    dealt = members.unionByName(queries).join(sets, "doc_id").select("block", "part", "asks", F.col("doc_id").alias("id"), "comp", "set")
    dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, union = None, [], None
        for batch in batches:
            block, part, asks, ids, comps = (batch.column(k).to_pylist() for k in range(5))
            out: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                if (block[k], part[k]) != now:
                    now, members, union = (block[k], part[k]), [], None
                s = batch.column(5)[k].values.to_numpy()
                if not asks[k]:
                    members.append((ids[k], comps[k], s.copy()))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m[2] for m in members]))
                least = -(-percent * len(s) // 100)
                if _common(s, union) < least:  # the bound: the group stays closed
                    continue
                joined = {comps[k]}
                for i, c, m in members:
                    if c not in joined and 100 * min(len(m), len(s)) >= percent * max(len(m), len(s)):
                        both = _common(s, m)
                        if 100 * both >= percent * (len(s) + len(m) - both):
                            joined.add(c)
                            out.append((i, ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    out = scratch.written(dealt.mapInArrow(run, "a bigint, b bigint"), "group-links")
    scratch.drop("grouped", "met", "group-sets")
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked id) for each row of docs (doc_id: long, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "ngram-join")
    counts = shingle_counts(docs, words)
    whole = scratch.written(signatures(docs, words, percent, counts, limits.heavy), "signatures")
    sigs = scratch.written(whole.select("doc_id", "n", "k1", "k2"), "keys")
    sound = whole.where("n > 0 and doc_id is not null")
    if not sigs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        scratch.drop("signatures", "keys")
        return _of_repeated_ids(docs, words, percent, limits, scratch)
    # of each class its smallest id; the leads stay where they are
    first_ids = scratch.written(sound.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "first-ids")
    reps = scratch.written(rows_with_ids(sound, first_ids, "doc_id", limits.ids), "classes")
    scratch.drop("signatures", "first-ids")
    keys = scratch.written(reps.select("n", "k1", "k2", "doc_id", "m1", "m2"), "reps")
    leads = shared_leads(reps, percent, scratch)
    scratch.drop("classes")
    links = pivot_links(keys.join(leads.select("doc_id"), "doc_id").select("doc_id", "n", "m1", "m2"), docs, words, percent, scratch, limits)
    first = components(links, scratch, "first")
    more = group_links(leads, docs, first, words, percent, scratch, limits)
    scratch.drop("leads")
    last = components(links.unionByName(more), scratch, "last")
    members = keys.join(last.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.select("n", "k1", "k2", F.coalesce("component", "doc_id").alias("component"))
    out = sigs.join(members.withColumnsRenamed({"n": "rn", "k1": "r1", "k2": "r2"}), (F.col("n") == F.col("rn")) & (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").isNotNull(), "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "ngram-components")
    scratch.close()
    return out


def _of_repeated_ids(docs: DataFrame, words: int, percent: int, limits: Limits, scratch: Scratch) -> DataFrame:
    """jaccard_components() where ids repeat: distinct rows are numbered and joined, then the components of one id's texts become one."""
    rows = scratch.written(docs.where("doc_id is not null").distinct().withColumn("row", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), words, percent, limits)
    found = scratch.written(rows.join(found.withColumnRenamed("doc_id", "row"), "row").select("doc_id", "text", "n_shingles", "component_id"), "found")
    linked = found.where("n_shingles > 0")
    least = linked.groupBy("component_id").agg(F.min("doc_id").alias("b"))
    ids = components(linked.join(least, "component_id").select(F.col("doc_id").alias("a"), "b"), scratch, "ids")
    own = found.select(F.col("doc_id").alias("i"), F.col("text").alias("x"), "n_shingles")
    out = docs.join(own, (F.col("doc_id") == F.col("i")) & F.col("text").eqNullSafe(F.col("x"))).join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = signatures(docs.where("doc_id is null"), words, percent, np.zeros(COUNTERS, np.uint32)).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = written(out.unionByName(nameless), "ngram-components")
    scratch.close()
    return out


def keep_one_per_component(docs: DataFrame, words: int = 5, percent: int = 80, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs whose id is their component's smallest; rows with a null id stay."""
    found = jaccard_components(docs, words, percent, limits)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
