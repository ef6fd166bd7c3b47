"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Equal vectors of a label are one class with a count. A class's normalised vector v gets, in each of ``tables`` tables,
the bucket of its ``projections`` codes floor((a.v + b) / width) with Gaussian a. Only classes that share a bucket go on, so a vector
travels no oftener than it has company. Buckets with two classes or more are
opened: the cosine of each pair in a bucket is taken in double precision, a pair that met in an earlier table is not
counted again. A bucket of more than ``block`` classes is dealt out as pairs of blocks, so it is split over tasks and
no task holds more than two blocks; a bucket of m classes is read m / block times. From a pair of blocks come one count per class and the edges of a spanning forest,
never the pairs themselves.

With the standard parameters two vectors at a cosine of 0.98 (a distance of 0.2) share a code with probability 0.92,
a bucket with 0.16 and are met in at least one of 27 tables with 0.99; above 0.99 they are met with over 0.9999. Vectors at right
angles share a code with 0.49 and a bucket with 1.3e-7, so company by chance stays rare up to tens of millions of vectors of a label.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without label or id, link with
nothing and are kept; vectors of unlike lengths never link; components of any finite size count (vectors are scaled by their largest one before their norm is taken); labels of any type that Spark can compare; repeated rows are copies that link with each other; rows with
one id and unlike vectors are vectors of their own; empty tables give no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm._components import components
from assetlens.scratch import Scratch, written


def _unit(vectors: list) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _projections(dims: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([seed, dims])
    return r.standard_normal((dims, tables * projections)), r.uniform(0, width, tables * projections)


def bucket_codes(units: np.ndarray, salt: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A row of 64-bit bucket numbers, one per table; salt (the label) and the table's number are part of each."""
    a, b = _projections(units.shape[1], tables, projections, width, seed)
    q = np.floor((units @ a + b) / width).astype(np.int64).reshape(len(units), tables, projections)
    out = np.repeat(salt.astype(np.int64)[:, None], tables, axis=1) * np.int64(1_000_003) + np.arange(tables) + np.int64(units.shape[1]) * np.int64(7919)
    with np.errstate(over="ignore"):
        for k in range(projections):
            out = (out ^ q[:, :, k]) * np.int64(-7046029254386353131)
            out ^= out >> np.int64(29)
    return out


def _spanning(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = 27, projections: int = 22, width: float = 2.0, block: int = 512, seed: int = 11, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    exact: every pair of a label is compared, in pairs of blocks, so no link is missed and the work grows with the square of a label's vectors.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    scratch = Scratch(vectors.sparkSession, "embeddings")
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = scratch.written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label, v = (batch.column(k).to_pylist() for k in range(3))
            for dims in sorted({len(x) for x in v}):
                at = [i for i, x in enumerate(v) if len(x) == dims]
                codes = bucket_codes(_unit([v[i] for i in at]), np.array([label[i] for i in at], np.int64), tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays([pa.array([cid[i] for i in at], pa.int64()), pa.array(list(codes), pa.list_(pa.int64()))], names=["cid", "codes"])

    if exact:
        codes = classes.select("cid", F.array(F.xxhash64("label", F.size("v"))).alias("codes"))
    else:
        codes = classes.select("cid", F.xxhash64("label").alias("l"), "v").mapInArrow(hashed, "cid bigint, codes array<bigint>")
    codes = scratch.written(codes, "codes")
    member = codes.select("cid", F.explode("codes").alias("bucket"))
    full = scratch.written(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "full")
    blocks = F.ceil(F.col("m") / block).cast("int")
    member = member.join(full, "bucket").withColumns({"own": F.pmod(F.xxhash64("cid", "bucket"), blocks.cast("long")).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    member = member.select("cid", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    member = scratch.written(member, "member")
    company = scratch.written(member.select("cid").distinct(), "company")
    known = classes.select("cid", "n", "v", F.xxhash64("label").alias("l")).join(company, "cid").join(codes, "cid")
    full_rows = member.join(known, "cid")
    dealt = full_rows.select("bucket", "lo", "hi", "own", "cid", "n", "v", "codes", "l").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "cid")

    def linked(bucket: int, lo: int, hi: int, own: np.ndarray, cid: np.ndarray, n: np.ndarray, v: np.ndarray, code: np.ndarray, label: np.ndarray) -> tuple:
        u = _unit(v)
        near = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
        np.fill_diagonal(near, False)
        if lo != hi:
            near &= own[:, None] != own[None, :]
        i, j = np.nonzero(near)
        if len(i):
            same = code[i] == code[j]
            near[i, j] = code[i, same.argmax(axis=1)] == bucket  # the first table in which the two meet
        some = near.any(axis=1)
        root = _spanning(near)
        return cid[some], (near @ n)[some], cid[root][some]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and len(key[0]) and tuple(key[:, 0]) != tuple(held[-1].column(k)[0].as_py() for k in range(3)):
                cuts = np.append(0, cuts)
            if not len(cuts):
                held.append(batch)
                continue
            yield from found(pa.Table.from_batches([*held, batch.slice(0, cuts[0])]), [])
            yield from found(pa.Table.from_batches([batch.slice(cuts[0], cuts[-1] - cuts[0])]), cuts[1:-1] - cuts[0])
            held = [batch.slice(cuts[-1])]
        if held:
            yield from found(pa.Table.from_batches(held), [])

    def found(t: pa.Table, cuts) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        bucket, lo, hi, own, cid, n = (t.column(k).to_numpy() for k in range(6))
        v = [np.asarray(x) for x in t.column("v").to_pylist()]
        code, label = np.array(t.column("codes").to_pylist(), np.int64), t.column("l").to_numpy()
        key = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        out: list[tuple] = []
        for a, b in zip([0, *key], [*key, len(bucket)]):
            if b - a > 1 and len({len(x) for x in v[a:b]}) == 1:
                out.append(linked(bucket[a], lo[a], hi[a], own[a:b], cid[a:b], n[a:b], np.stack(v[a:b]), code[a:b], label[a:b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(3)], names=["cid", "links", "root"])

    links = scratch.written(dealt.mapInArrow(compared, "cid bigint, links bigint, root bigint"), "links")
    scratch.drop("codes", "full", "member", "company")
    comp = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    per_class = scratch.written(per_class.withColumn("component", F.coalesce("component", "cid")), "per-class")
    least = per_class.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = per_class.join(least, "component").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    per_class = written(per_class, "linked-vectors")
    scratch.close()
    out = rows.where("sound").join(per_class, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
    out = out.select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
