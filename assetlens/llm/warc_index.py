"""WARC archives of pages and their index: locally sorted capture runs, merged by a loser tree into one global order.

write_archives() writes one record per page, each its own gzip member, into files of bounded size in a shared folder.
Every file holds its captures sorted by the key of the URL that its records name, then capture time and page id, so it is a run.
read_archives() parses the files back into index rows with the digest and size of each payload. merge_runs() deals the
index rows out by ranges of (URL key, time, page id), of a bounded number of rows each; the page id splits a URL that
holds many captures. In a range the rows of each file stand in the file's order (their offsets are sorted, never their keys), and the
loser tree merges the files' slices k-way as a stream. A file that turns out not to be a run is an error.

Of pages with equal payloads of at least ``min_revisit`` bytes the one with the smallest id is a response and the others
revisit it, without the payload. That list of payloads with copies is written first; Spark then joins it by broadcast only if its size on
disk allows that, else by a skew-aware shuffle join on the digest (short payloads get keys of their own).

Edge cases: null html is an empty payload; a null url has no target header and an empty key; blanks and control characters of a
url are percent-encoded in its record and its key; a null page id is kept and
never a response that others refer to, unless its payload has no other copy; equal ids with equal payloads are all responses where their id is the
smallest; captures with equal keys, times and ids keep the order of their files; an empty table gives no rows; very long payloads are one record, whatever the file size asked for; other columns are dropped.
Files get their final name by a rename when complete, the same in every attempt of a task, so a lost executor leaves no partial archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm._shared import ascii_lower
from assetlens.scratch import Scratch

#: Seconds since 1970 of the first capture; page k counts as captured k seconds later.
FIRST_CAPTURE = 1_704_067_200
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "<urn:page:"
RUN_SCHEMA = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def url_key(url):
    """Host parts in reverse order, then path and query, all in lower case: com,example,www)/a?b."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^/?#]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.regexp_replace(F.substr(rest, F.length(host) + 1), "#.*$", "")
    return ascii_lower(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def target_uri(url):
    """The url as records name it: blanks and control characters percent-encoded."""
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c <= " ", F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.when(F.rlike(url, F.lit(r"[\x00-\x20]")), encoded).otherwise(url)


def _record(page_id, url, date: str, payload: bytes, digest: str, refers_to) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url)
    if revisit:
        lines += [f"WARC-Refers-To: {ID_PREFIX}{refers_to}>", "WARC-Profile: " + REVISIT_PROFILE]
    body = head if revisit else head + payload
    lines += ["WARC-Payload-Digest: sha256:" + digest, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100, file_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Writes the archives below folder; returns file, records, bytes of each. pages: page_id, url, html."""
    scratch = Scratch(pages.sparkSession, "archived")
    p = pages.select("page_id", target_uri(F.col("url")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    copies = p.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = scratch.written(copies.where("n > 1").select(F.col("digest").alias("copied"), "first_id"), "copies")
    key = F.when(F.col("size") >= min_revisit, F.col("digest")).otherwise(F.concat(F.lit("short-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    p = p.join(copies, key == F.col("copied"), "left")
    date = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2_000_000_000)))
    p = p.select(
        url_key(F.col("url")).alias("url_key"), F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "page_id", "url", "payload", "digest",
        F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") + 1), F.col("first_id")).alias("refers_to"),
    ).sortWithinPartitions("url_key", "date", "page_id", "url", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task, made, out, size, rows, files = TaskContext.get(), [], None, 0, 0, 0
        fs, root = FileSystem.from_uri(folder)

        def close():
            out.close()
            name = f"run-{task.partitionId():06d}-{files:04d}.warc.gz"
            fs.move(f"{root}/.open-{task.taskAttemptId()}", f"{root}/{name}")
            made.append((name, rows, size))

        for batch in batches:
            for _, date, page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, size, rows = fs.open_output_stream(f"{root}/.open-{task.taskAttemptId()}"), 0, 0
                data = _gzip(_record(page_id, url, date, payload, digest, refers_to), level)
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= file_bytes:
                    close()
                    out, files = None, files + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    made = scratch.written(p.mapInArrow(run, "file string, records bigint, bytes bigint"), "archives")
    scratch.drop("copies")
    return made


#: Bytes that are given to the decompressor at a time; what is left over after a record is at most as long.
SLICE = 1 << 14


def _parsed(content: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset, length, header and block of each record of an archive, in time proportional to its size."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, here = zlib.decompressobj(31), [], at
        while not z.eof:
            if here == len(view):
                raise EOFError("the archive ends inside a record")
            parts.append(z.decompress(view[here : here + SLICE]))
            here = min(here + SLICE, len(view))
        here -= len(z.unused_data)
        data = b"".join(parts)
        stop = data.index(b"\r\n\r\n")
        header = dict(line.split(": ", 1) for line in data[:stop].decode().split("\r\n")[1:])
        yield at, here - at, header, data[stop + 4 : stop + 4 + int(header["Content-Length"])]
        at = here


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows (RUN_SCHEMA) of all archives below folder; digests and sizes of responses are those of the payload read."""

    def number(value: str | None):
        digits = (value or "").removeprefix(ID_PREFIX).rstrip(">")
        return int(digits) if digits else None

    def row(name: str, at: int, length: int, header: dict, block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        if header["WARC-Type"] == "revisit":
            size = int(head.rsplit(b"Content-Length: ", 1)[1])
            digest = header["WARC-Payload-Digest"].removeprefix("sha256:")
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if header["WARC-Payload-Digest"] != "sha256:" + digest:
                raise ValueError(f"{name} at {at}: the payload doesn't have the digest that its record names")
        return header.get("WARC-Target-URI"), header["WARC-Date"], number(header["WARC-Record-ID"]), size, digest, header["WARC-Type"], number(header.get("WARC-Refers-To")), name, at, length

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["url", *[c.split()[0] for c in RUN_SCHEMA.split(", ")][1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py().rsplit("/", 1)[-1], batch.column(1)[k].as_py()
                rows: list = []
                for x in _parsed(content):
                    rows.append(row(name, *x))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "url string" + RUN_SCHEMA.removeprefix("url_key string"))
    return rows.select(url_key(F.col("url")).alias("url_key"), *names[1:])


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the losers of the last matches, so each step replays one path.

    Runs are iterables of keys; of each only the next key is held. A run that isn't sorted is an error.
    """

    def __init__(self, runs: list):
        self.runs, self.k, self.at = [iter(r) for r in runs], len(runs), [0] * len(runs)
        self.head = [self._next(r) for r in range(self.k)]
        self.tree = [0] * max(1, self.k)
        if self.k:
            self.tree[0] = self._play(1)

    def _next(self, run: int) -> tuple:
        for key in self.runs[run]:
            return 0, key
        return 1, ()  # once a run is used up it loses to all others

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self.head[a] <= self.head[b] else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of each entry in merged order; equal entries by run."""
        head, tree, k = self.head, self.tree, self.k
        while k and not head[w := tree[0]][0]:
            yield w, self.at[w]
            self.at[w] += 1
            new = self._next(w)
            if new < head[w]:
                raise ValueError("a run isn't sorted")
            head[w] = new
            node = (w + k) // 2
            while node:
                other = tree[node]
                if head[other] < head[w] or (head[other] == head[w] and other < w):
                    tree[node], w = w, other
                node //= 2
            tree[0] = w


#: Keys of a run that are made at once, and merged rows that are returned at once.
AHEAD, ROWS_OUT = 512, 8192


def merge_runs(index: DataFrame, rows: int | None = None, rows_per_range: int = 100_000) -> DataFrame:
    """index (RUN_SCHEMA, of `rows` rows if known; each file is a run) in the global order of url_key, captured_at, page_id; partitions follow each other."""
    spark = index.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(index.count() if rows is None else rows) // rows_per_range))
    order = ["url_key", "captured_at", "page_id"]
    dealt = index.repartitionByRange(ranges, *order, "file", "offset").sortWithinPartitions("file", "offset")

    def keys(t: pa.Table, start: int, stop: int) -> Iterator[tuple]:
        for a in range(start, stop, AHEAD):
            part = t.slice(a, min(AHEAD, stop - a))
            yield from zip(*(part.column(c).to_pylist() for c in order[:2]), [(x is not None, x or 0) for x in part.column("page_id").to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one range, as Arrow columns: about rows_per_range rows
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        files = t.column("file").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.append(0, np.flatnonzero(files[1:] != files[:-1]) + 1).tolist()
        merged = LoserTree([keys(t, a, b) for a, b in zip(starts, [*starts[1:], t.num_rows])])
        out: list[int] = []
        for r, i in merged:
            out.append(starts[r] + i)
            if len(out) == ROWS_OUT:
                yield from t.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
                out = []
        if out:
            yield from t.take(pa.array(out, pa.int64())).combine_chunks().to_batches()

    return dealt.mapInArrow(run, index.schema)


def capture_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the archives, reads them back and merges their runs: the captures of all pages in global order.

    Without a folder the archives are scratch, and gone once their index is written.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    where = folder or scratch.path("archives")
    made = write_archives(pages, where, **options)
    rows = made.agg(F.sum("records")).first()[0] or 0
    runs = scratch.written(read_archives(spark, where), "runs")
    if folder is None:
        scratch.drop("archives")
    return merge_runs(runs, rows)
