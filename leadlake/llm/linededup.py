"""Operator 3: line dedup with sharded cuckoo filters over exact reference counts; inserts and deletions are reversible.

Lines are hashed to 128 bits and spread over shards. Every shard has a cuckoo filter of 16-bit fingerprints. A line that
the filter has not seen is surely new and costs nothing more; only lines that it may have seen go on to the exact table of
references, which counts them and names the first. The exact table alone decides, so a filter's false alarm removes nothing.

A line that occurs a billion times is counted where it is read: each task sends one row for it and each COMBINE lines, so that
neither its shard nor its row in the exact table sees more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm._graph import durable
from leadlake.llm._text import U, free_names, mix

#: Lines that a shard's filter is meant for; the number of shards follows from the number of lines.
SHARD_LINES = 1_000_000
SLOTS = 4
KICKS = 500
#: References that a task counts together before it sends them on.
COMBINE = 500_000


class CuckooFilter:
    """A set of 64-bit hashes with deletion; it answers for whole arrays. What finds no place is held aside, so it never refuses."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.spill: dict[tuple[int, int], int] = {}  # (bucket, fingerprint) that found no place within KICKS rounds

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(hashes)
        mark = ((h >> U(48)) % U(65535) + U(1)).astype(np.uint16)
        one = (h & U(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U)) & U(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        out = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.spill:
            out |= np.fromiter(((int(a), int(m)) in self.spill or (int(b), int(m)) in self.spill for a, b, m in zip(one, two, mark)), bool, len(mark))
        return out

    def insert(self, hashes: np.ndarray) -> None:
        """Adds distinct hashes that it doesn't hold yet; equal fingerprints in the same buckets are held as often."""
        mark, at, two = self._places(hashes)
        at = self._settle(mark, at)
        left = at >= 0
        mark, at = mark[left], two[left]
        random = np.random.default_rng(len(hashes))
        for _ in range(KICKS):
            if not len(mark):
                return
            at = self._settle(mark, at)
            mark, at = mark[at >= 0], at[at >= 0]
            _, first = np.unique(at, return_index=True)
            slot = random.integers(0, SLOTS, len(first))
            bucket, evicted = at[first], self.table[at[first], slot].copy()
            self.table[bucket, slot] = mark[first]
            mark[first], at[first] = evicted, self._other(bucket, evicted)
        for key in zip(at.tolist(), mark.tolist()):
            self.spill[key] = self.spill.get(key, 0) + 1

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots; -1 for these, the bucket for the rest."""
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(at) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        free = self.table[ordered] == 0
        fits = nth < free.sum(1)
        slot = (np.cumsum(free, 1) == (nth + 1)[:, None]).argmax(1)
        self.table[ordered[fits], slot[fits]] = mark[order][fits]
        out = at.copy()
        out[order[fits]] = -1
        return out

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were inserted, one fingerprint each."""
        mark, one, two = self._places(hashes)
        left = np.arange(len(mark))
        for places in (one, two):
            # equal fingerprints that leave the same bucket go one after the other
            while len(left):
                at, own = places[left], mark[left]
                hit = self.table[at] == own[:, None]
                found = hit.any(1)
                _, first = np.unique(np.stack([at, own]), axis=1, return_index=True)
                now = np.zeros(len(left), bool)
                now[first] = True
                now &= found
                if not now.any():
                    break
                self.table[at[now], hit[now].argmax(1)] = 0
                left = left[~now]
        for k in left.tolist():
            for at in (int(one[k]), int(two[k])):
                if n := self.spill.get((at, int(mark[k]))):
                    self.spill[at, int(mark[k])] = n - 1
                    if n == 1:
                        del self.spill[at, int(mark[k])]
                    break

    def to_bytes(self) -> bytes:
        extra = np.array([(a, m) for (a, m), n in self.spill.items() for _ in range(n)], np.int64)
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + extra.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        out = cls(0, np.frombuffer(raw, np.uint16, n * SLOTS, 8).reshape(n, SLOTS).copy())
        for a, m in np.frombuffer(raw, np.int64, -1, 8 + 2 * n * SLOTS).reshape(-1, 2).tolist():
            out.spill[a, m] = out.spill.get((a, m), 0) + 1
        return out


def line_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, h1, h2): a reference for each line that isn't blank; row is a hash of the text, which tells rows of
    one doc_id apart. Lines are compared without outer white space."""
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("row", F.xxhash64("text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", trimmed)
    return lines.where("line <> ''").select("doc_id", "row", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


_FIRST = ("doc_id", "line_no", "row")
_COUNTED = "h1 long, h2 long, refs long, doc_id long, line_no int, row long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (h1, h2, doc_id, line_no, row): one row for each line of a run of references, with their number and the first."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("h1", "h2", *_FIRST)]).combine_chunks()
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        at = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = table.take(pa.array(at))
        return pa.RecordBatch.from_arrays([first.column("h1").combine_chunks(), first.column("h2").combine_chunks(), pa.array(np.diff(np.r_[at, len(h1)])), *(first.column(c).combine_chunks() for c in _FIRST)], ["h1", "h2", "refs", *_FIRST])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= COMBINE:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def counted_lines(refs: DataFrame) -> DataFrame:
    """(h1, h2, refs, doc_id, line_no, row): the lines of each task, counted; the last three name the first reference."""
    return refs.select("h1", "h2", *_FIRST).mapInArrow(_combine, _COUNTED)


def shards_for(lines: int) -> int:
    return max(1, -(-lines // SHARD_LINES))


def _suspects(size: int):
    """Over (shard, h1, refs, filter) sorted by shard with the filter's row first: hashes seen before, and each shard's new filter.

    Rows out: (shard, h1, null) for a suspect, (shard, null, filter) once a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sieve = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None], pa.int64()), pa.array([sieve.to_bytes()], pa.binary())], ["shard", "h1", "filter"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            for low, high in zip(*(lambda b: (b, [*b[1:], len(shards)]))(np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist())):
                if shards[low] != shard:
                    if shard is not None:
                        yield closed()
                    shard, sieve = int(shards[low]), CuckooFilter(size)
                part = batch.slice(low, high - low)
                for raw in part.column(3).drop_null():
                    sieve = CuckooFilter.from_bytes(raw.as_py())
                lines = part.filter(part.column(1).is_valid())
                one, at, count = np.unique(lines.column(1).to_numpy().view(U), return_inverse=True, return_counts=True)
                many = np.bincount(at, lines.column(2).to_numpy() > 1, len(one)) > 0
                known = sieve.contains(one)
                sieve.insert(one[~known])
                hit = one[known | many | (count > 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), shard, np.int32)), pa.array(hit.view(np.int64)), pa.nulls(len(hit), pa.binary())], ["shard", "h1", "filter"])
        if shard is not None:
            yield closed()

    return run


def _sharded(rows: DataFrame, shards: int, filters: DataFrame | None) -> DataFrame:
    """(shard, h1, refs, filter): hashes and filters in the tasks of their shards, a shard's filter first."""
    out = rows.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "refs", F.lit(None).cast("binary").alias("filter"))
    if filters is not None:
        out = out.unionByName(filters.select("shard", F.lit(None).cast("long").alias("h1"), F.lit(0).cast("long").alias("refs"), "filter"))
    return out.repartition("shard").withColumn("late", F.col("filter").isNull()).sortWithinPartitions("shard", "late").drop("late")


def sift(counted: DataFrame, shards: int, filters: DataFrame | None = None, size: int = SHARD_LINES) -> DataFrame:
    """(shard, h1, filter): the hashes that may have been seen before, and the filters with these lines added."""
    return _sharded(counted, shards, filters).mapInArrow(_suspects(size), "shard int, h1 long, filter binary")


def repeated(counted: DataFrame, suspects: DataFrame) -> DataFrame:
    """(h1, h2, refs, first): the exact count and first reference of each line that is there more than once."""
    own = counted.join(suspects.where("h1 is not null").select("h1").distinct(), "h1", "left_semi")
    return own.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.min(F.struct(*_FIRST)).alias("first")).where("refs > 1")


def _references(docs: DataFrame) -> DataFrame:
    """Every reference to a line but its first, with the first and the number of references."""
    refs = durable(line_refs(docs))
    counted = durable(counted_lines(refs))
    many = repeated(counted, sift(counted, shards_for(counted.count())))
    return refs.join(many, ["h1", "h2"]).where("struct(doc_id, line_no, row) <> first")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, first_doc, first_line, refs): every reference to a line but its first, by doc_id, line number, text.

    Nulls and empties: blank lines, null texts and null ids have no reference. A table with repeated rows counts each row,
    and its equal references (one doc_id, text and line number) are the same reference, so the first of them stays in each
    row; rows of one doc_id with other texts are other documents. An empty table gives no row. Columns other than doc_id and
    text aren't read.
    """
    return _references(docs).select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "refs")


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with the lines (doc_id, row, line_no) cut out, where row is ``xxhash64(text)``; a document that loses all its
    words goes, others keep all columns.

    A row that no entry names stays as it is, whatever it holds: null ids and texts, empty texts, rows of the same doc_id
    with another text. Repeated rows lose the same lines, entries may be repeated, an empty ``gone`` changes nothing. n_chars,
    if there is one, is set anew for texts that changed; columns of any name are carried along.
    """
    ident, row, lost = free_names(docs.columns, "ident", "row", "lost")
    lines = gone.groupBy(F.col("doc_id").alias(ident), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost))
    joined = docs.join(lines, (F.col("doc_id").cast("long") == F.col(ident)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row)), "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))  # by hashing: linear in the lines
    cut = F.col(lost).isNotNull()
    kept = F.array_join(_picked(parts, left), "\n")
    out = joined.withColumn("text", F.when(cut, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.where(~cut | F.col("text").rlike(r"\S")).select(docs.columns)


def _picked(parts: Column, places: Column) -> Column:
    """The parts at these places, in their order; the split is worked out once."""
    return F.flatten(F.transform(F.array(F.struct(parts.alias("p"), places.alias("k"))), lambda s: F.transform(s["k"], lambda k: F.get(s["p"], k))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines: each line stays where it stands first (smallest doc_id, then line, then text).

    Nulls, empties, repeated rows and empty tables as in ``repeated_lines`` and ``without_lines``: what has no reference, or
    no repeated line, stays as it is.
    """
    return without_lines(docs, _references(docs).select("doc_id", "row", "line_no"))


class LineStore:
    """An incremental line index in a shared folder that can be opened again at any time.

    Each change is a version. ``refs/v`` has only the references that the version added and ``gone/v`` the documents that it
    took out, so a change writes what changed; ``filters/v`` has the filters after it; ``log/v`` is written last and makes the
    version count: what a broken change left behind is written over by the next. Lines belong to the documents that came
    first: by version, then doc_id, line number and text. So a document that comes later never takes a line away, whatever
    its id. ``delete`` takes documents out, the next reference becomes the first, and the state is as if they had never been
    there. A doc_id that is there already is added once; rows with a null doc_id or text have no reference; empty tables and
    unknown ids change nothing. Filters double in size, and are built anew from the exact table, when they would overfill.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, shard_lines: int = SHARD_LINES):
        self.spark, self.path, self.shards, self.size, self.log = spark, path.rstrip("/"), shards, shard_lines, []
        if self._there("log"):
            self.log = sorted(tuple(r) for r in spark.read.parquet(f"{self.path}/log/*").select("version", "kind", "shards", "size").collect())
            self.shards, self.size = self.log[-1][2:]

    def _there(self, what: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @property
    def version(self) -> int:
        return self.log[-1][0] if self.log else 0

    def _at(self, what: str, version: int) -> str:
        return f"{self.path}/{what}/v{version:06d}"

    def refs(self) -> DataFrame:
        """(version, doc_id, row, line_no, h1, h2) of the documents that are there."""
        out, added = None, "version int, doc_id long, row long, line_no int, h1 long, h2 long"
        gone = {v: self.spark.read.parquet(self._at("gone", v)).select("doc_id", F.lit(v).alias("_v")) for v, kind, *_ in self.log if kind == "delete"}
        for v, kind, *_ in self.log:
            if kind == "insert":
                own = self.spark.read.parquet(self._at("refs", v)).select(F.lit(v).alias("version"), "doc_id", "row", "line_no", "h1", "h2")
                out = own if out is None else out.unionByName(own)
        if out is None:
            return self.spark.createDataFrame([], added)
        if gone:
            last = None
            for df in gone.values():
                last = df if last is None else last.unionByName(df)
            last = last.groupBy("doc_id").agg(F.max("_v").alias("_v"))
            out = out.join(last, "doc_id", "left").where("_v is null or _v < version").drop("_v")
        return out.select("version", "doc_id", "row", "line_no", "h1", "h2")

    def filters(self) -> DataFrame | None:
        return self.spark.read.parquet(self._at("filters", self.version)) if self.log else None

    def _commit(self, kind: str, what: str, rows: DataFrame, filters: DataFrame, size: int) -> None:
        v = self.version + 1
        rows.write.mode("overwrite").parquet(self._at(what, v))
        filters.select("shard", "filter").write.mode("overwrite").parquet(self._at("filters", v))
        self.spark.createDataFrame([(v, kind, self.shards, size)], "version int, kind string, shards int, size long").coalesce(1).write.mode("overwrite").parquet(self._at("log", v))
        self.log.append((v, kind, self.shards, size))
        self.size = size

    def _many(self, refs: DataFrame, suspects: DataFrame) -> DataFrame:
        """(h1, h2, first): of the suspected lines that are there more than once, the first reference."""
        own = refs.join(suspects.where("h1 is not null").select("h1").distinct(), "h1", "left_semi")
        return own.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(F.struct("version", *_FIRST)).alias("first")).where("refs > 1")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds documents and returns (doc_id, row, line_no) of the lines among them that are not the first of their kind."""
        old = self.refs()
        new = durable(line_refs(docs).join(old.select("doc_id").distinct(), "doc_id", "left_anti"))
        v, size = self.version + 1, self.size
        every = old.unionByName(new.select(F.lit(v).alias("version"), "doc_id", "row", "line_no", "h1", "h2"))
        lines = every.agg(F.approx_count_distinct("h1")).first()[0]
        while lines > self.shards * size:
            size *= 2
        counted = counted_lines(every if size > self.size else new)
        sifted = durable(sift(counted, self.shards, None if size > self.size else self.filters(), size))
        marked = new.withColumn("version", F.lit(v)).join(self._many(every, sifted), ["h1", "h2"])
        gone = durable(marked.where("struct(version, doc_id, line_no, row) <> first").select("doc_id", "row", "line_no"))
        self._commit("insert", "refs", new, sifted.where("filter is not null"), size)
        return gone

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents of ``ids`` (doc_id)."""
        if not self.log:
            return
        old = self.refs()
        out = durable(old.select("doc_id").distinct().join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi"))
        lost = old.join(out, "doc_id", "left_semi").select("h1").distinct()
        went = lost.join(old.join(out, "doc_id", "left_anti").select("h1"), "h1", "left_anti").withColumn("refs", F.lit(1).cast("long"))

        def forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, sieve = None, None
            closed = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sieve.to_bytes()], pa.binary())], ["shard", "filter"])
            for batch in batches:
                shards = batch.column(0).to_numpy()
                for now in np.unique(shards).tolist():
                    part = batch.filter(pa.array(shards == now))
                    if now != shard:
                        if sieve is not None:
                            yield closed()
                        shard, sieve = now, None
                    for raw in part.column(3).drop_null():
                        sieve = CuckooFilter.from_bytes(raw.as_py())
                    hashes = part.column(1).drop_null().to_numpy().view(U)
                    if sieve is not None and len(hashes):
                        sieve.delete(hashes)
            if sieve is not None:
                yield closed()

        kept = _sharded(went, self.shards, self.filters()).mapInArrow(forget, "shard int, filter binary")
        self._commit("delete", "gone", out, kept, self.size)

    def repeated_lines(self) -> DataFrame:
        """(doc_id, row, line_no) of all lines in the index that are not the first of their kind."""
        refs = self.refs()
        many = self._many(refs, refs.groupBy("h1").count().where("count > 1"))
        return refs.join(many, ["h1", "h2"]).where("struct(version, doc_id, line_no, row) <> first").select("doc_id", "row", "line_no")
