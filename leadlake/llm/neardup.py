"""Operator 1: near duplicates by MinHash and a multi-index Hamming join.

A document's signature has K symbols of 16 bits: of K hash functions over its word shingles, the least value of each,
folded. The distance of two signatures is the number of symbols that differ. The K symbols form CHUNKS chunks; if at most
2 * CHUNKS - 1 symbols differ, some chunk holds at most one of the errors (pigeonhole), so a document is filed, for every
chunk and every place in it where the error may be, under the chunk's other symbols. Two documents within the threshold
share at least one such key, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._graph import connected_components, durable
from leadlake.llm._text import U, binary_rows, free_names, lower, mix, released, slices, span_hashes, word_bounds

CHUNKS, WIDTH = 13, 5
K = CHUNKS * WIDTH
#: The largest distance that the enumeration of one error a chunk guarantees; 25 of 65 symbols is a Jaccard of about 0.62.
MAX_DISTANCE = 2 * CHUNKS - 1
SHINGLE = 2
#: Representatives of one key that a task holds at once.
BUCKET = 4096
_A = mix(np.arange(1, K + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_B = mix(np.arange(K + 1, 2 * K + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of ``shingle`` words; a text of fewer words has one shingle, all its words."""
    starts, ends, row = word_bounds(data, offsets)
    one = span_hashes(data, starts, ends)
    n = len(one)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    left = count[row] - (np.arange(n) - first[row]) if n else np.zeros(0, np.int64)
    out = one.copy()
    for k in range(1, shingle):
        out[: n - k] = np.where(left[: n - k] > k, out[: n - k] * U(0x100000001B3) + one[k:], out[: n - k])
    keep = (left >= shingle) | ((count[row] < shingle) & (left == count[row]))
    return mix(out[keep]), row[keep]


def signature_matrix(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a shingle, and their K symbols."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros((0, K), np.uint16)
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.empty((len(at), K), np.uint16)
    for j in range(K):
        least = np.minimum.reduceat(hashes * _A[j] + _B[j], at)
        out[:, j] = (least * U(0xD6E8FEB86659FD93)) >> U(48)
    return rows[at], out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), lower(batch.column(1))
        for low, _, data, offsets in slices(text):
            rows, matrix = signature_matrix(*shingle_hashes(data, offsets))
            if len(rows):
                at = pa.array(rows + low)
                yield pa.RecordBatch.from_arrays([ids.take(at), *(batch.column(k).take(at) for k in range(2, batch.num_columns)), binary_rows(matrix)], ["doc_id", *batch.schema.names[2:], "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    """The symbols of a column of signatures."""
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint16, len(column) * K, int(begin)).reshape(-1, K)


def chunk_keys(matrix: np.ndarray) -> np.ndarray:
    """The K keys of each signature: of each chunk, with each one symbol left out."""
    out = np.empty((len(matrix), K), U)
    wide = matrix.astype(U)
    for chunk in range(CHUNKS):
        for gap in range(WIDTH):
            packed = np.zeros(len(matrix), U)
            for place in range(WIDTH):
                if place != gap:
                    packed = (packed << U(16)) | wide[:, chunk * WIDTH + place]
            out[:, chunk * WIDTH + gap] = mix(packed + _B[chunk * WIDTH + gap])
    return out


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4000):
            part = batch.slice(low, 4000)
            keys = chunk_keys(_matrix(part.column(1)))
            reps = np.repeat(part.column(0).to_numpy(), K)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(reps)], ["key", "rep"])


def bucket_edges(ids: np.ndarray, matrix: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that span the components of "within ``distance``" among the members of one bucket.

    A search that compares each member reached with all that are not yet reached: exact, and linear where one member is
    near all the others.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(ids))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.zeros(len(rest), bool)
            for low in range(0, len(rest), 50_000):
                near[low : low + 50_000] = (matrix[rest[low : low + 50_000]] != matrix[at]).sum(1) <= distance
            hits = rest[near]
            rest = rest[~near]
            out += [(ids[at], ids[x]) for x in hits]
            queue += list(hits)
    return out


def _search(distance: int):
    """Over rows sorted by key: the edges found in each bucket, each edge once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            keys, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            sig = table.column(2).combine_chunks()
            matrix = _matrix(sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig)
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[at, len(keys)])
            two = at[size == 2]
            two = two[(matrix[two] != matrix[two + 1]).sum(1) <= distance]
            pairs = set(zip(ids[two].tolist(), ids[two + 1].tolist()))
            for k in np.flatnonzero(size > 2):
                own = slice(at[k], at[k] + size[k])
                pairs.update(bucket_edges(ids[own], matrix[own], distance))
            found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif held and held[-1].column(0)[-1].as_py() != keys[0]:
                yield emit(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield emit(pa.Table.from_batches(held))

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sig) of documents that have a word and an id; row is a hash of the text, which tells rows of one id apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    return own.withColumn("row", F.xxhash64("text")).mapInArrow(released(_sign), "doc_id long, row long, sig binary")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, rep, sig, pivot, pivot_sig): (key, rep, pivot, far) with the distance of the two signatures."""
    for batch in batches:
        if batch.num_rows:
            far = (_matrix(batch.column(2)) != _matrix(batch.column(4))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(far.astype(np.int32))], ["key", "rep", "pivot", "far"])


def _cross(distance: int):
    """Over (key, side, cell, rep, sig) in the tasks of their (key, cell), sides 0 first: edges from rows of side 0 to those of 1.

    Side 0 has BUCKET rows about; those of side 1 stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, matrix = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            own, sig = [batch.column(k).to_numpy() for k in range(4)], _matrix(batch.column(4))
            cut = np.r_[True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])]
            edges = np.flatnonzero(cut)
            u, v = [], []
            for a, b in zip(edges, np.r_[edges[1:], len(cut)]):
                if (own[0][a], own[1][a]) != at:
                    at, ids, matrix = (own[0][a], own[1][a]), [], []
                if own[2][a] == 0:
                    ids.append(own[3][a:b].copy())
                    matrix.append(sig[a:b].copy())
                elif ids:
                    ids, matrix = [np.concatenate(ids)], [np.concatenate(matrix)]
                    for k in range(a, b):
                        near = ids[0][(matrix[0] != sig[k]).sum(1) <= distance]
                        u.append(near)
                        v.append(np.full(len(near), own[3][k]))
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                keep = u != v
                pairs = np.unique(np.stack([np.minimum(u, v)[keep], np.maximum(u, v)[keep]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    return run


def hot_edges(hot: DataFrame, copies: DataFrame, distance: int) -> DataFrame:
    """Edges that span the components within the buckets of ``hot`` (key, rep, n), which no one task could hold.

    Every member is compared with the bucket's pivot, its smallest one. A bucket whose members all reach the pivot is done,
    in one pass whatever its size. In the others, members that don't reach it meet, in cells, all that might be within the
    distance of them: by the triangle inequality, not those so near to the pivot that none of the former is in reach. A cell
    has BUCKET members on one side while the other side streams past, so no task holds more, and only edges leave it.
    """
    sig = copies.select("rep", "sig")
    pivots = hot.groupBy("key").agg(F.min("rep").alias("pivot"))
    named = hot.join(pivots, "key").join(sig, "rep").join(sig.select(F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    told = durable(named.select("key", "rep", "sig", "pivot", "pivot_sig").mapInArrow(released(_apart), "key long, rep long, pivot long, far int"))
    star = told.where((F.col("far") <= distance) & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("rep").alias("v"))
    rest = told.where(F.col("far") > distance)
    cells = rest.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).alias("cells"), F.min("far").alias("least"))
    one = rest.join(cells, "key").select("key", F.pmod(F.xxhash64("rep"), "cells").alias("cell"), F.lit(0).alias("side"), "rep")
    two = told.join(cells, "key").where((F.col("far") > distance) | (F.col("far") >= F.col("least") - distance)).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("side"), "rep")
    met = one.unionByName(two).join(sig, "rep").select("key", "cell", "side", "rep", "sig").repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "rep")
    return star.unionByName(met.mapInArrow(released(_cross(distance)), "u long, v long"))


def _groups(docs: DataFrame, distance: int) -> DataFrame:
    """(doc_id, row, group_id, group_size, kept) of the rows in a group."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {MAX_DISTANCE}: one error a chunk guarantees no more")
    signed = durable(signatures(docs).withColumn("rid", F.monotonically_increasing_id()))  # written down, so it stays
    copies = durable(signed.groupBy("sig").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")))
    filed = copies.select("rep", "sig").mapInArrow(released(_file), "key long, rep long")
    # counted on the map side first; only the keys of more than one representative meet their rows again
    often = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(filed.join(often, "key").select("key", "rep", "n"))
    few = shared.where(F.col("n") <= BUCKET).join(copies, "rep").select("key", "rep", "sig").repartition("key").sortWithinPartitions("key", "rep")
    found = few.mapInArrow(released(_search(distance)), "u long, v long")
    hot = shared.where(F.col("n") > BUCKET)
    if not hot.isEmpty():
        found = found.unionByName(hot_edges(hot, copies, distance))
    groups = connected_components(found)
    near = copies.join(groups, F.col("rep") == F.col("node"), "left").where("copies > 1 or node is not null").select("sig", F.coalesce("component", "rep").alias("group"))
    named = durable(signed.join(near, "sig").select("doc_id", "row", "group").distinct())
    size = named.groupBy("group").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_id", "row")).alias("first")).where("group_size > 1")
    return named.join(size, "group").select("doc_id", "row", F.col("first.doc_id").alias("group_id"), "group_size", (F.struct("doc_id", "row") == F.col("first")).alias("kept"))


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id, group_size, kept): the documents that have a near duplicate.

    A group is a connected component of "signatures differ in at most ``distance`` symbols"; its id is its smallest
    doc_id, which is also the one kept. All pairs within the distance are found: there is no cap on a bucket or a group.
    Equal signatures are first collapsed into one representative, so thousands of copies cost one entry. Buckets of more
    than BUCKET representatives take a way of their own that no one task has to hold, see ``hot_edges``.

    Nulls and empties: a document whose text is null or has no word, or whose id is null, is in no group. Repeated rows
    (one doc_id and one text) count once; rows of one doc_id with other texts are other documents. Ties (equal signatures)
    are one group. An empty table gives no row. Other columns are not read.
    """
    return _groups(docs, distance).drop("row")


def drop_near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without the documents of a group but the one it keeps; all columns and all other rows stay.

    Rows in no group stay: null ids, null, empty and wordless texts. Repeated rows of the document kept all stay, those of
    others all go; rows of one doc_id with other texts are judged by themselves. An empty table stays empty; columns of any
    name are carried along.
    """
    gone, row = free_names(docs.columns, "gone", "row")
    out = _groups(docs, distance).where("not kept").select(F.col("doc_id").alias(gone), F.col("row").alias(row))
    return docs.join(out, (F.col("doc_id").cast("long") == F.col(gone)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row)), "left_anti")
