"""Operator 6: exact dedup by composable polynomial fingerprints and chunkwise comparison.

The fingerprint of bytes b[0..n) modulo a prime p is the sum of (b[i] + 1) * B ** (n - 1 - i). That of two pieces in a row
is f(x) * B ** len(y) + f(y), so chunks of a huge text are hashed on their own, in any place, and put together afterwards.
Two primes give 62 bits. Equal fingerprints only nominate: the texts are then compared chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._graph import durable
from leadlake.llm._text import U, buffers, slices

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Copies of one fingerprint that one task compares; larger groups are compared in parts, whose leaders are then compared.
PART = 1000


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, U)
    for k in range(16):  # doubling
        out[1 << k : 2 << k] = out[: 1 << k] * U(pow(base, 1 << k, prime)) % U(prime)
    return out


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES)]


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The fingerprint of two pieces in a row."""
    return tuple((a * pow(base, right_bytes, prime) + b) % prime for a, b, base, prime in zip(left, right, BASES, PRIMES))


def chunk_fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length and fingerprints of each chunk of CHUNK bytes (the last one of a row may be shorter)."""
    size = np.diff(offsets)
    count = -(-size // CHUNK)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * CHUNK
    length = np.minimum(CHUNK, offsets[row + 1] - start)
    out = np.zeros((2, len(row)), U)
    for k in range(2):
        if len(row):
            power = np.repeat(start + length - 1, length) - np.arange(int(offsets[-1]))
            out[k] = np.add.reduceat((data.astype(U) + U(1)) * _POWERS[k][power], start) % U(PRIMES[k])
    return row, length, out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row, its two parts in one number; 0 for an empty one."""
    n = len(offsets) - 1
    row, length, parts = chunk_fingerprints(data, offsets)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    whole = np.zeros((2, n), U)
    if len(row):
        whole[:, row[first]] = parts[:, first]
        for k in np.setdiff1d(np.arange(len(row)), first):
            whole[:, row[k]] = combine(tuple(map(int, whole[:, row[k]])), tuple(map(int, parts[:, k])), int(length[k]))
    return (whole[0] << U(31)) | whole[1]


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(fingerprints(data, offsets).view(np.int64)), pa.array(np.diff(offsets))], ["doc_id", "row", "print", "bytes"])


def same(a: memoryview, b: memoryview) -> bool:
    """Chunk by chunk, up to the first that differs."""
    return len(a) == len(b) and all(a[k : k + CHUNK] == b[k : k + CHUNK] for k in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (print, bytes, part, rid, text) sorted by all but the text: each text with the first of the same bytes.

    Of a group, only its differing texts are held, one unless fingerprints collide.
    """
    key, leaders = None, []
    for batch in batches:
        data, offsets = buffers(batch.column(4))
        view = memoryview(np.ascontiguousarray(data))
        ids = batch.column(3).to_pylist()
        out = []
        for k, now in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if now != key:
                key, leaders = now, []
            text = view[offsets[k] : offsets[k + 1]]
            lead = next((i for i, own in leaders if same(own, text)), None)
            if lead is None:
                lead = ids[k]
                leaders.append((lead, memoryview(bytes(text))))
            out.append(lead)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.int64())], ["print", "bytes", "rid", "leader"])


def _led(rows: DataFrame) -> DataFrame:
    """(print, bytes, rid, leader) from (print, bytes, n, rid, text), by parts of about PART texts of one fingerprint."""
    parted = rows.select("print", "bytes", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / PART)).alias("part"), "rid", "text")
    return parted.repartition("print", "bytes", "part").sortWithinPartitions("print", "bytes", "part", "rid").mapInArrow(_compare, "print long, bytes long, rid long, leader long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size, kept): documents whose text is byte for byte that of another one.

    group_id is the smallest doc_id of the group, which is also the one kept. There is no false and no missed pair: equal
    texts have equal fingerprints and lengths, and these are compared in full. Copies of one text are compared in parts of
    about PART, then the leaders of the parts, and so on until one is left, so no task sees a whole hot group.

    Nulls and empties: empty texts are equal to each other, null texts to none; a null doc_id is left out. Repeated rows of
    one doc_id and text are one document; rows of one doc_id with other texts are other documents. An empty table gives no
    row. Columns other than doc_id and text aren't read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("row", F.xxhash64("text"))
    prints = durable(own.mapInArrow(_print, "doc_id long, row long, print long, bytes long").distinct())
    size = prints.groupBy("print", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    named = prints.join(size, ["print", "bytes"])
    # the one shuffle of texts: only candidates' are left after it
    texts = durable(own.join(named, ["doc_id", "row"]).select("print", "bytes", "n", "doc_id", "row", "text", F.monotonically_increasing_id().alias("rid")))
    led = durable(_led(texts))
    most = size.agg(F.max("n")).first()[0] or 0
    while most > PART:
        # the leaders of groups in parts, compared in turn
        open_ = led.join(size.where(F.col("n") > PART), ["print", "bytes"], "left_semi").select("print", "bytes", F.col("leader").alias("rid")).distinct()
        size = durable(open_.groupBy("print", "bytes").agg(F.count("*").alias("n")))
        before, most = most, size.agg(F.max("n")).first()[0] or 0
        if most >= before:  # more than PART different texts of one fingerprint: one last time, in one part
            size, most = size.withColumn("n", F.lit(1).cast("long")), 0
        again = open_.join(size, ["print", "bytes"]).join(texts.select("rid", "text"), "rid")
        head = _led(again).select(F.col("rid").alias("leader"), F.col("leader").alias("head"))
        led = durable(led.join(head, "leader", "left").select("print", "bytes", "rid", F.coalesce("head", "leader").alias("leader")))
    groups = texts.select("rid", "doc_id").join(led.select("rid", "leader"), "rid").select("leader", "doc_id").distinct()
    sized = groups.groupBy("leader").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id")).where("group_size > 1")
    return groups.join(sized, "leader").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))
