"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are numbered in a random order and cut into blocks. Every source has an exact quota of blocks. A tree
over the output shards hands them out: at each node the left half draws its blocks from the node's without replacement
(multivariate hypergeometric), the right half has the rest. So shards hold equally many blocks, sources meet their quotas
exactly, and no block is in two shards. The blocks of a source are permuted before they are dealt; each shard then
shuffles its own documents. A scarce source doesn't set the size of the mix: it is gone through several times, up to
``epochs``, and each further pass over its blocks counts as blocks of their own; what it can't give is spread over the rest.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm._graph import durable
from leadlake.llm._text import free_names

#: Documents in a block.
BLOCK = 8
SHARDS = 16
#: Documents of an output shard, about, where their number isn't given: there are SHARDS or more.
SHARD_DOCS = 1_000_000
SEED = 20_240_601
#: Without given weights, a source's weight is its number of documents to this power.
TEMPER = 0.5
#: Passes over a scarce source in the registered query.
EPOCHS = 4
#: Documents that one task numbers, about; their number sets how finely a source is cut before it is sorted.
BUCKET = 50_000
#: The stratum of documents without a source.
NONE = "\x00none"


def _shares(docs: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    if weights is None:
        share = {s: n**TEMPER for s, n in docs.items()}
    else:
        given = {NONE if s is None else s: w for s, w in weights.items()}
        share = {s: float(given.get(s, 0.0)) for s in docs}
    if any(w < 0 or not np.isfinite(w) for w in share.values()):
        raise ValueError("weights must be finite and not negative")
    return {s: w for s, w in share.items() if w > 0}


def filled_quotas(docs: dict[str, int], weights: dict[str, float] | None, block: int = BLOCK, epochs: int = 1, total: int | None = None) -> dict[str, int]:
    """Blocks to draw from each source, passes included, where scarce sources don't set the size of the mix.

    A source gives its share of ``total`` documents, ``epochs`` times its documents at most; what scarce sources can't give
    is spread over the rest by weight. Without ``total`` the mix is the least that has every document of every source with a
    weight. The last block of a source may be a partial one and a pass ends with it.
    """
    share = _shares(docs, weights)
    if epochs < 1 or (total is not None and total < 0):
        raise ValueError("epochs must be 1 at least, total not negative")
    if weights is not None and total is None and epochs == 1:
        raise ValueError("weights need a total or epochs: every document just once is the natural mix, whatever the weights")
    if total is None:
        level = max((docs[s] / w for s, w in share.items()), default=0.0)
    else:
        level, left, weight = math.inf, float(total), sum(share.values())
        for s in sorted(share, key=lambda s: epochs * docs[s] / share[s]):
            if left / weight <= epochs * docs[s] / share[s]:
                level = left / weight
                break
            left, weight = left - epochs * docs[s], weight - share[s]
    out = dict.fromkeys(docs, 0)
    for s, w in share.items():
        n, blocks = docs[s], -(-docs[s] // block)
        wanted = min(epochs * n, level * w)
        passes = min(epochs, int(wanted / n + 1e-9))
        out[s] = passes * blocks + min(blocks, round(max(0.0, wanted - passes * n) * blocks / n))
    return out


def split_blocks(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each shard: a row for each shard; columns sum to the quotas, rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    sizes = np.full(shards, sum(quotas) // shards)
    sizes[: sum(quotas) % shards] += 1

    def deal(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            out[low] = own
            return
        middle = (low + high) // 2
        random = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = random.multivariate_hypergeometric(own, int(sizes[low:middle].sum()), method="marginals") if own.sum() else own
        deal(low, middle, left)
        deal(middle, high, own - left)

    deal(0, shards, np.array(quotas, np.int64))
    return out


def deal_blocks(quotas: dict[str, int], blocks: dict[str, int], shards: int, seed: int = SEED) -> list[tuple[str, int, int, int, list[int]]]:
    """(source, blocks, factor, offset, ends): how the blocks of each source that has a quota are dealt.

    Block b stands at place (factor * b + offset) mod blocks, a permutation as factor and blocks have no common divisor, and
    in each further pass that many blocks later; the shard is the first whose end is above that place, none beyond the last
    end, which is the quota.
    """
    names = sorted(s for s in quotas if quotas[s])
    table = split_blocks([quotas[s] for s in names], shards, seed)
    out = []
    for k, name in enumerate(names):
        random, n = np.random.Generator(np.random.PCG64([seed, zlib.crc32(name.encode())])), blocks[name]
        most = max(1, min(n - 1, (1 << 62) // n))  # no overflow of 64 bits
        factor = int(random.integers(1, most + 1))
        while math.gcd(factor, n) != 1:
            factor = factor % most + 1
        out.append((name, n, factor, int(random.integers(0, n)), np.cumsum(table[:, k]).tolist()))
    return out


def _key(seed: int, salt: int, *more: str):
    return F.xxhash64(F.lit(seed), F.lit(salt), F.col("key"), *more)


def _shard(ends: str, at: str):
    """How many of the sorted ``ends`` are not above ``at``: in two steps, so that it costs the root of their number."""
    width = F.ceil(F.sqrt(F.size(ends))).cast("int")
    heads = F.filter(ends, lambda end, k: ((k + 1) % width == 0) & (end <= F.col(at)))
    return F.size(heads) * width + F.size(F.filter(F.slice(ends, F.size(heads) * width + 1, width), lambda end: end <= F.col(at)))


def _mix(rows: DataFrame, weights: dict | None, shards: int | None, block: int, seed: int, epochs: int, total: int | None) -> tuple[DataFrame, int, int]:
    """(key, source, block, shard, place) from (key, source), the number of shards, and the most documents of one; sources aren't null."""
    spark = rows.sparkSession
    own = durable(rows.groupBy("key").agg(F.min("source").alias("source")))
    count = {r[0]: r[1] for r in own.groupBy("source").count().collect()}
    blocks, quotas = {s: -(-n // block) for s, n in count.items()}, filled_quotas(count, weights, block, epochs, total)
    drawn_docs = sum(quotas.values()) * block
    shards = shards or max(SHARDS, -(-drawn_docs // SHARD_DOCS))
    buckets = max(1, -(-sum(count.values()) // BUCKET))
    keyed = own.withColumn("_order", _key(seed, 1)).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "key"), F.lit(buckets)))
    sizes = keyed.groupBy("source", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("count")).drop("count")
    numbered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_order", "key")) - 1).join(sizes, ["source", "_bucket"])
    numbered = numbered.select("key", "source", F.floor((F.col("_before") + F.col("_nth")) / block).alias("block"))
    plan = deal_blocks(quotas, blocks, shards, seed)
    # as Arrow: rows would start Python workers of another kind, which stay beside those of the other stages
    types = [("source", pa.string()), ("_blocks", pa.int64()), ("_factor", pa.int64()), ("_offset", pa.int64()), ("_ends", pa.list_(pa.int64()))]
    table = spark.createDataFrame(pa.table([pa.array([row[k] for row in plan], kind) for k, (_, kind) in enumerate(types)], [name for name, _ in types]))
    first = numbered.join(table, "source").withColumn("_at", F.pmod(F.col("_factor") * F.col("block") + F.col("_offset"), F.col("_blocks")))
    last = F.floor((F.element_at("_ends", -1) - 1) / F.col("_blocks"))
    drawn = first.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumns({"_at": F.col("_at") + F.col("_pass") * F.col("_blocks"), "block": F.col("block") + F.col("_pass") * F.col("_blocks")})
    drawn = drawn.where(F.col("_at") < F.element_at("_ends", -1)).withColumn("shard", _shard("_ends", "_at")).select("key", "source", "block", "shard")
    fine = max(1, -(-drawn_docs // shards // BUCKET))
    local = durable(drawn.withColumn("_order", _key(seed, 3, "block")).withColumn("_bucket", F.pmod(_key(seed, 4, "block"), F.lit(fine))))
    before = local.groupBy("shard", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")).drop("count")
    placed = local.withColumn("_nth", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_order", "key")) - 1).join(before, ["shard", "_bucket"])
    return placed.select("key", "source", "block", "shard", (F.col("_before") + F.col("_nth")).alias("place")), shards, -(-sum(quotas.values()) // shards) * block


def mix_sources(docs: DataFrame, weights: dict | None = None, shards: int | None = None, block: int = BLOCK, seed: int = SEED, epochs: int = 1, total: int | None = None) -> DataFrame:
    """(doc_id, source, block, shard, place): the documents drawn, their output shard and their place in it.

    ``weights`` are shares of documents by source (None for documents without one), to any scale; without them a source weighs
    its number of documents to the power TEMPER. The size is ``total`` documents, or what takes every document at least once,
    see ``filled_quotas``: a source is gone through up to ``epochs`` times, numbers of documents match the weights to within a
    block a source wherever a source has enough, and partial blocks and sources smaller than a block take part. So by default
    every document is drawn just once. The blocks of a further pass are numbered on, so a document has a row for each pass that
    draws it.

    Nulls and empties: documents without a source are a source of their own; a null doc_id is left out; texts aren't read,
    so empty and null ones count as documents. Repeated rows of one doc_id are one document, with the least source. Ties in the
    random order fall to the smaller doc_id. An empty table gives no row. Other columns aren't read.

    Numbering sorts small buckets of the hash, never a whole source in one task. Through the driver pass only numbers by
    source and by source and shard, as many for any number of documents of a shard.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"))
    mixed, _, _ = _mix(rows, weights, shards, block, seed, epochs, total)
    return mixed.select(F.col("key").alias("doc_id"), F.when(F.col("source") != NONE, F.col("source")).alias("source"), "block", "shard", "place")


def mixed_documents(docs: DataFrame, weights: dict | None = None, shards: int | None = None, block: int = BLOCK, seed: int = SEED, epochs: int = 1, total: int | None = None) -> DataFrame:
    """The documents drawn, with all their columns and mix_shard and mix_place, which replace columns of these names, laid out as
    the mix says: each partition, and so each file written, is a run of at most BUCKET places of one shard, in order, and the
    partitions follow each other by shard and place.

    As ``mix_sources``, but no row is left out: one with a null doc_id goes by a hash of its text. Rows of one doc_id are one
    document and all there, at one place, once a pass, by a hash of their texts. An empty table stays empty; other columns of
    any name are carried along.
    """
    kept = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_place")]
    (key,) = free_names(docs.columns, "key")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    plan, shards, most = _mix(docs.select(ident.alias("key"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source")), weights, shards, block, seed, epochs, total)
    plan = plan.select(F.col("key").alias(key), F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place"))
    runs = max(1, -(-most // BUCKET))
    run = (F.col("mix_shard") * runs + F.floor(F.col("mix_place") / BUCKET)).cast("int")
    out = docs.select(kept).join(plan, ident == F.col(key)).drop(key)
    return out.repartitionById(shards * runs, run).sortWithinPartitions("mix_place", F.xxhash64(F.col("text").cast("string")))
