"""Operator 10: exact token counts at every prefix, by dynamic programming.

The text is split as the tokenizer splits it. For the bytes of a piece, ``last[i]`` is the last token of the encoding of its
first i bytes: the one token t ending there such that t is compatible with ``last[i - len(t)]``, that is, the two encode to
themselves when joined. So each prefix is one step from a shorter one, and its count is that one's plus one. Nothing is
encoded again to answer how long a prefix fits a budget, or what a cut costs.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._text import slices, span_hashes

#: A rank file: a line for each token, base64 and rank. The environment may name another.
RANKS = os.environ.get("LEADLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BUDGETS = (512, 2048, 8192)
#: Bytes of a rank file that are handed to workers at most.
MOST_RANKS = 64 << 20
#: Pieces whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000

SPACE, LETTER, NUMBER, OTHER = range(4)
_state: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _state:
        out = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            first = unicodedata.category(chr(code))[0]
            if first in "LN":
                out[code] = LETTER if first == "L" else NUMBER
        out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _state["classes"] = out
    return _state["classes"]


class PrefixCounter:
    """Token counts of all prefixes of one piece, under a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = ahocorasick.Automaton()  # all tokens that end at each byte, in one walk
        for token, rank in ranks.items():
            self.tokens.add_word(token.decode("latin-1"), (len(token), rank))
        self.tokens.make_automaton()
        self.plain = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, np.ndarray] = {}

    @classmethod
    def of(cls, raw: bytes) -> PrefixCounter:
        """The counter of a rank file's bytes, made once a worker."""
        key = hashlib.sha256(raw).digest()
        if key not in _state:
            _state[key] = cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())})
        return _state[key]

    @classmethod
    def load(cls, path: str) -> PrefixCounter:
        return cls.of(rank_file(path))

    def encode(self, piece: bytes) -> list[int]:
        return self.plain._encode_single_piece(piece)

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        if (out := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            out = self.pairs[key] = self.encode(self.bytes[left] + self.bytes[right]) == [left, right]
        return out

    def counts(self, piece: bytes) -> np.ndarray:
        """counts[i]: the tokens of the first i characters of the piece, from 0 to all."""
        if (out := self.known.get(piece)) is not None:
            return out
        n, pairs, slow = len(piece), self.pairs, self.compatible
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, token) in self.tokens.iter(piece.decode("latin-1")):
            end += 1
            start = end - size
            if last[end] < 0 and (start == 0 or (last[start] >= 0 and (slow(last[start], token) if (fits := pairs.get((last[start], token))) is None else fits))):
                last[end], count[end] = token, count[start] + 1
        ends = [k for k in range(1, n) if piece[k] & 0xC0 != 0x80]
        out = np.array([0, *(count[k] for k in ends), count[n]], np.int32)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = out
        return out


def rank_file(path: str) -> bytes:
    """The bytes of a rank file, which the driver reads and hands to the workers: at most MOST_RANKS."""
    if (size := os.path.getsize(path)) > MOST_RANKS:
        raise ValueError(f"{path} has {size} bytes, more than the {MOST_RANKS} that are handed to workers")
    with open(path, "rb") as file:
        return file.read()


def stored(steps: np.ndarray) -> bytes:
    """The steps of one text as bytes: the width of a step, 1 or 4, and the steps, little-endian. None is too large."""
    width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def steps_of(prefix: bytes) -> np.ndarray:
    return np.frombuffer(prefix, f"<i{prefix[0]}", offset=1)


def piece_starts(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the split pattern begin; first and last place of each run of white space whose last place is a
    piece of its own or leads the next one; the middle places of contractions of three characters."""
    n = len(codes)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    head = edge[:n]
    before = np.r_[np.uint8(9), kind[:-1]] if n else kind
    before = np.where(head, 9, before)
    blank = np.r_[False, codes[:-1] == 32] & ~head if n else np.zeros(0, bool)
    start = head | (kind != before)
    start &= ~((kind != SPACE) & blank)
    space = kind == SPACE
    ahead = np.r_[space[1:], False] & ~edge[1:]
    tail = space & ~ahead & ~edge[1:]  # the last white space before something else
    start |= tail
    run_head = np.flatnonzero(space & (before != SPACE))
    tails = np.flatnonzero(tail)
    heads = run_head[np.searchsorted(run_head, tails, "right") - 1]
    longer = heads < tails
    # contractions
    at = np.flatnonzero((codes == 39) & start & ~blank)
    room = offsets[np.searchsorted(offsets, at, "right")] - at
    one = np.where(room > 1, codes[np.minimum(at + 1, n - 1)], 0)
    two = np.where(room > 2, codes[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, width in ((at[short], 2), (at[long], 3)):
        start[hit + 1] = False
        after = hit + width
        after = after[after < n]
        start[after] = np.where(space[after] | edge[after], start[after], True)
    return np.flatnonzero(start), heads[longer], tails[longer], at[long] + 1


def prefix_counts(data: np.ndarray, offsets: np.ndarray, counter: PrefixCounter) -> tuple[np.ndarray, np.ndarray]:
    """For the characters of all rows, the tokens of the row's text up to and with each; and the rows' offsets in characters."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    chars = np.searchsorted(begin, offsets)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), chars
    starts, run_heads, run_tails, middles = piece_starts(codes, chars)
    ends = np.r_[starts[1:], n]
    # pieces, and the runs of white space as they are when the text ends with them
    a, b = np.r_[starts, run_heads], np.r_[ends, run_tails + 1]
    _, first, kind = np.unique(span_hashes(data, begin[a], begin[b]), return_index=True, return_inverse=True)
    raw = data.tobytes()
    tables = [counter.counts(raw[x:y]) for x, y in zip(begin[a[first]].tolist(), begin[b[first]].tolist())]
    pool = np.concatenate(tables)
    base = np.cumsum([0, *(len(t) for t in tables)])
    total = pool[base[1:] - 1]
    own, size = kind[: len(starts)], ends - starts
    summed = np.cumsum(total[own]) - total[own]
    place = np.arange(n) - np.repeat(starts, size) + 1
    out = np.repeat(summed, size) + pool[np.repeat(base[own], size) + place]
    piece = np.searchsorted(starts, run_heads, "right") - 1
    out[run_tails] = summed[piece] + total[kind[len(starts) :]]
    if len(middles):  # 'r of 're: two pieces while the e is missing
        piece = np.searchsorted(starts, middles, "right") - 1
        out[middles] = summed[piece] + [len(counter.encode(b"'")) + len(counter.encode(bytes([codes[k]]))) for k in middles]
    zero = np.r_[summed, 0][np.searchsorted(starts, chars[:-1])]
    return out - np.repeat(zero, np.diff(chars)), chars


def _count(held, budgets: tuple[int, ...], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(held.value)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                counts, chars = prefix_counts(data, offsets, counter)
                size = np.diff(chars)
                full = size > 0
                at = chars[:-1][full]
                step = np.diff(counts, prepend=0)
                step[at] = counts[at]
                tokens = np.zeros(len(size), np.int64)
                tokens[full] = counts[chars[1:][full] - 1]
                fits = []
                for budget in budgets:
                    fit = np.zeros(len(size), np.int64)
                    if len(at):
                        best = np.maximum.reduceat(np.where(counts <= budget, np.arange(1, len(counts) + 1), 0), at)
                        fit[full] = np.maximum(best - at, 0)
                    fits.append(fit)
                gone = pa.compute.is_null(batch.column(1).slice(low, high - low)).to_numpy(zero_copy_only=False)
                null = lambda x: pa.array(x, mask=gone)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), null(tokens), *map(null, fits), pa.array([None if g else stored(step[a:b]) for a, b, g in zip(chars[:-1], chars[1:], gone)], pa.binary())], names)

    return run


def token_prefixes(docs: DataFrame, ranks: str = RANKS, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_tokens, fit_<budget>..., prefix) for every row.

    prefix holds, for each character of the text, by how much the exact token count of the text up to it differs from the
    count one character before, see ``stored``; ``tokens_at`` and ``longest_within`` read it. fit_<budget> is the
    longest prefix, in characters, of at most so many tokens.

    Nulls and empties: a null text has null for all, an empty one 0 and an empty prefix; a null doc_id stays null. Repeated
    rows are each counted. An empty table gives no row. Other columns aren't read. The pass is narrow: no shuffle.
    """
    names = ["doc_id", "n_tokens", *(f"fit_{b}" for b in budgets), "prefix"]
    schema = "doc_id long, n_tokens long, " + "".join(f"fit_{b} long, " for b in budgets) + "prefix binary"
    held = docs.sparkSession.sparkContext.broadcast(rank_file(ranks))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count(held, tuple(budgets), names), schema)


def tokens_at(prefix: str | Column, chars: str | Column) -> Column:
    """The token count of the first ``chars`` characters, from a stored prefix."""

    @F.pandas_udf("long")
    def read(prefix: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or pd.isna(c) else int(steps_of(p)[: max(0, int(c))].sum(dtype=np.int64)) for p, c in zip(prefix, chars)], dtype="Int64")

    return read(prefix, chars)


def longest_within(prefix: str | Column, budget: str | Column) -> Column:
    """The longest prefix, in characters, of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def read(prefix: pd.Series, budget: pd.Series) -> pd.Series:
        def one(p: bytes, most: int) -> int:
            within = np.flatnonzero(np.cumsum(steps_of(p), dtype=np.int64) <= most)
            return int(within[-1]) + 1 if len(within) else 0

        return pd.Series([None if p is None or pd.isna(b) else one(p, int(b)) for p, b in zip(prefix, budget)], dtype="Int64")

    return read(prefix, budget)
