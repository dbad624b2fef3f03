"""Operator 2: benchmark decontamination with an FM-index for each shard of the training text.

Each worker indexes its shard, a run of whole documents, once: a suffix array over word symbols by prefix doubling, its
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled every SAMPLE words. All test phrases are then
searched backwards together, occurrences are located by walking to a sample, and overlapping ones merge into spans. Words
that no phrase has, and runs shorter than the shortest phrase, can't be in an occurrence and act as separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._text import buffers, lower, released, slices, span_hashes, word_bounds

#: Words of a test phrase; an item of fewer words is one phrase.
PHRASE = 8
SAMPLE = 8
#: Bytes of text in a shard's index.
SHARD = 6 << 20
#: Words of phrases that a worker holds at once; a larger benchmark is searched in several passes.
PART_WORDS = 8_000_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 is a separator, less than any word, and earlier ones are less than later ones."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 2 if step == 1 else n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]) if n else 0
        rank = new
        if not n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access on a sequence of symbols below 2 ** bits, for whole arrays of questions."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            count = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(sequence) - int(count[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1) == 1
            a, b = ones[at], ones[begin]
            at, begin = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, begin - b)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[at]
            bit = ones[at + 1] > a
            out = (out << 1) | bit
            at = np.where(bit, zeros + a, at - a)
        return out


class FMIndex:
    """Of a sequence of word symbols from 1 on with separators 0; the first symbol is a separator."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma + 1), out=self.first[1:])
        self.wavelet = WaveletMatrix(symbols[order - 1].astype(np.int64), max(1, int(sigma).bit_length()))
        start = np.r_[True, symbols[:-1] == 0]
        held = ((order % sample) == 0) | start[order]
        self.samples = order[held]
        self.held = np.zeros(self.n + 1, np.int64)
        np.cumsum(held, out=self.held[1:])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase, a row of the matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            at = rows[live]
            known = self.held[at + 1] > self.held[at]
            out[live[known]] = self.samples[self.held[at[known]]] + steps
            live, at, steps = live[~known], at[~known], steps + 1
            symbol = self.wavelet.access(at)
            rows[live] = self.first[symbol] + self.wavelet.rank(symbol, at)
        return out


def phrase_table(texts: list[str], phrase: int = PHRASE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted word hashes, and for each length a matrix of distinct phrases as 1-based places in them."""
    data, offsets = buffers(lower(pa.array(texts, pa.large_string())))
    starts, ends, row = word_bounds(data, offsets)
    words, symbols = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    by_length: dict[int, list[np.ndarray]] = {}
    for own in np.split(symbols + 1, np.flatnonzero(row[1:] != row[:-1]) + 1) if len(row) else []:
        size = min(phrase, len(own))
        by_length.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(own, size))
    return words, [np.unique(np.concatenate(parts), axis=0).astype(np.int64) for parts in by_length.values()]


def spans_in(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, phrases: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Row, first and end word, start and end byte of each merged span, in order. Places count from the row's start."""
    starts, ends, row = word_bounds(data, offsets)
    none = (np.zeros(0, np.int64),) * 5
    if not len(starts) or not phrases:
        return none
    hashes = span_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    symbol = np.where(words[at] == hashes, at + 1, 0)
    shortest = min(p.shape[1] for p in phrases)
    cut = np.r_[True, (row[1:] != row[:-1]) | (symbol[1:] == 0) | (symbol[:-1] == 0)]
    run = np.cumsum(cut) - 1
    long = (np.bincount(run) >= shortest)[run] & (symbol > 0)
    place = np.flatnonzero(long)
    if not len(place):
        return none
    # a separator before each run that is kept
    fresh = np.r_[True, run[place][1:] != run[place][:-1]]
    where = np.arange(len(place)) + np.cumsum(fresh)
    sequence = np.zeros(len(place) + int(fresh.sum()), np.int64)
    sequence[where] = symbol[place]
    back = np.zeros(len(sequence), np.int64)
    back[where] = place
    index = FMIndex(sequence, len(words))
    found = []
    for matrix in phrases:
        low, high = index.search(matrix)
        size = high - low
        if size.sum():
            rows = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            first = back[index.locate(rows)]
            found.append(np.stack([first, first + matrix.shape[1]], 1))
    if not found:
        return none
    hits = np.concatenate(found)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    owner = row[hits[:, 0]]
    reach = np.maximum.accumulate(hits[:, 1])  # spans never cross rows, so a running maximum is safe
    fresh = np.r_[True, (hits[1:, 0] > reach[:-1]) | (owner[1:] != owner[:-1])]
    first = hits[fresh, 0]
    end = reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(hits) - 1]]
    owner = owner[fresh]
    base = np.searchsorted(row, owner)
    return owner, first - base, end - base, starts[first] - offsets[owner], ends[end - 1] - offsets[owner]


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Spans of several ``spans_in`` over the same rows as one: overlapping and touching ones of a row are joined."""
    if len(found) == 1:
        return found[0]
    row, first, end, start, stop = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((end, first, row))
    row, first, end, start, stop = (x[order] for x in (row, first, end, start, stop))
    if not len(row):
        return row, first, end, start, stop
    wide, high = int(end.max()) + 1, int(stop.max()) + 1
    reach = np.maximum.accumulate(row * wide + end) - row * wide  # of a row's own spans, as a later row's keys are higher
    fresh = np.r_[True, (row[1:] != row[:-1]) | (first[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(row) - 1]
    return row[fresh], first[fresh], reach[last], start[fresh], (np.maximum.accumulate(row * high + stop) - row * high)[last]


def _tables(held: list) -> Iterator[tuple]:
    """The phrase table of each part; of several only one stays in memory."""
    for part in held:
        yield part.value
        if len(held) > 1 and getattr(part, "_path", None) is not None:  # read again from the worker's disk when it is next used
            part.__dict__.pop("_value", None)


def _found(held: list, column: pa.Array) -> Iterator[tuple]:
    """(first row, bytes, offsets, spans of all parts) of each slice of a lower-case column."""
    cuts = list(slices(column, SHARD))
    spans: list[list] = [[] for _ in cuts]
    for words, phrases in _tables(held):
        for own, (_, _, data, offsets) in zip(spans, cuts):
            own.append(spans_in(data, offsets, words, phrases))
    for own, (low, _, data, offsets) in zip(spans, cuts):
        yield low, data, offsets, _merged(own)


def _finder(held: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, data, offsets, (row, first, end, start, stop) in _found(held, lower(batch.column(1))):
                if len(row):
                    chars = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                    base = chars[offsets[row]]
                    places = (first, end, chars[start + offsets[row]] - base, chars[stop + offsets[row]] - base)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + low)), *(pa.array(x.astype(np.int64)) for x in places)], ["doc_id", "first_word", "end_word", "start", "stop"])

    return run


def _parts(benchmark: DataFrame, phrase: int) -> Iterator[tuple]:
    """Phrase tables of at most about PART_WORDS words; their size is counted before anything is fetched."""
    items = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) * phrase // (4 * PART_WORDS)))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        yield phrase_table([r[0] for r in own.distinct().collect()], phrase)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, first_word, end_word, start, stop): merged spans of the documents that hold test phrases.

    A phrase is any ``phrase`` consecutive words of a benchmark text, or the whole of a shorter one; words are compared
    without case and punctuation, and never across documents. first_word and end_word count words, start and stop count
    characters, from 0, the end not included. Overlapping and touching occurrences are one span.

    Nulls and empties: a null or wordless text holds no span and no phrase; a null doc_id is reported as null. Repeated
    rows are each reported. An empty benchmark or table gives no row. Columns other than doc_id and text aren't read.
    The pass is narrow: no shuffle. A benchmark of more than PART_WORDS words is searched part by part within it.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    held = [spark.sparkContext.broadcast(part) for part in _parts(benchmark, phrase)]
    return narrow.mapInArrow(released(_finder(held)), "doc_id long, first_word long, end_word long, start long, stop long")


def _cutter(held: list, text: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.large_string())
            new: dict[int, str] = {}
            for low, _, _, (row, _, _, start, stop) in _found(held, lower(column)):
                edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
                for a, b in zip(edge, np.r_[edge[1:], len(row)]):
                    raw, at = column[int(low + row[a])].as_py().encode(), 0
                    kept = []
                    for x, y in zip(start[a:b].tolist(), stop[a:b].tolist()):
                        kept.append(raw[at:x])
                        at = y
                    new[int(low + row[a])] = b"".join([*kept, raw[at:]]).decode()
            if not new:
                yield batch
                continue
            stays = np.ones(len(batch), bool)
            stays[[k for k, t in new.items() if not any(map(str.isalnum, t))]] = False
            columns = list(batch.columns)
            columns[text] = pa.array([new.get(k, t) for k, t in enumerate(column.to_pylist())], batch.schema.field(text).type)
            if chars is not None:
                counted = columns[chars].to_pylist()
                columns[chars] = pa.array([len(new[k]) if k in new else n for k, n in enumerate(counted)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stays))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with all spans of ``contaminated_spans`` cut out of the text; a text of which no word is left goes.

    Other columns and all other rows stay as they are, null and wordless texts among them. n_chars, if there is one and it is
    a number, is set anew for texts that changed. Repeated rows and rows with a null doc_id are each cut by their own text; an
    empty benchmark or table changes nothing; columns of any name are carried along.
    """
    held = [docs.sparkSession.sparkContext.broadcast(part) for part in _parts(benchmark, phrase)]
    chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None
    return docs.mapInArrow(released(_cutter(held, docs.columns.index("text"), chars)), docs.schema)
