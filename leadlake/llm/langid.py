"""Operator 5: language identification, whole words first, then ever shorter character n-grams.

A word known from training scores by its log frequency in each language. A word that was never seen scores by the mean over
its known n-grams of the longest length, from GRAM characters down to one, of which it has any. A text's score in a
language is the mean over its words. Every word of the sample is known: the sample is bounded in documents, by TRAIN_DOCS,
and nothing else cuts the model.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadlake.llm._text import WORD_RE, buffers, draw_bound, free_names, lower, released, slices, span_hashes, word_bounds

#: Labelled documents of each language that the model is fitted on, about; a hash of the id draws them.
TRAIN_DOCS = 600
GRAM = 4
#: The least lead of the best language, in log frequency a word; below it the language is undetermined.
MARGIN = 0.05


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray
    grams: list[np.ndarray]  # for each length from 1: sorted hashes
    gram_scores: list[np.ndarray]


def _hashes(values: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(values, pa.large_string()))
    return span_hashes(data, offsets[:-1], offsets[1:])


def _scores(counts: dict[str, dict[str, float]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and the log frequency of each in each language, with half an occurrence added."""
    names = sorted({w for lang in langs for w in counts[lang]})
    table = np.array([[counts[lang].get(w, 0) for lang in langs] for w in names], float).reshape(len(names), len(langs))
    total = np.array([sum(counts[lang].values()) for lang in langs]) + 0.5 * max(1, len(names))
    hashes = _hashes(names)
    order = np.argsort(hashes)
    return hashes[order], np.log((table + 0.5) / total)[order]


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """From word counts by language."""
    langs = sorted(counts)
    grams = []
    for size in range(1, GRAM + 1):
        by: dict[str, Counter] = defaultdict(Counter)
        for lang in langs:
            for word, n in counts[lang].items():
                for k in range(len(word) - size + 1):
                    by[lang][word[k : k + size]] += n
        grams.append(_scores(by, langs))
    return Model(langs, *_scores(counts, langs), [g[0] for g in grams], [g[1] for g in grams])


def train(labelled: DataFrame, docs_per_language: int = TRAIN_DOCS) -> Model:
    """Fits on about ``docs_per_language`` rows of each value of ``lang``, whole texts; all of them where there are fewer.

    Rows with a null lang or text aren't labelled and take no part; empty texts have no word. A hash of id and text draws the
    rows, so rows with a null id are drawn like others, and repeated rows are drawn together. Ties in frequency need no order.
    An empty table gives a model of no language, which leaves every text undetermined. Other columns aren't read.
    """
    known = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = dict(known.groupBy("lang").count().collect())
    if not sizes:
        return fit({})
    bounds = {lang: draw_bound(n, docs_per_language) for lang, n in sizes.items()}
    share = F.element_at(F.create_map(*(F.lit(x) for lang, b in bounds.items() for x in (lang, (1 << 63) - 1 if b is None else b))), F.col("lang"))
    drawn = known.where(F.xxhash64("doc_id", "text") <= share)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_RE), F.lit(0))).alias("word"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for part in words.groupBy("lang", "word").count().toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in part.columns)):
            counts[lang][word] = n
    return fit(counts)


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word in each language; NaN where no single character is known."""
    hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    out = np.full((len(hashes), len(model.langs)), np.nan)
    at, known = _find(model.words, hashes)
    out[known] = model.word_scores[at[known]]
    open_ = np.flatnonzero(~known)
    begin = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    low, high = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    for size in range(GRAM, 0, -1):
        count = np.maximum(high[open_] - low[open_] - size + 1, 0)
        if not count.sum():
            continue
        owner = np.repeat(np.arange(len(open_)), count)
        place = np.repeat(low[open_] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at, known = _find(model.grams[size - 1], span_hashes(data, begin[place], begin[place + size]))
        owner, at = owner[known], at[known]
        n = np.bincount(owner, minlength=len(open_))
        for k in range(len(model.langs)):
            total = np.bincount(owner, model.gram_scores[size - 1][at, k], minlength=len(open_))
            out[open_[n > 0], k] = total[n > 0] / n[n > 0]
        open_ = open_[n == 0]
    return out[inverse]


def text_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of scored words of each row, and their mean score in each language."""
    starts, ends, row = word_bounds(data, offsets)
    scores = word_scores(model, data, starts, ends)
    good = ~np.isnan(scores[:, 0]) if len(model.langs) else np.zeros(len(row), bool)
    n = np.bincount(row[good], minlength=len(offsets) - 1)
    mean = np.stack([np.bincount(row[good], scores[good, k], minlength=len(offsets) - 1) for k in range(len(model.langs))], 1) if model.langs else np.zeros((len(n), 0))
    return n, mean / np.maximum(n, 1)[:, None]


def _guess(held, id_at: int, text_at: int, carry: bool, added_names: list[str]):
    """Adds the best language, its lead and the number of words; carries the whole row, or only its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        names = np.array(model.langs, object)
        for batch in batches:
            for low, high, data, offsets in slices(lower(batch.column(text_at))):
                n, scores = text_scores(model, data, offsets)
                order = np.argsort(-scores, axis=1, kind="stable")
                if len(names) > 1:
                    lead = np.take_along_axis(scores, order[:, :1], 1)[:, 0] - np.take_along_axis(scores, order[:, 1:2], 1)[:, 0]
                else:
                    lead = np.full(len(n), np.inf if len(names) else 0.0)
                sure = (n > 0) & (lead >= MARGIN)
                best = np.full(len(n), None, object)
                if len(names):
                    best[sure] = names[order[sure, 0]]
                part = batch.slice(low, high - low)
                added = [pa.array(best.tolist(), pa.string()), pa.array(np.where(n > 0, lead, 0.0)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.columns if carry else [part.column(id_at)]), *added], [*(batch.schema.names if carry else ["doc_id"]), *added_names])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, lead, words) for every row: the language, by how much it leads a word, and the words scored.

    lang is null where no word can be scored or the lead is under MARGIN: empty and null texts, symbols, foreign scripts,
    ties. Repeated rows are each given; a null doc_id stays null; an empty table gives no row; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(released(_guess(held, 0, 1, False, ["lang", "lead", "words"])), "doc_id long, lang string, lead double, words long")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those whose language can't be told; all columns stay as they are. One narrow pass.

    A row goes where ``identify`` has a null lang: null, empty and wordless texts, foreign scripts, ties. Each repeated row and
    each row with a null doc_id is judged by its own text; an empty table stays empty; columns of any name are carried along.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = free_names(docs.columns, "lang", "lead", "words")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` long").fields])
    guessed = docs.mapInArrow(released(_guess(held, docs.columns.index("doc_id"), docs.columns.index("text"), True, names)), schema)
    return guessed.where(F.col(names[0]).isNotNull()).select(docs.columns)
