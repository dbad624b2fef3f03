"""Operator 7: document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its own features and some of its neighbours' give its score; the transition of the chain ties
it to the line before. Forward-backward yields the probability that a line is good; weighted by length, these make the
quality of the document. The field is fitted on a bounded sample of labelled documents. Labels are of documents, so the states
of lines are latent: the label is taken to be that of the line in which a random character stands, up to a little noise. Its
likelihood is then the quality itself, so the fit maximises just what is used later, summed over all states of the lines. A
good document may hold bad lines and the other way round, and the chain learns how one turns into the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._text import draw_bound, lower, slices, span_hashes, word_bounds

#: Labelled documents that the model is fitted on, about; a hash of the id draws them.
TRAIN_DOCS = 2000
ROUNDS = 100
RIDGE = 1e-3
#: The share of labels that are taken to be wrong, either way.
NOISE = 0.01
OWN = 9
#: A line looks at the features of the one before and the one after too; their constant says that there is one.
FEATURES = 3 * OWN
#: A line is good, and a document worth keeping, from here on. Of held-out documents, the worst thousandth of the good ones
#: has 0.72, and one bad one in 57 is above a half.
GOOD, KEEP = 0.5, 0.5


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines (the line break belongs to the line), and the row of each. An empty text has no line."""
    cuts = np.unique(np.r_[offsets, np.flatnonzero(data == 10) + 1]).astype(np.int64)
    return cuts, np.searchsorted(offsets, cuts[:-1], "right") - 1


_UPPER, _DIGIT, _MARK, _SHOUT, _CONT = (np.zeros(256, np.float32) for _ in range(5))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[c for c in range(33, 127) if chr(c) in "#$%&*@^~|<>{}[]\\=+_/"]] = 1
_SHOUT[[33, 63]] = 1
_CONT[128:192] = 1


def features(raw: np.ndarray, folded: np.ndarray, cuts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of each line, and its length in characters. raw and folded are the same text, folded in lower case."""
    n = len(row)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0)
    size = np.diff(cuts)
    chars = size - np.add.reduceat(_CONT[raw], cuts[:-1])
    share = lambda table: np.add.reduceat(table[raw], cuts[:-1]) / np.maximum(chars, 1)
    starts, ends, line = word_bounds(folded, cuts)
    words = np.bincount(line, minlength=n)
    hashes = span_hashes(folded, starts, ends)
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])] if len(line) else np.zeros(0, bool)
    repeat = np.bincount(line[again], minlength=n) / np.maximum(words, 1)
    own = np.stack([np.ones(n), np.log1p(chars) / 5, share(_UPPER) * 2, share(_DIGIT) * 5, share(_MARK) * 10, share(_SHOUT) * 10, repeat * 3, np.minimum(chars / np.maximum(words, 1), 30) / 10, (words == 0) * 1.0], 1)
    out = np.zeros((n, FEATURES))
    out[:, :OWN] = own
    same = row[1:] == row[:-1]
    out[1:, OWN : 2 * OWN] = own[:-1] * same[:, None]
    out[:-1, 2 * OWN :] = own[1:] * same[:, None]
    return out, np.maximum(chars - (raw[cuts[1:] - 1] == 10), 0).astype(float)


@dataclass
class Field:
    weights: np.ndarray  # for "good" against "bad"
    moves: np.ndarray  # log weight of (state before, state)


def marginals(score: np.ndarray, row: np.ndarray, moves: np.ndarray, pairs: bool = False, weight: np.ndarray | None = None) -> tuple:
    """Probability that each line is good, for chains in a row; with ``pairs``, also log Z and the expected moves, where
    ``weight`` is that of each chain.

    All chains advance together, line by line: the first lines of all, then the second ones of those that have any.
    """
    n = len(score)
    emit = np.stack([np.zeros(n), score], 1)
    fresh = np.r_[True, row[1:] != row[:-1]] if n else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, n])
    by_size = np.argsort(-size, kind="stable")
    first, size = first[by_size], size[by_size]
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(size.max(initial=0))
    alive = [int(np.searchsorted(-size, -k, "left")) for k in range(longest + 1)]  # chains of more than k lines
    ahead[first] = emit[first]
    for k in range(1, longest):
        at = first[: alive[k]] + k
        ahead[at] = np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1]) + emit[at]
    for k in range(longest - 1, 0, -1):
        at = first[: alive[k]] + k
        onward = back[at] + emit[at]
        back[at - 1] = np.logaddexp(onward[:, :1] + moves[:, 0], onward[:, 1:] + moves[:, 1])
    whole = np.logaddexp(ahead[:, 0] + back[:, 0], ahead[:, 1] + back[:, 1])
    good = np.exp(ahead[:, 1] + back[:, 1] - whole)
    if not pairs:
        return (good,)
    later = np.flatnonzero(~fresh)
    joint = np.exp(ahead[later - 1][:, :, None] + moves + (emit + back)[later][:, None, :] - whole[later][:, None, None])
    if weight is not None:
        joint = joint * weight[np.cumsum(fresh)[later] - 1][:, None, None]
    return good, whole[first].sum(), joint.sum(0)


def fit(x: np.ndarray, row: np.ndarray, label: np.ndarray, size: np.ndarray, rounds: int = ROUNDS, noise: float = NOISE) -> Field:
    """Maximum likelihood by Adam steps, documents of both classes weighing alike; ``label`` is the document's, 0 or 1, and ``size``
    the length, for each line.

    The quality of a document is the mean of its marginals with weights w. Its slope in a line's score is the change of that
    line's marginal when all scores move along w, as log Z has one second derivative either way; so two more passes of
    forward-backward, a small step along w and back, give the slopes of all documents in time linear in the lines.
    """
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x) or len(np.unique(label)) < 2:
        field.weights[0] = 4.0 if not len(label) or label[0] else -4.0
        return field
    doc = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = size + 1e-9
    share = size / np.bincount(doc, size)[doc]
    own = label[first]
    sign = np.where(own == 1, 1.0, -1.0)
    worth = np.where(own == 1, 0.5 / max(1, (own == 1).sum()), 0.5 / max(1, (own == 0).sum()))
    theta, m, v, tiny = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), 1e-4
    for step in range(1, rounds + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ weights
        (good,) = marginals(score, row, moves)
        mean = np.bincount(doc, share * good)
        shown = noise + (1 - 2 * noise) * np.where(own == 1, mean, 1 - mean)
        along = (sign * (1 - 2 * noise) / shown)[doc] * share
        pull = tiny * along
        up, _, more = marginals(score + pull, row, moves, pairs=True, weight=worth)
        down, _, less = marginals(score - pull, row, moves, pairs=True, weight=worth)
        slope = np.r_[x.T @ (worth[doc] * (up - down)), (more - less).reshape(-1)] / (2 * tiny) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def _lined(batch: pa.RecordBatch, at: int) -> Iterator[tuple]:
    folded = lower(batch.column(at))
    for (low, high, raw, offsets), (_, _, small, _) in zip(slices(batch.column(at)), slices(folded)):
        cuts, row = lines_of(raw, offsets)
        yield low, high, row, *features(raw, small, cuts, row)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Fits on about ``most`` labelled documents, drawn by a hash of their id; whole texts.

    Labels with a null doc_id or quality are left out; a document with labels of both kinds takes part with each; repeated
    labels count once, repeated documents each; null and empty texts have no line. Without a label, or with one kind only, the
    field says that every line is of that kind, good by default. Other columns aren't read.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good")).distinct()
    bound = draw_bound(known.count(), most)
    drawn = known if bound is None else known.where(F.xxhash64("_id") <= bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "_id").select("_id", "_good", "text").orderBy("_id", "_good", F.xxhash64("text")).toArrow()
    x, chain, label, length, base = [], [], [], [], 0
    for batch in rows.combine_chunks().to_batches():
        good = batch.column(1).to_numpy()
        for low, high, row, values, size in _lined(batch, 2):
            x.append(values)
            length.append(size)
            chain.append(row + base)
            label.append(good[low:high][row])
            base += high - low
    if not x:
        return fit(np.zeros((0, FEATURES)), *(np.zeros(0, int),) * 3)
    return fit(*map(np.concatenate, (x, chain, label, length)))


def _judge(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = held.value
        for batch in batches:
            for low, high, row, x, size in _lined(batch, 1):
                (good,) = marginals(x @ field.weights, row, field.moves)
                n = high - low
                total = np.bincount(row, size, minlength=n)
                quality = np.bincount(row, size * good, minlength=n) / np.maximum(total, 1e-9)
                lines, fine = np.bincount(row, minlength=n), np.bincount(row, good >= GOOD, minlength=n)
                none = total == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(np.minimum(quality, 1.0), mask=none), pa.array(lines.astype(np.int64)), pa.array(fine.astype(np.int64))], ["doc_id", "quality", "lines", "good_lines"])

    return run


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, quality, lines, good_lines, keep) for every row: the length-weighted mean probability that a line is good.

    A null or empty text, or one of line breaks only, has quality and keep null. Repeated rows are each scored, a null doc_id stays
    null, an empty table gives no row, other columns aren't read. One narrow pass over whole texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge(held), "doc_id long, quality double, lines long, good_lines long").withColumn("keep", F.col("quality") >= KEEP)
