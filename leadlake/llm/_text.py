"""Vectorised text primitives over Arrow string buffers, shared by the corpus operators.

A *word* is a maximal run of ASCII letters and digits and of characters from U+00C0 on, without general punctuation
(U+2000-206F) and CJK punctuation (U+3000-303F). As a regular expression: ``WORD_RE``. Text is folded to lower case first.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = "[0-9A-Za-z\\x{C0}-\\x{1FFF}\\x{2070}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]+"
#: Bytes of text handled at once inside a worker; a longer text is handled alone and whole.
SLICE = 1 << 20

U = np.uint64
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}
_patterns: dict[str, re.Pattern] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers below ``n``. Those of a slice are kept; more, for a span of more than half a slice, only while they are used,
    as a worker lives on and would hold them through all later tasks."""
    if len(_tables.get("up", ())) < n:
        made = {}
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            full = np.full(max(n, SLICE + 1), base, U)
            full[0] = 1
            made[name] = np.multiply.accumulate(full)
        if n > SLICE + 1:
            return made["up"], made["down"]
        _tables.update(made)
    return _tables["up"][:n], _tables["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size`` bytes."""
    data, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _odd() -> re.Pattern:
    """The characters whose lower case has another length in bytes."""
    if "odd" not in _patterns:
        every = pa.array([chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000])
        other = pc.not_equal(pc.binary_length(every), pc.binary_length(pc.utf8_lower(every)))
        _patterns["odd"] = re.compile("([" + "".join(map(re.escape, every.filter(other).to_pylist())) + "]+)")
    return _patterns["odd"]


def lower(column: pa.Array) -> pa.Array:
    """Lower case of the same length in bytes, so that places in it are places in the text. Each character is folded by itself;
    only those whose lower case has another length in bytes stay as they are."""
    column = column.cast(pa.large_string())
    folded = pc.utf8_lower(column)
    same = pc.fill_null(pc.equal(pc.binary_length(column), pc.binary_length(folded)), True)
    if pc.all(same, min_count=0).as_py() and not _may_be_odd(column):
        return folded
    out = folded.to_pylist()
    for k, text in enumerate(column.to_pylist()):
        if text is not None and (parts := _odd().split(text))[1:]:
            parts[::2] = pc.utf8_lower(pa.array(parts[::2], pa.large_string())).to_pylist()
            out[k] = "".join(parts)
    return pa.array(out, pa.large_string())


def _may_be_odd(column: pa.Array) -> bool:
    """Whether lengths that are equal may hide a longer and a shorter lower case that cancel out: only with a character of each kind."""
    data, _ = buffers(column)
    # those that grow (two bytes to three) have the lead byte C8; without one, equal lengths mean that no length changed
    return bool((data == 0xC8).any())


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and row of each word."""
    inside = _ALNUM[data]
    n = len(data)
    if n:
        for lead in (0xC2, 0xE2, 0xE3):
            at = np.flatnonzero(data == lead)
            if lead == 0xC2:
                spans = ((at, 2),)
            else:
                at = at[at + 2 < n]
                second, third = data[at + 1], data[at + 2]
                spans = ((at[(second == 0x80) | ((second == 0x81) & (third < 0xB0) & (lead == 0xE2))], 3),)
            for where, width in spans:
                for k in range(width):
                    inside[np.minimum(where + k, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand. More than a slice is hashed in windows
    of spans that start within half a slice, so memory goes by the slice and the longest span."""
    if len(data) <= SLICE or not len(starts):
        return _window_hashes(data, starts, ends)
    out, order = np.empty(len(starts), U), np.argsort(starts, kind="stable")
    starts, ends, low = starts[order], ends[order], 0
    while low < len(starts):
        base = starts[low]
        high = int(np.searchsorted(starts, base + SLICE // 2))
        out[order[low:high]] = _window_hashes(data[base : ends[low:high].max()], starts[low:high] - base, ends[low:high] - base)
        low = high
    return out


def _window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, after which what it freed goes back to the system: a worker lives on, beside the JVM's
    later stages, and allocators would keep the most that it ever used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
            trim(0)

    return task


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a contiguous matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    width, n = matrix.itemsize * matrix.shape[1], len(matrix)
    if n * width > 1 << 30:
        return pa.concat_arrays([binary_rows(matrix[: n // 2]), binary_rows(matrix[n // 2 :])])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(matrix.tobytes())])


def draw_bound(rows: int, wanted: int) -> int | None:
    """The signed 64-bit bound under which a hash draws ``wanted`` of ``rows`` rows, about; None draws all. Exact at any size."""
    if rows <= wanted:
        return None
    return -(1 << 63) + max(1, (wanted << 64) // rows)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that clash with none of ``taken``, with more underscores in front where needed."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out
