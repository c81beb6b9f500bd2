"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q, at least 4 q (and
``LEAST``) words long.  At each dyadic scale t the windows of t words get
exact names, from pairs of names of the scale below.  A position is
synchronising if, among the t + 1 windows from it on, the smallest hash of a
name is the first or the last: that depends on the 2 t words from it on
alone, so equal contexts are selected alike.  Windows inside a run with
period up to t / 4 are left out.

A run with period q, t <= q < 2 t, holds a synchronising position among its
first t words, and the same context comes next exactly q words later.  So
the distances between neighbouring equal contexts propose the periods, and
each proposal is extended word by word to its maximal stretch.  The periods
below the first scale, the highly periodic regions, are found by comparing
the words directly.  A scale without any repeated context ends the search:
longer contexts cannot repeat either.

Every document is read whole, by the task that holds its row.

Defined results: a null text has no words; a null doc_id plants nothing;
documents equal in all columns each get their row; other columns, whatever
their names, are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_of

LEAST = 6                           # words of a run
TIMES = 4                           # periods of a run
FIRST_SCALE = 4                     # shorter periods are found directly

KIND = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string")


def _spread(names: np.ndarray) -> np.ndarray:
    """A different, seemingly random number for every name."""
    x = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _pairs(names: np.ndarray, width: int) -> np.ndarray:
    """The names of the windows of twice ``width`` words, from those of ``width`` words."""
    if len(names) <= width:
        return names[:0]
    return np.unique(names[:-width] * np.int64(len(names) + 1) + names[width:], return_inverse=True)[1].astype(np.int64)


def synchronising(names: np.ndarray, width: int, left_out: np.ndarray) -> np.ndarray:
    """The synchronising positions for windows of ``width`` words; ``left_out`` marks the highly periodic ones."""
    hashes = _spread(names)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    hashes[left_out] = none
    least, step = hashes, 1
    while step < width:                                      # the least of 2, 4, .. width windows
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if len(hashes) <= width:
        return np.empty(0, dtype=np.int64)
    first, last = hashes[:-width], hashes[width:]
    least = np.minimum(least[: len(last)], last)
    return np.flatnonzero((least != none) & ((first == least) | (last == least)))


def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal (start, end) around ``at`` in which words ``period`` apart are equal."""
    stop, step = at, 64
    while stop + period < len(words):                        # words[stop] against words[stop + period]
        a, b = words[stop:stop + step], words[stop + period:stop + period + step]
        same = a[: len(b)] == b
        if not same.all():
            stop += int(same.argmin())
            break
        stop, step = stop + len(b), step * 2
    start, step = at, 64
    while start:
        low = max(0, start - step)
        same = words[low:start] == words[low + period:start + period]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, step = low, step * 2
    return start, stop + period


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Is ``period`` the smallest of the stretch?  In four periods or more a smaller one divides it."""
    left, prime = period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime == 0:
            shorter = period // prime
            if np.array_equal(words[start:end - shorter], words[start + shorter:end]):
                return False
            while left % prime == 0:
                left //= prime
        prime += 1
    return True


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch of at least four smallest periods, by start, then period."""
    found: dict[tuple[int, int], int] = {}                   # (start, period): end

    def take(start: int, end: int, period: int) -> None:
        if end - start >= TIMES * period and (start, period) not in found and _smallest(words, start, end, period):
            found[start, period] = end

    for period in range(1, FIRST_SCALE):
        same = np.concatenate(([False], words[period:] == words[:-period], [False])) if len(words) > period else np.zeros(2, bool)
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            take(start, stop + period, period)

    names, width = words.astype(np.int64), 1
    while width < FIRST_SCALE:
        names, width = _pairs(names, width), width * 2
    while len(names) > width * 2:
        contexts = _pairs(names, width)
        order = np.argsort(contexts, kind="stable")
        equal = contexts[order[1:]] == contexts[order[:-1]]
        if not equal.any():
            break                                            # no context of 2 * width words comes twice
        left_out = np.zeros(len(names), dtype=bool)
        for (start, period), end in found.items():
            if TIMES * period <= width:
                left_out[start:max(start, end - width + 1)] = True
        chosen = np.zeros(len(contexts), dtype=bool)
        at = synchronising(names, width, left_out)
        chosen[at[at < len(contexts)]] = True
        order = order[chosen[order]]                         # synchronising positions by context, then place
        apart = order[1:] - order[:-1]
        proposed = (contexts[order[1:]] == contexts[order[:-1]]) & (apart >= width) & (apart < width * 2)
        reached: dict[int, int] = {}                         # how far the last stretch of a period went
        for i, period in sorted(zip(order[:-1][proposed].tolist(), apart[proposed].tolist())):
            if i + period >= reached.get(period, 0):
                start, end = _stretch(words, i, period)
                reached[period] = end
                take(start, end, period)
        names, width = contexts, width * 2
    return sorted((start, end - start, period) for (start, period), end in found.items())


def planted(number_of_words: int, doc_id: int | None) -> np.ndarray | None:
    """Which of its own words stands at each place of a document that gets a planted period; None if it gets none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = number_of_words, h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def _row(doc_id: int | None, text: str, plant: bool) -> tuple:
    tokens = text.encode("utf-8", "surrogatepass").split()   # bytes: ASCII white space only
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for w in tokens), dtype=np.int64, count=len(tokens))
    places = planted(len(tokens), doc_id) if plant else None
    if places is not None:
        words = words[places]
        tokens = [tokens[i] for i in places.tolist()]
    kept = [r for r in runs(words) if r[1] >= LEAST]
    if kept:
        stays = np.ones(len(words), dtype=bool)
        for start, length, period in kept:
            stays[start + period:start + length] = False
        tokens = [tokens[i] for i in np.flatnonzero(stays).tolist()]
    best = max(kept, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{a},{b},{q}\n" for a, b, q in kept)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(kept), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(tokens)).hexdigest(),
            [{"start": a, "length": b, "period": q} for a, b, q in kept], b" ".join(tokens).decode("utf-8", "replace"))


def detect(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """One row for each document: the columns of ``KIND``, ``runs`` (all of them) and ``collapsed`` (the text without the repeats).

    ``plant`` first gives every tenth document (by crc32 of doc_id) a period;
    without ``texts`` the columns runs and collapsed are left out.
    """
    kind = KIND + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [
        pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    width = len(names) if texts else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):         # so that only a few texts are held beside the batch
                part = batch.slice(at, 256)
                out = [_row(d.as_py(), t.as_py() or "", plant)[:width] for d, t in zip(part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names[:width])

    return rows.mapInArrow(run, kind)
