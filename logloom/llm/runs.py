"""Periodic runs of words, found online by catching squares.

A run is a stretch of consecutive words of smallest period q (words q apart are equal), at
least `LEAST` words and `FOLDS` periods long, that no neighbouring word extends.

`SquareCatcher` takes the words of a text as they arrive.  A catcher of level k stands on
every completed block of 2^(k+1) words that begins at a multiple of L = 2^k; it looks for the
block again at distances q with L <= q < 2L.  A later start meets exactly one catcher of a
level, the block that begins L to 2L - 1 words before it, so an appended word costs one comparison of
64-bit window sums a level.  A run of four periods holds such a block and its copy q words
on, at the level of its period: the block begins within its first L words and has 2L of them, and
L - 1 + 2L + q < 4q.  A square that is caught is confirmed word by word: common suffixes are
followed to the left, equal words to the right, now and with every append as long as the
stretch reaches the end.  Squares inside a known run whose period divides theirs are
merged into it; levels go upward, so the smallest period of a run is known first.

Sums of windows may agree by chance; that costs a comparison and never makes a run.

Defined cases: a null or empty text has no words and no runs, its collapsed text is empty; rows
are taken one by one, so repeated rows and ids give repeated rows, and a null id stays
null; an empty table gives no rows; other columns, whatever their names, are not read.
Memory: one text at a time, about 32 bytes a word beside the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST = 6
FOLDS = 4
#: Words that a text appends at a time.
CHUNK = 1 << 16
#: Texts that are answered together, in bytes; bounds what a task holds beside its input.
ANSWER_BYTES = 16 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_UNDO, m, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


class SquareCatcher:
    """Runs of a growing text.  `append` takes more words, `runs` says what is known so far."""

    def __init__(self) -> None:
        self.n = 0
        self._ids: dict[bytes, int] = {}
        self._word = np.empty(0, np.int64)
        self._sum = np.zeros(1, np.uint64)
        self._next: list[int] = []  # of each level, the first start that no catcher has seen
        self._runs: list[list[int]] = []  # start, end, period
        self._open: list[list[int]] = []  # stretches too short as yet that reach the end

    def append(self, words: Sequence[bytes]) -> None:
        if not words:
            return
        ids, before = self._ids, self.n
        for word in dict.fromkeys(words):
            ids.setdefault(word, len(ids))
        new = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        self.n += len(words)
        up, down = _POWERS.upto(self.n + 1)
        more = np.cumsum((new + 1).astype(np.uint64) * up[before : self.n])
        self._word = np.concatenate([self._word, new]) if before else new
        self._sum = np.concatenate([self._sum, more + self._sum[-1]])
        for run in self._runs:
            if run[1] == before:
                run[1] = self._right(before, run[2])
        waiting, self._open = self._open, []
        for start, end, period in sorted(waiting, key=lambda x: x[2]):
            self._settle(start, self._right(end, period), period)
        level = 0
        while 3 << level <= self.n:
            self._catch(level, down)
            level += 1

    def _catch(self, level: int, down: np.ndarray) -> None:
        """Starts that have become complete meet the catchers of one level."""
        step, width = 1 << level, 2 << level
        if level == len(self._next):
            self._next.append(step)
        low, high = self._next[level], self.n - width + 1
        if low >= high:
            return
        self._next[level] = high
        total = self._sum
        seen = (total[low + width : high + width] - total[low:high]) * down[low:high]
        first = (low // step - 1) * step
        blocks = np.arange(first, high - step, step)
        caught = np.repeat((total[blocks + width] - total[blocks]) * down[blocks], step)
        hits = np.flatnonzero(seen == caught[low - first - step : high - first - step]) + low
        if not len(hits):
            return
        for start, end, period in self._runs:
            hits = _outside(hits, step, width, start, end, period, True)
        while len(hits):
            at = int(hits[0])
            block = (at // step - 1) * step
            period = at - block
            end = self._right(at, period)
            if end < at + width:
                hits = hits[1:]  # the sums agreed, the words do not
                continue
            start = self._left(block, period)
            run = self._settle(start, end, period)
            hits = _outside(hits, step, width, start, end, period, run)

    def _settle(self, start: int, end: int, period: int) -> bool:
        """Is the stretch, which nothing extends, a run (now)?"""
        if end - start >= max(LEAST, FOLDS * period):
            if not any(a <= start and end <= b and period % q == 0 for a, b, q in self._runs):
                self._runs.append([start, end, period])
            return True
        if end == self.n:
            self._open.append([start, end, period])
        return False

    def _right(self, at: int, period: int) -> int:
        """The first position from `at` on whose word differs from the one a period before."""
        word, size = self._word, 32
        while at < self.n:
            stop = min(self.n, at + size)
            other = np.flatnonzero(word[at:stop] != word[at - period : stop - period])
            if len(other):
                return at + int(other[0])
            at, size = stop, size * 2
        return at

    def _left(self, at: int, period: int) -> int:
        """The first of the positions before `at` whose words all equal those a period on."""
        word, size = self._word, 32
        while at > 0:
            start = max(0, at - size)
            other = np.flatnonzero(word[start:at] != word[start + period : at + period])
            if len(other):
                return start + int(other[-1]) + 1
            at, size = start, size * 2
        return at

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period), by start and period."""
        return sorted((a, b - a, q) for a, b, q in self._runs)


def _outside(hits: np.ndarray, step: int, width: int, start: int, end: int, period: int, multiples: bool) -> np.ndarray:
    """Hits that are no square of this stretch (of its period, or of a multiple too)."""
    low, high = np.searchsorted(hits, (start + step, end - width + 1))
    if low >= high:
        return hits
    near = hits[low:high]
    block = (near // step - 1) * step
    apart = near - block
    same = (block >= start) & ((apart % period == 0) if multiples else (apart == period))
    return np.concatenate([hits[:low], near[~same], hits[high:]]) if same.any() else hits


def find_runs(words: Sequence[bytes], chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """The runs of one text, whose words are appended `chunk` at a time."""
    catcher = SquareCatcher()
    for at in range(0, len(words), chunk):
        catcher.append(words[at : at + chunk])
    return catcher.runs()


def collapse(words: Sequence[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    kept, at = [], 0
    for low, high in sorted((start + period, start + length) for start, length, period in runs):
        if high > at:
            kept += words[at : max(at, low)]
            at = high
    return b" ".join([*kept, *words[at:]] if at else words)


def detect_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, runs (array of start, length, period), collapsed.

    Words are runs of characters other than space, tab, newline, \\v, \\f and \\r, numbered from 0.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN, False)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    kind = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]), False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                counts, found, collapsed, size, first = [], [], [], 0, at
                while at < len(texts) and size < ANSWER_BYTES:
                    # bytes.split() parts at exactly the six white-space characters of ASCII
                    words = (texts[at].as_py() or "").encode().split()
                    runs = find_runs(words)
                    counts.append(len(words))
                    found.append([dict(zip(RUN.names, run, strict=True)) for run in runs])
                    collapsed.append(collapse(words, runs).decode())
                    size += len(collapsed[-1])
                    at += 1
                columns = [batch.column(0).slice(first, at - first), pa.array(counts, pa.int64())]
                columns += [pa.array(found, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(read, schema)
