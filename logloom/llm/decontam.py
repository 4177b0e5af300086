"""Benchmark decontamination by CGK embedding and bit sampling.

A random walk reads a string and either stays or moves on at each step, by random bits that
depend on step and symbol.  Strings a few edits apart fall in step again and again, so their
outputs differ in few places: edit distance has become Hamming distance.  Bit sampling
compares a few random places of the outputs; repeated with other walks and places it finds
a close pair with high probability.  What it finds is verified by exact edit distance, unless too few of
the item's runs of `Q` characters are there at all: an edit breaks no more than `Q` of them.

Windows have the size of the item they are held against.  They are laid wherever a document
and the item have a run of `gram` characters in common, at any offset of both, spaces or not; both walks
(to the right and to the left) start in step there.  A run has a window at its beginning and at every
`STRIDE`-th offset of the item.  Items for which random edits at the limit would break all
runs of `gram` characters with a probability above 1 - `SEED_RECALL` have shorter ones, down to what
any edits within the limit leave whole.

The benchmark is the stated query set: it is taken in blocks of `block_items` items, and each
block goes once over all documents in whole, without a shuffle.

Defined cases: texts are compared in lower case with white space runs as one space; a null or
empty text has no leak and an empty item leaks nowhere; items of
any length are looked for within the edit rate; repeated items count once, repeated documents each get their rows; a null id is passed on as null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAM = 12
MAX_EDIT_RATE = 0.15
SEED_RECALL = 0.99
STRIDE = 6
WALKS = 4
SAMPLES = 12
PLACES = 3
BLOCK_ITEMS = 2048
SEED = 20240501
CHUNK = 1024
#: Seeds of longer items are as those of items of this length.
LONG = 1000
#: The random bits of a walk repeat after so many steps, far beyond what edits can shift.
PERIOD = 4096
#: Outputs of walks that are held at a time.
WALK_BYTES = 32 << 20
#: Length of the runs that are counted before an edit distance is computed.
Q = 4
#: Characters of documents that are searched at a time, one document at least.
SLICE_CHARS = 2 << 20

PADDING = np.zeros(1, np.uint8)

LEAK = "doc_id long, item_id long, edits int, item_chars int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def seed_length(size: int, limit: int, gram: int) -> int:
    """The longest run, up to `gram`, that `limit` random edits of `size` characters leave whole often enough."""
    if size > LONG:  # with the share of edits a run is the likelier whole, the longer the item
        size, limit = LONG, LONG * limit // size
    for g in range(min(gram, size), 1, -1):
        # inclusion and exclusion over the gaps between the edits, in whole numbers
        whole = sum((-1) ** (i + 1) * comb(limit + 1, i) * comb(size - i * g, limit) for i in range(1, (size - limit) // g + 1))
        if whole * 1000 >= int(SEED_RECALL * 1000) * comb(size, limit):
            return g
    return 1


def _symbols(text: str) -> np.ndarray:
    """Code points as symbols 1..255; 0 is the padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points ^ (points >> 7)) % 255 + 1).astype(np.uint8)


def walk(codes: np.ndarray, at: np.ndarray, length: np.ndarray, way: int, bits: np.ndarray, steps: int) -> np.ndarray:
    """CGK outputs (steps x strings) of the strings that begin at `at` and go `way` (1 or -1).

    `codes` ends with a padding, which is where a string that ends with the text stops; no bit moves on from it.
    """
    out = np.zeros((steps, len(at)), np.uint8)
    here, stop = at.astype(np.int64), at + way * length
    for j in range(steps):
        symbol = out[j]
        np.multiply(codes[here], here != stop, out=symbol)
        here += way * bits[j % len(bits)][symbol]
    return out


def edits_within(item: str, region: str) -> int:
    """Least edit distance between `item` and any substring of `region` (bit-parallel)."""
    if item in region:
        return 0
    m = len(item)
    last, full = 1 << (m - 1), (1 << m) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for c in region:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        h_up = down | ~(d0 | up) & full
        h_down = up & d0
        if h_up & last:
            score += 1
        elif h_down & last:
            score -= 1
            best = min(best, score)
        h_up = (h_up << 1) & full
        h_down = (h_down << 1) & full
        up = h_down | ~(d0 | h_up) & full
        down = h_up & d0
    return best


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about `SLICE_CHARS` characters of `column`."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(column)), 0), np.int64)
    piece = (np.cumsum(sizes) - sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


class Items:
    """A block of the benchmark: seeds, and the sampled outputs of every window of its items."""

    def __init__(self, items: list[tuple[int, str]], gram: int, max_rate: float, walks: int, samples: int, places: int):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        seeds: dict[str, list[int]] = {}
        owners, offsets = [], []
        for k, text in enumerate(self.texts):
            length = seed_length(len(text), int(max_rate * len(text)), gram)
            for at in range(len(text) - length + 1):
                seeds.setdefault(text[at : at + length], []).append(len(owners))
                owners.append(k)
                offsets.append(at)
        self.owner, self.offset = np.array(owners, np.int64), np.array(offsets, np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.runs: dict[int, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for seed, entries in seeds.items():
            self.automaton.add_word(seed, (len(seed), np.array(entries, np.int64)))
        self.automaton.make_automaton()
        rng = np.random.default_rng(SEED)
        self.steps = 2 * int(self.size.max())
        self.bits = rng.integers(0, 2, (walks, min(self.steps, PERIOD), 256), np.uint8).astype(np.int8)
        self.bits[:, :, 0] = 0
        self.places = rng.random((walks, samples, places))
        self.codes = np.concatenate([*[_symbols(t) for t in self.texts], PADDING])
        self.at = (np.cumsum(self.size) - self.size)[self.owner] + self.offset
        self.sampled = np.zeros((walks, len(owners), samples, places), np.uint8)
        self.ready = np.zeros((walks, len(owners)), bool)

    def _own(self, entry: np.ndarray, w: int) -> np.ndarray:
        """The sampled outputs of the items themselves, computed when first met."""
        todo = np.unique(entry[~self.ready[w][entry]])
        if len(todo):
            right = self.size[self.owner[todo]] - self.offset[todo]
            self.sampled[w][todo] = self._sample(self.codes, self.at[todo], todo, self.offset[todo], right, w)
            self.ready[w][todo] = True
        return self.sampled[w][entry]

    def _sample(self, codes, at, entry, left, right, w: int) -> np.ndarray:
        """(strings x samples x places): the outputs at the sampled places of each window.
        `left`, `right`: what the text has on either side of the anchor."""
        out = np.zeros((len(at), *self.places.shape[1:]), np.uint8)
        step = max(1, min(CHUNK, WALK_BYTES // max(1, self.steps)))
        size, offset = self.size[self.owner[entry]], self.offset[entry]
        for way, length, reach in ((1, right, size - offset), (-1, left, offset)):
            # windows that reach about as far go together, so that none walks much longer than it has to
            order = np.argsort(reach, kind="stable")
            for a in range(0, len(order), step):
                part = order[a : a + step]
                place = (self.places[w][None] * (2 * size[part])[:, None, None]).astype(np.int64) - (2 * offset[part])[:, None, None]
                row, sample, k = np.nonzero(place >= 0 if way > 0 else place < 0)
                if not len(row):
                    continue
                place = place[row, sample, k] if way > 0 else -1 - place[row, sample, k]
                walked = walk(codes, at[part] - (way < 0), length[part], way, self.bits[w], int(place.max()) + 1)
                out[part[row], sample, k] = walked[place, row]
        return out

    def near(self, codes, at, entry, left, right) -> np.ndarray:
        """Which windows agree with their item in all places of a sample."""
        found = np.zeros(len(at), bool)
        for w in range(len(self.bits)):
            todo = np.flatnonzero(~found)
            if not len(todo):
                break
            seen = self._sample(codes, at[todo], entry[todo], left[todo], right[todo], w)
            found[todo] = (seen == self._own(entry[todo], w)).all(axis=2).any(axis=1)
        return found

    def possible(self, k: int, region: str, limit: int) -> bool:
        """Are enough runs of item `k` in the region for `limit` edits?"""
        text = self.texts[k]
        least = len(text) - Q + 1 - Q * limit
        if least <= 0:
            return True
        if k not in self.runs:
            self.runs[k] = [text[i : i + Q] for i in range(len(text) - Q + 1)]
        there = {region[i : i + Q] for i in range(len(region) - Q + 1)}
        return sum(map(there.__contains__, self.runs[k])) >= least

    def _thinned(self, owner: np.ndarray, places: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hits in a row, the first one and those at every `STRIDE`-th offset of the item."""
        item, offset = self.owner[entry], self.offset[entry]
        order = np.lexsort((places, places - offset, item, owner))
        owner, places, entry, item, offset = (x[order] for x in (owner, places, entry, item, offset))
        follows = np.zeros(len(owner), bool)
        follows[1:] = (owner[1:] == owner[:-1]) & (item[1:] == item[:-1]) & (places[1:] == places[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
        keep = ~follows | (offset % STRIDE == 0)
        return owner[keep], places[keep], entry[keep]

    def _exact(self, owner: np.ndarray, places: np.ndarray, entry: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) where all runs of the item stand one after the other: an exact copy."""
        item, start = self.owner[entry], places - self.offset[entry]
        order = np.lexsort((start, item, owner))
        owner, item, start = owner[order], item[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        first = np.flatnonzero(new)
        whole = np.diff(np.append(first, len(order))) == np.bincount(self.owner, minlength=len(self.texts))[item[first]]
        return list(dict.fromkeys(zip(owner[first[whole]].tolist(), item[first[whole]].tolist(), strict=True)))

    def leaks(self, texts: list[str], max_rate: float) -> list[tuple[int, int, int]]:
        """(text number, item number, edits) of all leaks, the best of each pair."""
        owner, places, entries = [], [], []
        kept, starts, total = {}, [], 0
        for n, text in enumerate(texts):
            for end, (length, found) in self.automaton.iter(text):
                if n not in kept:
                    kept[n] = total
                    total += len(text)
                owner += [n] * len(found)
                places += [end - length + 1] * len(found)
                entries.append(found)
        if not entries:
            return []
        codes = np.concatenate([*[_symbols(texts[n]) for n in kept], PADDING])
        owner, places, entry = np.array(owner), np.array(places), np.concatenate(entries)
        exact = self._exact(owner, places, entry)
        best: dict[tuple[int, int], int] = dict.fromkeys(exact, 0)
        if exact:
            rest = ~np.isin(owner * len(self.texts) + self.owner[entry], [n * len(self.texts) + k for n, k in exact])
            owner, places, entry = owner[rest], places[rest], entry[rest]
        owner, places, entry = self._thinned(owner, places, entry)
        size, offset = self.size[self.owner[entry]], self.offset[entry]
        lengths = np.array([len(t) for t in texts])[owner]
        left = np.minimum(offset, places)
        right = np.minimum(size - offset, lengths - places)
        at = places + np.array([kept.get(n, 0) for n in range(len(texts))])[owner]
        close = self.near(codes, at, entry, left, right)
        covered: dict[tuple[int, int], int] = {}
        order = np.flatnonzero(close)
        order = order[np.lexsort((places[order] - offset[order], self.owner[entry[order]], owner[order]))]
        for i in order.tolist():
            pair = (int(owner[i]), int(self.owner[entry[i]]))
            first = int(places[i] - offset[i])
            limit = int(max_rate * int(size[i]))
            if best.get(pair, limit + 1) == 0 or (pair in covered and first <= covered[pair]):
                continue
            # one region answers for all windows that begin up to `covered`
            reach = first + 2 * limit
            region = texts[pair[0]][max(0, first - 2 * limit) : reach + int(size[i]) + 2 * limit]
            covered[pair] = reach
            if not self.possible(pair[1], region, limit):
                continue
            edits = edits_within(self.texts[pair[1]], region)
            if edits <= limit and edits < best.get(pair, limit + 1):
                best[pair] = edits
        return [(n, k, e) for (n, k), e in sorted(best.items())]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()
    block: list[tuple[int, str]] = []
    for row in rows:
        text = normal(row["text"])
        if text:
            block.append((row["item_id"], text))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _found(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    gram: int = GRAM,
    max_edit_rate: float = MAX_EDIT_RATE,
    walks: int = WALKS,
    samples: int = SAMPLES,
    places: int = PLACES,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """What `find_leaks` returns, with the hash of the text it was found in."""

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, gram, max_edit_rate, walks, samples, places)
            for piece in chain.from_iterable(slices(batch, "text") for batch in batches):
                ids, hashes = piece.column("doc_id").to_pylist(), piece.column("h").to_pylist()
                found = items.leaks([normal(t) for t in piece.column("text").to_pylist()], max_edit_rate)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if ids[n] is None else int(ids[n]) for n, _, _ in found], pa.int64()),
                            pa.array([items.ids[k] for _, k, _ in found], pa.int64()),
                            pa.array([e for _, _, e in found], pa.int32()),
                            pa.array([int(items.size[k]) for _, k, _ in found], pa.int32()),
                            pa.array([hashes[n] for n, _, _ in found], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "edits", "item_chars", "h"],
                    )

        return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"{LEAK}, h long")

    out = docs.sparkSession.createDataFrame([], f"{LEAK}, h long")
    for block in _blocks(benchmark, block_items):
        out = out.unionByName(scan(block))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row per document and item within the edit rate."""
    return _found(docs, benchmark, **options).drop("h")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item leaks; all columns and repeated rows stay.

    A row is named by its id, which may be null, and the hash of its text.
    """
    found = _found(docs, benchmark, **options)
    bad = stored(found.select(F.col("doc_id").alias("__bad_id"), F.col("h").alias("__bad_h")).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_h")), "left_anti")
