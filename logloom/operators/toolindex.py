"""A sparse inverted index of tools, searched exactly for the best tool of each row.

Postings stand by term and block of `BLOCK` tools, and each (term, block) keeps its largest weight.
For a row these give an upper bound of every block; the block with the highest bound is computed first,
and of the others only those whose bound reaches what it gave.  The arrays go to every task,
so their size is measured (`nbytes`) before they are sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64
#: Cells of the (rows x tools) scores that are held at a time.
CELLS = 1 << 22
DOMAIN, SHAPE = 1.5, 1.3


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges start … stop - 1, and the number of the range each comes from."""
    sizes = stops - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are known, their positions)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def round9(values: np.ndarray) -> np.ndarray:
    return np.floor(values * 1e9 + 0.5) / 1e9


@dataclass
class ToolIndex:
    """Tools 0 … n - 1 in the order that settles ties."""

    domain: list[str | None]
    shape: list[str | None]
    terms: np.ndarray  # sorted hashes
    cell_of: np.ndarray  # of each term, its first cell; a cell is a (term, block)
    block: np.ndarray  # of each cell
    most: np.ndarray  # of each cell
    post_of: np.ndarray  # of each cell, its first posting
    tool: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, domain, shape, tool: np.ndarray, term: np.ndarray, weight: np.ndarray) -> ToolIndex:
        order = np.lexsort((tool, term))
        tool, term, weight = tool[order], term[order], weight[order]
        block = tool // BLOCK
        new_term = np.ones(len(term), bool)
        new_term[1:] = term[1:] != term[:-1]
        new_cell = new_term.copy()
        new_cell[1:] |= block[1:] != block[:-1]
        cells = np.flatnonzero(new_cell)
        terms = np.flatnonzero(new_term)
        return cls(
            list(domain),
            list(shape),
            term[terms],
            np.append(np.searchsorted(cells, terms), len(cells)),
            block[cells],
            np.maximum.reduceat(weight, cells) if len(cells) else weight,
            np.append(cells, len(term)),
            tool,
            weight,
        )

    @property
    def nbytes(self) -> int:
        arrays = (self.terms, self.cell_of, self.block, self.most, self.post_of, self.tool, self.weight)
        return sum(a.nbytes for a in arrays) + 64 * len(self.domain)

    def search(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, domain, shape) -> tuple[np.ndarray, np.ndarray]:
        """(tool, score) of each of `n` rows, whose vectors are (row, term, weight) by row; tool 0 and
        score 0 where nothing is shared.  Of equal scores (to 9 digits) the first tool wins."""
        known, at = find(self.terms, term)
        row, at, weight = row[known], at[known], weight[known]
        best, score = np.zeros(n, np.int64), np.zeros(n)
        step = max(1, CELLS // max(1, len(self.domain)))
        codes = [_coded(own, asked) for own, asked in ((self.domain, domain), (self.shape, shape))]
        for low in range(0, n, step):
            high = min(n, low + step)
            own = slice(*np.searchsorted(row, (low, high)))
            best[low:high], score[low:high] = self._best(high - low, row[own] - low, at[own], weight[own], [(c, a[low:high]) for c, a in codes])
        return best, score

    def _best(self, n, row, at, weight, codes) -> tuple[np.ndarray, np.ndarray]:
        cell, owner = spread(self.cell_of[at], self.cell_of[at + 1])
        row, weight = row[owner], weight[owner]
        blocks = -(-len(self.domain) // BLOCK)
        pair = row * blocks + self.block[cell]
        bound = np.bincount(pair, weight * self.most[cell], n * blocks).astype(np.float64).reshape(n, blocks) * (DOMAIN * SHAPE)
        top = bound.argmax(axis=1)
        todo = np.zeros((n, blocks), bool)
        todo[np.arange(n), top] = True
        scores = self._scores(n, row, cell, weight, todo.reshape(-1)[pair], codes)
        least = scores.max(axis=1, initial=0.0)
        # what could still win or tie once it is rounded
        rest = (bound + 1e-9 >= least[:, None]) & (bound > 0) & ~todo
        if rest.any():
            scores = np.maximum(scores, self._scores(n, row, cell, weight, rest.reshape(-1)[pair], codes))
        best = scores.argmax(axis=1)  # the first of equals
        return best, scores[np.arange(n), best]

    def _scores(self, n, row, cell, weight, wanted, codes) -> np.ndarray:
        """Rounded scores (rows x tools) of the wanted cells."""
        row, cell, weight = row[wanted], cell[wanted], weight[wanted]
        post, owner = spread(self.post_of[cell], self.post_of[cell + 1])
        tools = len(self.domain)
        out = np.bincount(row[owner] * tools + self.tool[post], weight[owner] * self.weight[post], n * tools).astype(np.float64).reshape(n, tools)
        for (own, asked), factor in zip(codes, (DOMAIN, SHAPE), strict=True):
            out[own[None, :] == asked[:, None]] *= factor
        return round9(out)


def _coded(own, asked) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal values; nulls equal nothing."""
    code = {v: i for i, v in enumerate(dict.fromkeys(v for v in own if v is not None))}
    return np.array([code.get(v, -1) for v in own], np.int64), np.array([code.get(v, -2) for v in asked], np.int64)
