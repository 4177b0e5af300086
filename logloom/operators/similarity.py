"""Nearest vectors and nearest labels, exact, without comparing all with all."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held, measured_bytes

PIVOTS = 64
ITEM_ROWS = 4096  # vectors of one item block
QUERY_ROWS = 16384  # vectors of one query chunk
LANE_ROWS = 1 << 17  # items that one task goes through, about
PENDING_ROWS = 1 << 20  # pairs found that wait to be ranked
PRODUCT_CELLS = 1 << 22  # cells of the matrix product that a task holds at a time


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    m = np.array(vectors.tolist() if isinstance(vectors, pd.Series) else vectors, dtype=np.float64)
    if not len(m):
        return m.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _best_cells(cosine: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the k best cells (True), the first of equals."""
    place = cosine.shape[1] - k
    worst = np.partition(cosine, place, axis=1)[:, place][:, None]
    above, equal = cosine > worst, cosine == worst
    left = k - np.count_nonzero(above, axis=1)[:, None]
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= left))


def _best(asked: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, cosines to 9 digits) of the k best items of each row, best first, the first of equals.
    Rows are compared in slices, so memory does not follow their number."""
    k, step = min(k, len(items)), max(1, PRODUCT_CELLS // max(1, len(items)))
    best, score = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
    for low in range(0, len(asked), step) if k else ():
        cosine = np.round(asked[low : low + step] @ items.T, 9)
        own = np.nonzero(_best_cells(cosine, k))[1].reshape(-1, k)
        found = np.take_along_axis(cosine, own, axis=1)
        order = np.argsort(-found, axis=1, kind="stable")
        best.append(np.take_along_axis(own, order, axis=1))
        score.append(np.take_along_axis(found, order, axis=1))
    return np.concatenate(best), np.concatenate(score)


def _rows_of(vectors: pa.Array) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix."""
    rows, size = len(vectors), len(vectors[0]) if len(vectors) else 0
    if (np.diff(vectors.offsets.to_numpy()) != size).any():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, size)


class _Nearest:
    """The k best items of each query of a chunk, for items that come in order of their id.

    `least`: cosines below which no item is among the k best.  Once k items are found, the worst of
    them takes its place, and as equals come later, an item must then be better.
    """

    def __init__(self, asked: np.ndarray, least: np.ndarray, k: int):
        self.asked, self.k, self.n = asked, k, 0
        self.bar = least - 1e-9  # by more than a product may differ from itself in another slice
        self.row, self.at, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, items: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The next items; in `groups`, rows of queries and places of the items that they are held against."""
        pending, waiting = [(self.row, self.at, self.cosine)], 0
        for asked, own in groups:
            near = items[own]
            step = max(1, PRODUCT_CELLS // max(1, len(own)))
            for low in range(0, len(asked), step):
                rows = asked[low : low + step]
                cosine = self.asked[rows] @ near.T
                found = cosine >= self.bar[rows][:, None]
                many = np.count_nonzero(found, axis=1) > 4 * self.k
                if many.any():
                    found[many] = _best_cells(np.round(cosine[many], 9), self.k)
                row, col = np.nonzero(found)
                pending.append((rows[row], self.n + own[col], np.round(cosine[row, col], 9)))
                waiting += len(row)
                if waiting > PENDING_ROWS:
                    pending, waiting = [self._ranked(pending)], 0
        self.row, self.at, self.cosine = self._ranked(pending)
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.bar)) == self.k)
        last = np.searchsorted(self.row, full, side="right") - 1
        self.bar[full] = np.maximum(self.bar[full], self.cosine[last] + 4e-10)  # what rounds to the worst or below is not better
        self.n += len(items)

    def _ranked(self, pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best pairs of each row, by row, best first, the first of equals."""
        row, at, cosine = (np.concatenate(x) for x in zip(*pending))
        order = np.lexsort((at, -cosine, row))
        row, at, cosine = row[order], at[order], cosine[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[kept], at[kept], cosine[kept]


def _in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distance(_unit(pdf["embedding"]), pivots)
            cell = d.argmin(axis=1)
            yield pdf.assign(_cell=cell, _dist=d[np.arange(len(d)), cell])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(place, f"{fields}, _cell int, _dist double")


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 10,
    pivots: int = PIVOTS,
    item_rows: int = ITEM_ROWS,
    query_rows: int = QUERY_ROWS,
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """(query_id, item_id, cosine, rank): the k nearest items, ties by item_id.

    Items belong to the nearest of a few pivots; a cell above `item_rows` is
    split in blocks.  One block near the query gives a bound on its k-th
    distance; by the triangle inequality only cells whose ball comes closer than
    the bound can hold a better item.  Blocks are dealt to lanes of about `lane_rows` items,
    and a query goes to the lanes of those cells.  A task holds one chunk of queries, and the items of one lane
    pass by as a stream: only the k best of a query leave it, whatever the number of blocks.
    Neither a popular cell nor a popular block is one task.

    queries: query_id, embedding; items: item_id, embedding.  Rows without a vector take no
    part; without items there are no rows.
    """
    queries = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    items = items.select("item_id", "embedding").where("embedding IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *items.schema.fields)}
    if queries.schema["embedding"].dataType != items.schema["embedding"].dataType:
        kinds["embedding"] = "array<double>"
        queries, items = (x.withColumn("embedding", F.col("embedding").cast("array<double>")) for x in (queries, items))
    # The pivots and one line per cell are all that the driver sees.
    sample = items.orderBy(F.xxhash64("item_id"), "item_id").limit(pivots).toPandas()
    if not len(sample):
        none = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, cosine double, rank long"
        return queries.sparkSession.createDataFrame([], none)
    centre = _unit(sample["embedding"])
    placed, home = _in_cells(items, centre), _in_cells(queries, centre)
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_dist").alias("r")).toPandas()
    asked = home.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    radius = np.full(len(centre), -np.inf)
    radius[cells["_cell"]] = cells["r"]
    blocks = np.ones(len(centre), dtype=int)
    blocks[cells["_cell"]] = [math.ceil(n / item_rows) for n in cells["n"]]
    parts = np.ones(len(centre), dtype=int)
    parts[asked["_cell"]] = [math.ceil(n / query_rows) for n in asked["n"]]
    chunks = max(1, math.ceil(asked["n"].sum() / query_rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_blocks = int(blocks.sum())
    lanes = min(n_blocks, max(math.ceil(cells["n"].sum() / lane_rows), math.ceil(2 * cores / chunks)))
    lane = np.arange(n_blocks) * lanes // n_blocks
    lane_of = np.split(lane, np.cumsum(blocks)[:-1])  # of the blocks of each cell
    in_lane = np.array([np.isin(np.arange(lanes), x) for x in lane_of])

    def of_cell(values: list) -> Column:
        return F.element_at(F.lit(values), F.col("_cell") + 1)

    def dealt(n: Column, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), n.cast("long")).cast("int")

    def bound(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        worst = np.full(len(q), -np.inf)
        if len(q) and len(i) >= k:
            worst = _best(_unit(q["embedding"]), _unit(i["item_vec"]), k)[1][:, -1]
        return q[["query_id", "embedding"]].assign(_least=worst)

    def reach(least: np.ndarray) -> np.ndarray:
        """The distance that belongs to a cosine."""
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(least, -1.0))) + 1e-6

    def close(unit: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Can a cell hold items that are near enough?  (vector, cell)"""
        return _distance(unit, centre) - radius <= reach(least)[:, None]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = close(_unit(pdf["embedding"]), pdf["_least"].to_numpy())
            yield pdf.assign(_lanes=[np.flatnonzero(row) for row in near.astype(int) @ in_lane.astype(int) > 0])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            found = pa.chunked_array(ids).take(pa.array(nearest.at))
            names = pa.chunked_array(names_asked).take(pa.array(nearest.row))
            return pa.table({"query_id": names, "item_id": found, "cosine": nearest.cosine}).combine_chunks().to_batches()

        task, nearest, near, ids, names_asked, vectors, least = None, None, None, [], [], [], []
        for batch in batches:
            number = batch.column("_task").to_numpy() * 2 + batch.column("_item").to_numpy()
            cuts = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
            for low, high in zip(cuts, cuts[1:]):
                rows = batch.slice(low, high - low)
                if number[low] // 2 != task:
                    if nearest is not None:
                        yield from result()
                    task, nearest, ids, names_asked, vectors, least = number[low] // 2, None, [], [], [], []
                if number[low] % 2 == 0:  # the queries of a task come before its items
                    names_asked.append(rows.column("query_id"))
                    vectors.append(_rows_of(rows.column("embedding")))
                    least.append(rows.column("_least").to_numpy())
                    continue
                if not vectors:
                    continue
                if nearest is None:
                    nearest = _Nearest(_unit(np.concatenate(vectors)), np.concatenate(least), k)
                    near = close(nearest.asked, np.concatenate(least))
                cell = rows.column("_cell").to_numpy()
                ids.append(rows.column("item_id"))
                own = [(np.flatnonzero(near[:, c]), np.flatnonzero(cell == c)) for c in np.unique(cell)]
                nearest.add(_unit(_rows_of(rows.column("embedding"))), own)
        if nearest is not None:
            yield from result()

    vec = f"query_id {kinds['query_id']}, embedding {kinds['embedding']}"
    salted = placed.select("item_id", F.col("embedding").alias("item_vec"), "_cell", dealt(of_cell([int(x) for x in blocks]), "item_id").alias("_salt"))
    first = salted.where("_salt = 0").withColumn("_part", F.explode(F.sequence(F.lit(0), of_cell([int(x) - 1 for x in parts]))))
    bounded = (
        home.withColumn("_part", dealt(of_cell([int(x) for x in parts]), "query_id", "embedding"))
        .groupBy("_cell", "_part")
        .cogroup(first.groupBy("_cell", "_part"))
        .applyInPandas(bound, f"{vec}, _least double")
    )
    routed = bounded.mapInPandas(route, f"{vec}, _least double, _lanes array<int>")
    chunk = dealt(F.lit(chunks), "query_id", "embedding").alias("_chunk")
    waiting = routed.select("query_id", "embedding", "_least", chunk, F.explode("_lanes").alias("_lane"))
    passing = salted.select(
        "item_id",
        F.col("item_vec").alias("embedding"),
        "_cell",
        F.get(of_cell([[int(y) for y in x] for x in lane_of]), F.col("_salt")).alias("_lane"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"),
    )
    both = waiting.withColumn("_item", F.lit(0)).unionByName(passing.withColumn("_item", F.lit(1)), allowMissingColumns=True)
    found = (
        both.withColumn("_task", (F.col("_chunk") * lanes + F.col("_lane")).cast("long"))
        .drop("_chunk", "_lane")
        .repartitionById(chunks * lanes, F.col("_task").cast("int"))
        .sortWithinPartitions("_task", "_item", "item_id")
        .mapInArrow(search, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, cosine double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), "rank")
    )


# --- labels -----------------------------------------------------------------


LABEL_INDEX_BYTES = 256 << 20  # what a task is sent at most
LABEL_COPIES = 16  # bytes of the index for each byte of the labels, about
RARE_LABELS = 64  # a gram of more labels than this is hot


def _label_grams(label: str) -> set[str]:
    """Words of a snake_case label and its pairs of neighbours."""
    words = label.split("_")
    return {*words, *("_".join(pair) for pair in zip(words, words[1:]))}


@dataclass
class LabelIndex:
    """Known labels, in order, for the search of the nearest one by Jaccard.

    Grams of at most `rare` labels have postings.  The others are hot: labels with the same set of hot
    grams form a group, and of a group only the label of fewest grams (least on a tie) can win by
    hot grams alone, for the score then depends on nothing else.
    """

    names: np.ndarray
    sizes: np.ndarray
    grams: dict[str, int]  # rare grams have numbers from 0 on, hot ones from `n_rare` on
    n_rare: int
    post_of: np.ndarray
    post: np.ndarray
    group: np.ndarray  # of each label
    group_of: np.ndarray  # of each hot gram, its first entry in `groups`
    groups: np.ndarray
    first: np.ndarray  # of each group

    @classmethod
    def build(cls, names: list[str], rare: int) -> LabelIndex:
        names = sorted(names)
        each = [_label_grams(n) for n in names]
        often = Counter(g for own in each for g in own)
        known = sorted(often, key=lambda g: (often[g] > rare, often[g], g))
        grams = {g: i for i, g in enumerate(known)}
        n_rare = sum(often[g] <= rare for g in known)
        pairs = np.array([(grams[g], j) for j, own in enumerate(each) for g in own if grams[g] < n_rare], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        kinds: dict[tuple[int, ...], int] = {}
        group = [kinds.setdefault(tuple(sorted(grams[g] for g in own if grams[g] >= n_rare)), len(kinds)) for own in each]
        sizes = np.array([len(own) for own in each], np.int64)
        group = np.array(group, np.int64)
        order = np.lexsort((np.arange(len(names)), sizes, group))
        heads = order[np.searchsorted(group[order], np.arange(len(kinds)))]
        hot = np.array([(g - n_rare, k) for kind, k in kinds.items() for g in kind], np.int64).reshape(-1, 2)
        hot = hot[np.lexsort((hot[:, 1], hot[:, 0]))]
        return cls(
            np.array(names, object),
            sizes,
            grams,
            n_rare,
            np.searchsorted(pairs[:, 0], np.arange(n_rare + 1)),
            pairs[:, 1],
            group,
            np.searchsorted(hot[:, 0], np.arange(len(known) - n_rare + 1)),
            hot[:, 1],
            heads,
        )

    def nearest(self, label: str) -> tuple[str, float]:
        """The known label of highest Jaccard, the least on a tie."""
        own = _label_grams(label)
        m, numbers = len(own), sorted(self.grams[g] for g in own if g in self.grams)
        rare = [g for g in numbers if g < self.n_rare]
        hot = np.zeros(len(self.first), np.int64)  # hot grams shared with each group
        for g in numbers[len(rare) :]:
            hot[self.groups[self.group_of[g - self.n_rare] : self.group_of[g - self.n_rare + 1]]] += 1
        at, score = 0, 0.0

        def offer(labels: np.ndarray, shared: np.ndarray) -> None:
            nonlocal at, score
            if len(labels):
                jaccard = shared / (m + self.sizes[labels] - shared)
                top = jaccard.max()
                if top > 0 and top >= score:
                    least = int(labels[jaccard == top].min())
                    at, score = (min(at, least) if top == score else least), float(top)

        offer(self.first, hot)
        # rarest grams first; a label of Jaccard `score` or more shares one of the first m - score * m + 1 of any order
        done = 0
        while done < len(rare) and done <= m - math.ceil(score * m - 1e-9):
            more = max(1, min(len(rare), m - math.ceil(score * m - 1e-9) + 1) - done) if done else 1
            met = np.concatenate([self.post[self.post_of[g] : self.post_of[g + 1]] for g in rare[done : done + more]])
            met = np.unique(met)
            met = met[(self.sizes[met] >= score * m - 1e-9) & (self.sizes[met] * score <= m + 1e-9)]
            done += more
            offer(met, self._shared(met, rare) + hot[self.group[met]])
        return self.names[at], score

    def _shared(self, labels: np.ndarray, rare: list[int]) -> np.ndarray:
        """Rare grams that each of the labels has in common with these."""
        out = np.zeros(len(labels), np.int64)
        for g in rare:
            own = self.post[self.post_of[g] : self.post_of[g + 1]]
            place = np.minimum(np.searchsorted(own, labels), len(own) - 1)
            out += own[place] == labels
        return out


def nearest_label(
    labels: DataFrame,
    existing: DataFrame,
    fallback: str = "none",
    index_bytes: int = LABEL_INDEX_BYTES,
    rare: int = RARE_LABELS,
) -> DataFrame:
    """(label, nearest, score): highest Jaccard over words and word pairs, least
    label on a tie (also when nothing is shared), `fallback` when none exists.
    Nulls are no labels on either side.

    The known labels go to every task as an index, in parts of about `index_bytes` (measured);
    each part is asked once for every label.  No pair of labels leaves a task, and a gram that most
    labels share is not walked through: see `LabelIndex`.
    """
    asked = labels.select("label").where(F.col("label").isNotNull()).distinct()
    known = held(existing.select(F.col("label").alias("nearest")).where(F.col("nearest").isNotNull()).distinct())
    parts = math.ceil(measured_bytes(known) * LABEL_COPIES / index_bytes)

    def search(index: LabelIndex) -> DataFrame:
        sent = labels.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [sent.value.nearest(x) for x in batch["label"]]
                yield pd.DataFrame({"label": batch["label"], "nearest": [n for n, _ in found], "score": [s for _, s in found]})

        return asked.mapInPandas(run, "label string, nearest string, score double")

    found = []
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("nearest"), F.lit(parts)) == part) if parts > 1 else known
        names = own.toArrow().column("nearest").to_pylist()
        if names:
            found.append(search(LabelIndex.build(names, rare)))
    if not found:
        return asked.select("label", F.lit(fallback).alias("nearest"), F.lit(0.0).alias("score"))
    best = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        # min over (-score, label): best score first, then the least label
        best = best.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "nearest")).alias("b"))
        best = best.select("label", "b.nearest", (-F.col("b.s")).alias("score"))
    return best.withColumn("score", F.round("score", 6))
