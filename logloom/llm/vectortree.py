"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample: nodes are split in `branch` clusters until a leaf
stands for about `leaf_rows` rows of the whole table (or holds few sample rows).  Every row is
then indexed: it descends to a leaf.  Rows are read in pages: the largest subtrees of at most
`block` rows, and blocks of about that many rows of a leaf that is larger, so a leaf of any
size is spread over many tasks, and a query goes to a page once, with the list of its leaves there.

A search walks the tree best bin first: a priority queue holds the branches not taken by
the distance of their centres, and leaves are visited in that order.  How many is measured, not guessed: a
bounded sample of rows is searched by brute force, the places of their true neighbours
in their own visiting order are looked up, and the visits are widened until the lower bound of the sample's
recall reaches the target.  A query that has met too few rows by then goes on to further leaves.
The page of the nearest leaf is read first; from the other pages come only rows that are no farther than
the last that it gave.  Distances are computed directly, in double precision, on the original vectors.

Equal vectors are indexed once, with their k + 1 smallest ids: no other copy can be among
the k nearest of any query, own id left out.  Equal queries are searched once.

Bounds (parameters): `SAMPLE` rows fit the tree, so it has at most as many leaves, and
`CALIBRATION` rows measure recall; both are independent of the size of the table, and the tree
may go to every task.  Nothing bounds rows, blocks, candidates or queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without id; vectors of another length than most have (ties: the
shorter) take no part; rows that repeat id and vector count once, other rows of a repeated id are
candidates and queries of their own; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

K = 10
SAMPLE = 32_768
BRANCH = 16
LEAF_ROWS = 128
#: A node of fewer sample rows is not split.
LEAF_SAMPLE = 8
ROUNDS = 12
CALIBRATION = 256
TARGET = 0.95
#: Rows of a page, and queries of a page, that meet in one group.
BLOCK = 2_048
CHUNK = 4_096


@dataclass
class Tree:
    """Nodes by number, the root first.  A leaf has no children; `rows` is counted after indexing."""

    centres: np.ndarray
    children: list[list[int]]
    rows: dict[int, int] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the child with the nearest centre."""
        at = np.zeros(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            best = nearest_centre(vectors[rows], self.centres[kids])
            waiting += [(kid, rows[best == i]) for i, kid in enumerate(kids)]
        return at

    def pages(self, block: int) -> dict[int, int]:
        """The page of each leaf: its highest ancestor with at most `block` rows, or else itself."""
        rows, parent = [0] * len(self.children), {}
        for node in reversed(range(len(self.children))):  # children have higher numbers
            rows[node] = sum(rows[kid] for kid in self.children[node]) if self.children[node] else self.rows.get(node, 0)
            parent.update((kid, node) for kid in self.children[node])
        out = {}
        for leaf in self.rows:
            page = leaf
            while page in parent and rows[parent[page]] <= block:
                page = parent[page]
            out[leaf] = page
        return out

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first: down to the nearest child, the others wait in the queue."""
        apart = ((self.centres - query) ** 2).sum(axis=1).tolist()
        waiting = [(0.0, 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            while kids := self.children[node]:
                best = min(kids, key=apart.__getitem__)
                for kid in kids:
                    if kid != best:
                        heapq.heappush(waiting, (apart[kid], kid))
                node = best
            yield node

    def visits(self, query: np.ndarray, leaves: int, least: int) -> list[int]:
        """The first `leaves` leaves with rows, and more until they hold `least` rows or none is left."""
        taken, rows = [], 0
        for leaf in self.order(query):
            if leaf in self.rows:
                if len(taken) >= leaves and rows >= least:
                    break
                taken.append(leaf)
                rows += self.rows[leaf]
        return taken


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, up to rounding."""
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the number of each vector's centre; empty clusters are left out."""
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(ROUNDS):
        at = nearest_centre(vectors, centres)
        used, at = np.unique(at, return_inverse=True)
        sums = (at[None, :] == np.arange(len(used))[:, None]).astype(np.float64) @ vectors
        after = sums / np.bincount(at)[:, None]
        if len(after) == len(centres) and np.allclose(after, centres):
            break
        centres = after
    return centres, nearest_centre(vectors, centres)


def grow(sample: np.ndarray, rows: int, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over a sample that stands for `rows` rows."""
    rng = np.random.default_rng(12)
    least = max(LEAF_SAMPLE, math.ceil(leaf_rows * len(sample) / max(1, rows)))
    centres, children = [sample.mean(axis=0)], [[]]
    waiting = [(0, sample)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= least:
            continue
        means, at = k_means(own, min(branch, len(own)), rng)
        parts = [own[at == i] for i in range(len(means))]
        if sum(len(p) > 0 for p in parts) < 2:
            continue
        for mean, part in zip(means, parts, strict=True):
            if len(part):
                children[node].append(len(centres))
                waiting.append((len(centres), part))
                centres.append(mean)
                children.append([])
    return Tree(np.array(centres), children)


def usable(items: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): the rows whose vectors are finite and not zero; floats stay floats."""
    exact = items.schema[vector].dataType == T.ArrayType(T.FloatType())
    vec = F.col(vector) if exact else F.col(vector).cast("array<double>")
    return items.select(F.col(key).alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def _share(rows: int, wanted: int, salt: int) -> Column:
    """About `wanted` of `rows` rows, by a hash of the vector: the same ones in every run."""
    of = (1 << 31) - 1
    return F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(of)) < F.lit(min(of, math.ceil(of * wanted / max(1, rows))))


def fit(vectors: DataFrame, rows: int, sample: int = SAMPLE, **grown: int) -> Tree:
    """The tree, made in one task from a bounded sample; only its nodes come to the driver."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = [matrix(batch["vec"]) for batch in batches if len(batch)]
        if drawn:
            drawn = np.concatenate(drawn)
            drawn = drawn[np.lexsort(drawn.T[::-1])]  # whatever order the rows came in
            tree = grow(drawn, rows, **grown)
            yield pd.DataFrame({"node": range(len(tree.children)), "centre": list(tree.centres), "children": tree.children})

    drawn = vectors.where(_share(rows, sample, 1)).select("vec").distinct().repartition(1)
    nodes = drawn.mapInPandas(make, "node long, centre array<double>, children array<long>").collect()
    nodes.sort()
    return Tree(np.array([n.centre for n in nodes]), [list(n.children) for n in nodes])


def pairs_of(queries: np.ndarray, vectors: np.ndarray, ids: list, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest (distance, id); equal distances by id.  `ids` has the ids of each vector."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids])
    row = np.repeat(np.arange(len(ids)), sizes)
    out = []
    for query in queries:
        apart = vectors - query
        apart = np.sqrt(np.einsum("nd,nd->n", apart, apart))
        near = apart[row]
        if len(near) > k:
            inside = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1])
        else:
            inside = np.arange(len(near))
        best = inside[np.lexsort((flat[inside], near[inside]))[:k]]
        out.append(list(zip(near[best].tolist(), flat[best].tolist(), strict=True)))
    return out


def _true_leaves(index: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    """For each row asked for, the leaves of its true k nearest: brute force over all rows, a task
    keeping the best it has met."""
    numbers, queries = [q for q, _ in asked], np.array([v for _, v in asked])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in numbers]
        for batch in batches:
            if len(batch):
                leaf_of = {i: leaf for ids, leaf in zip(batch["ids"], batch["leaf"], strict=True) for i in ids}
                for mine, found in zip(best, pairs_of(queries, matrix(batch["vec"]), batch["ids"].tolist(), k + 1), strict=True):
                    mine[:] = sorted([*mine, *((d, i, leaf_of[i]) for d, i in found)])[: k + 1]
        rows = [(n, *x) for n, mine in enumerate(best) for x in mine]
        yield pd.DataFrame(rows, columns=["n", "apart", "id", "leaf"])

    met = index.select("ids", "leaf", "vec").mapInPandas(look, "n int, apart double, id long, leaf long")
    first = Window.partitionBy("n").orderBy("apart", "id")
    near = met.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).orderBy("n", "r").collect()
    out: dict[int, list[int]] = {n: [] for n in range(len(numbers))}
    for r in near:
        if r.id != numbers[r.n] and len(out[r.n]) < k:
            out[r.n].append(r.leaf)
    return out


def calibrate(index: DataFrame, tree: Tree, rows: int, k: int, target: float = TARGET, wanted: int = CALIBRATION) -> tuple[int, float]:
    """(leaves to visit, recall of the sample then): visits widen until recall less 1.64 standard errors is `target`."""
    asked = [(r.id, r.vec) for r in index.where(_share(rows, wanted, 2)).select(F.get("ids", F.lit(0)).alias("id"), "vec").collect()]
    if not asked:
        return len(tree.rows), 1.0
    truth = _true_leaves(index, asked, k)
    places = []
    for n, (_, vec) in enumerate(asked):
        order = {leaf: i for i, leaf in enumerate(x for x in tree.order(np.array(vec)) if x in tree.rows)}
        places.append(np.array([order[leaf] for leaf in truth[n]]))
    places = [p for p in places if len(p)]
    for leaves in range(1, len(tree.rows) + 1):
        recall = np.array([(p < leaves).mean() for p in places])
        if not len(recall) or recall.mean() - 1.64 * recall.std() / math.sqrt(len(recall)) >= target:
            return leaves, float(recall.mean()) if len(recall) else 1.0
    return len(tree.rows), 1.0


def search(
    items: DataFrame,
    is_query: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    target: float = TARGET,
    sample: int = SAMPLE,
    block: int = BLOCK,
    chunk: int = CHUNK,
    **grown: int,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row where `is_query` holds
    (a condition on the column `id`), nearest first, ties to the smaller id, own id left out.
    `block` and `chunk` say how many rows and queries meet in one group; `grown` goes to `grow`."""
    rows = usable(items, key, vector)
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("vec")).alias("n"))
    most = lengths.orderBy(F.desc("rows"), "length").first()
    if most is None:
        return items.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, n = rows.where(F.size("vec") == most.length), most.n
    tree = fit(rows, n, sample, **grown)
    if not tree.children:  # so few rows that none fell in the sample
        tree = fit(rows, 1, sample, **grown)

    # the k + 1 smallest ids of a vector; Spark cuts each task's rows to that many before the shuffle
    first = Window.partitionBy("vec").orderBy("id")
    copies = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = copies.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    shared = items.sparkSession.sparkContext.broadcast(tree)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.place(matrix(batch["vec"])))

    kind = rows.schema["vec"].dataType.simpleString()
    index = points.mapInPandas(index_rows, f"vec {kind}, ids array<long>, leaf long")
    index = stored(index, "index")
    sizes = index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("rows"), F.count("*").alias("n")).collect()  # a row a leaf
    tree.rows = {r.leaf: r.rows for r in sizes}
    leaves, _ = calibrate(index, tree, n, k, target)
    page_of = tree.pages(block)

    asked = rows.where(is_query)
    # equal queries are searched once, under their smallest id
    each = asked.groupBy("vec").agg(F.min("id").alias("asked"))
    walked = items.sparkSession.sparkContext.broadcast((tree, page_of))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, page = walked.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part, found = batch.iloc[start : start + 256], []
                for i, query in enumerate(matrix(part["vec"])):
                    seen: dict[int, list[int]] = {}
                    for leaf in known.visits(query, leaves, k + 1):
                        seen.setdefault(page[leaf], []).append(leaf)
                    found += [(i, p, leaf, n == 0) for n, (p, leaf) in enumerate(seen.items())]
                at, pages, seen_leaves, firsts = zip(*found, strict=True)
                yield part.iloc[list(at)].assign(page=pages, leaves=seen_leaves, first=firsts)

    visits = each.mapInPandas(walk, f"vec {kind}, asked long, page long, leaves array<long>, first boolean")
    visits = stored(visits, "visits")
    held: dict[int, int] = {}
    for r in sizes:
        held[page_of[r.leaf]] = held.get(page_of[r.leaf], 0) + r.n
    cuts = [(r.leaf, page_of[r.leaf], math.ceil(held[page_of[r.leaf]] / block)) for r in sizes]
    cuts = items.sparkSession.createDataFrame(cuts, "leaf long, page long, blocks long")
    chunks = visits.groupBy("page").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("chunks"))
    cuts = stored(cuts.join(F.broadcast(chunks), "page"), "cuts")  # a row a leaf, at most `sample`

    # each block of a page meets each chunk of its queries: a group of bounded size
    of = lambda column, count: F.pmod(F.xxhash64(column), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = index.join(F.broadcast(cuts), "leaf").withColumn("b", of("vec", "blocks")).withColumn("c", every("chunks"))
    left = left.select("page", "b", "c", "leaf", "ids", "vec").groupBy("page", "b", "c")
    pages = F.broadcast(cuts.select("page", "blocks", "chunks").distinct())

    def meet(some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(queries):
            some = some.sort_values("leaf", kind="stable")
            names, starts = np.unique(some["leaf"].to_numpy(), return_index=True)
            span = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(some)], strict=True), strict=True))
            vectors, ids = matrix(some["vec"]), some["ids"].tolist()
            for q, query, wanted, most in zip(queries["asked"], matrix(queries["vec"]), queries["leaves"], queries["most"], strict=True):
                at = [i for leaf in wanted if leaf in span for i in range(*span[leaf])]
                if at:
                    near = pairs_of(query[None, :], vectors[at], [ids[i] for i in at], k + 1)[0]
                    found += [(q, d, i) for d, i in near if not d > most]  # no bound is NaN
        return pd.DataFrame(found, columns=["asked", "score", "id"])

    def visit(some: DataFrame) -> DataFrame:
        right = some.join(pages, "page").withColumn("c", of("asked", "chunks")).withColumn("b", every("blocks"))
        right = right.select("page", "b", "c", "asked", "vec", "leaves", "most").groupBy("page", "b", "c")
        found = left.cogroup(right).applyInPandas(meet, "asked long, score double, id long")
        nearest = Window.partitionBy("asked").orderBy("score", "id")
        return found.distinct().withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)

    # the page of the nearest leaf first: what it gives bounds what the other pages send
    near = stored(visit(visits.where("first").withColumn("most", F.lit(None).cast("double"))), "near")
    bound = near.where(F.col("r") == k + 1).select("asked", F.col("score").alias("most"))
    met = near.unionByName(visit(visits.where(~F.col("first")).join(bound, "asked", "left")))
    nearest = Window.partitionBy("asked").orderBy("score", "id")
    met = met.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    lists = met.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))

    own = asked.join(each, "vec").select("id", "asked").distinct().join(lists, "asked")
    others = F.slice(F.filter("near", lambda x: (x["id"] != F.col("id")) | (x["score"] > 0)), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
