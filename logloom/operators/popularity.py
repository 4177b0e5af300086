"""How often tables, and tables together, are used; and the Pareto cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions.ordering import BLOCK, dense_position, running
from ..functions.text import computed
from ..session import held, small_side

NARROW = 6  # baskets up to this many tables give the first bound of the top lists
DIRECT = 16  # 560 sets of three at most
LEADING = 8  # the most frequent pairs, whose sets of three raise the bound
LETTERS = "abcde"


def query_tables(df: DataFrame) -> DataFrame:
    """(query_id, tables): sorted qualified names of queries with two or more.

    Written once, this narrow table serves every count below; the functions that
    take a log and read it more than once hold it, so the SQL is scanned once.
    """
    names = computed(df.select("query_id", "query_sql"), tables=F.sort_array(sx.qualified_tables("query_sql")))
    return names.filter(F.size("tables") >= 2).select("query_id", "tables")


def _count_tables(baskets: DataFrame) -> DataFrame:
    return (
        baskets.select(F.explode("tables").alias("full_name"))
        .groupBy("full_name")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def popular_from_baskets(baskets: DataFrame) -> DataFrame:
    ranked = dense_position(_count_tables(baskets), F.desc("count"), "full_name", name="rank")
    return ranked.select(
        "rank",
        sx.namespace_of("full_name").alias("namespace"),
        sx.table_of("full_name").alias("table"),
        "full_name",
        "count",
    )


def popular_tables(df: DataFrame) -> DataFrame:
    """Queries per table, over queries that use two tables or more."""
    return popular_from_baskets(query_tables(df))


def combinations(baskets: DataFrame, size: int) -> DataFrame:
    """One row per `size`-subset of each sorted basket, columns table_a, table_b, …

    Each member is a step of explode over the rest of the array, so subsets are
    streamed out of the row: no self-join and no shuffle.
    """
    rows = baskets.filter(F.size("tables") >= size).select(F.col("tables").alias("_rest"))
    for i, letter in enumerate(LETTERS[:size]):
        done = [f"table_{x}" for x in LETTERS[:i]]
        rows = rows.select(*done, "_rest", F.posexplode("_rest").alias("_at", f"table_{letter}"))
        left = size - i - 1
        if left:
            # members that still leave enough names for the later places
            rows = rows.filter(F.col("_at") < F.size("_rest") - left)
            rows = rows.withColumn(
                "_rest", F.slice("_rest", F.col("_at") + 2, F.size("_rest") - F.col("_at") - 1)
            )
    return rows.select(*[f"table_{x}" for x in LETTERS[:size]])


def _count_combinations(baskets: DataFrame, size: int) -> DataFrame:
    members = [f"table_{x}" for x in LETTERS[:size]]
    return combinations(baskets, size).groupBy(*members).agg(F.count(F.lit(1)).alias("count"))


def popular_combinations(baskets: DataFrame, size: int, max_tables: int | None = None) -> DataFrame:
    """Sets of `size` tables used together, ranked, with each member's own count.

    A query of n tables has C(n, size) sets; `max_tables` leaves out queries above it.
    """
    members = [f"table_{x}" for x in LETTERS[:size]]
    taken = baskets if max_tables is None else baskets.filter(F.size("tables") <= max_tables)
    counted = _count_combinations(taken, size)
    single = small_side(_count_tables(baskets))
    for m in members:
        own = single.select(F.col("full_name").alias(m), F.col("count").alias(f"{m}_count"))
        counted = counted.join(own, m)
    ranked = dense_position(counted, F.desc("count"), *members, name="rank")
    return ranked.select("rank", *members, "count", *[f"{m}_count" for m in members])


def popular_pairs(df: DataFrame, max_tables: int | None = None) -> DataFrame:
    return popular_combinations(held(query_tables(df)), 2, max_tables)


def popular_triples(df: DataFrame, max_tables: int | None = None) -> DataFrame:
    return popular_combinations(held(query_tables(df)), 3, max_tables)


def popular_quads(df: DataFrame, max_tables: int | None = None) -> DataFrame:
    return popular_combinations(held(query_tables(df)), 4, max_tables)


def popular_quints(df: DataFrame, max_tables: int | None = None) -> DataFrame:
    return popular_combinations(held(query_tables(df)), 5, max_tables)


def _leads(rows: DataFrame, name: str, left: int) -> DataFrame:
    """Conditional baskets: each member of `tables` that leaves `left` names behind it, as
    column `name`, with those names.  They are dealt out again, so the subsets of one wide
    row are formed in many tasks."""
    out = rows.select("*", F.posexplode("tables").alias("_at", name)).filter(F.col("_at") < F.size("tables") - left)
    rest = F.slice("tables", F.col("_at") + 2, F.size("tables") - F.col("_at") - 1)
    return out.withColumn("tables", rest).drop("_at").repartition("_row", name)


def _within(rows: DataFrame, keys: list[str], member: DataFrame, on: str) -> DataFrame:
    """Baskets cut down to the tables that `member` (keys of the lead, `on`) allows."""
    each = rows.select(*keys, F.explode("tables").alias(on))
    return (
        each.join(member, [c for c in member.columns], "left_semi")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(on)).alias("tables"))
    )


def _wide_sets(wide: DataFrame, size: int, pairs: DataFrame | None) -> DataFrame:
    """The sets of wide baskets (_row, tables), lead by lead; with `pairs` only those all of whose pairs are in it."""
    members = [f"table_{x}" for x in LETTERS[:size]]
    rows, done = wide, []
    for i, name in enumerate(members[:-1]):
        rows, done = _leads(rows, name, size - i - 1), [*done, name]
        if pairs is not None:  # what follows a lead must be its partner
            partners = pairs.select(F.col("table_a").alias(name), F.col("table_b").alias("_t"))
            rows = _within(rows, ["_row", *done], partners, "_t").filter(F.size("tables") >= size - i - 1)
    return rows.select(*done, F.explode("tables").alias(members[-1]))


def _first_sets(wide: DataFrame, size: int, n: int) -> DataFrame:
    """At least the first `n` sets (by name) of each wide basket, if it has as many."""
    starts = F.slice("tables", 1, n + size - 1)
    alone = reduce(lambda x, i: x * (F.size("tables") - i) / i, range(1, size), F.lit(1.0)) >= n
    rows = wide.select(F.when(alone, 1).otherwise(F.size("tables")).alias("_leads"), starts.alias("tables"))
    sets = combinations_of(rows, size)
    return sets.select(*[f"table_{x}" for x in LETTERS[:size]]).distinct()


def combinations_of(rows: DataFrame, size: int) -> DataFrame:
    """As `combinations`, the first member among the first `_leads` tables only."""
    first = rows.select("_leads", "tables", F.posexplode("tables").alias("_at", "table_a"))
    first = first.filter((F.col("_at") < F.col("_leads")) & (F.col("_at") < F.size("tables") - (size - 1)))
    out = first.select("table_a", F.slice("tables", F.col("_at") + 2, F.size("tables")).alias("tables"))
    if size == 2:
        return out.select("table_a", F.explode("tables").alias("table_b"))
    rest = [f"table_{x}" for x in LETTERS[1:size]]
    out = out.select("table_a", "tables")
    for i, name in enumerate(rest):
        left = size - 2 - i
        out = out.select(*[c for c in out.columns if c != "tables"], "tables", F.posexplode("tables").alias("_at", name))
        out = out.filter(F.col("_at") < F.size("tables") - left)
        out = out.withColumn("tables", F.slice("tables", F.col("_at") + 2, F.size("tables"))).drop("_at")
    return out.drop("tables")


def top_combinations(baskets: DataFrame, size: int, k: int, small: int = NARROW, direct: int = DIRECT) -> DataFrame:
    """The k most frequent sets with no limit on tables per query, exactly.

    A wide query (more than `small` tables) has far too many subsets to emit them all.  No set is more
    frequent than the least frequent of its members or pairs, so wide queries are mined by levels:

    * the k-th best count among narrow queries alone bounds the final k-th best count from below; in wide
      queries only tables at or above the bound take part;
    * for sets of three and more, only pairs at or above the bound take part, and the bound is raised first
      by the sets that contain one of the most frequent pairs;
    * subsets are formed from conditional baskets, one for each leading table, which are dealt out again.

    Where no wide query keeps more than `direct` tables at or above the bound, their few subsets are
    formed in the row instead.  The result is the same.

    A set of count 1 is no better than another but by name, so of these only the first by name are looked at.
    """
    members = [f"table_{x}" for x in LETTERS[:size]]
    order = [F.desc("count"), *members]
    narrow = baskets.filter(F.size("tables") <= small)
    # ids may be missing: rows get numbers of their own
    wide = baskets.filter(F.size("tables") > small).select(F.monotonically_increasing_id().alias("_row"), "tables")
    counted = _count_combinations(narrow, size)
    if wide.isEmpty():
        return _ranked(counted.orderBy(*order).limit(k), members)
    wide = held(wide)

    def kth(sets: DataFrame) -> int:
        """The k-th best count, a bound from below; 1 if there are fewer sets."""
        best = sets.select("count").orderBy(F.desc("count")).offset(k - 1).first()
        return 1 if best is None else best[0]

    bound = kth(counted)
    often = max(bound, 2)
    frequent = _count_tables(baskets).filter(F.col("count") >= often).select(F.col("full_name").alias("_t"))
    cut = _within(wide, ["_row"], frequent, "_t").filter(F.size("tables") >= size)
    cut = held(cut)
    pairs, widest = None, cut.agg(F.max(F.size("tables"))).first()[0] or 0
    if size > 2 and widest > direct:
        both = combinations(narrow, 2).unionByName(_wide_sets(cut, 2, None))
        pairs = both.groupBy("table_a", "table_b").agg(F.count(F.lit(1)).alias("count"))
        pairs = held(pairs.filter(F.col("count") >= often))
        bound = max(bound, kth(_around(baskets, pairs.orderBy(F.desc("count"), "table_a", "table_b").limit(LEADING), size, often)))
        often = max(bound, 2)
        pairs = small_side(pairs.filter(F.col("count") >= often).select("table_a", "table_b"))
    wide_sets = combinations(cut, size) if widest <= direct else _wide_sets(cut, size, pairs)
    sets = combinations(narrow, size).unionByName(wide_sets)
    top = held(sets.groupBy(*members).agg(F.count(F.lit(1)).alias("count")).orderBy(*order).limit(k))
    if bound <= 1 and top.filter(F.col("count") > 1).count() < k:
        # sets of count 1: fewer than k others exist, so the first 2 k of a row hold its share of the first k
        others = top.filter(F.col("count") > 1)
        once = _first_sets(wide, size, 2 * k).join(others, members, "left_anti").withColumn("count", F.lit(1).cast("long"))
        top = top.unionByName(once).distinct().orderBy(*order).limit(k)
    return _ranked(top, members)


def _around(baskets: DataFrame, few: DataFrame, size: int, often: int) -> DataFrame:
    """Counts, from `often` on, of the sets of three that hold one of a few pairs; no rows for other sizes."""
    rows = baskets.select(F.monotonically_increasing_id().alias("_row"), "tables")
    pairs = [(r.table_a, r.table_b) for r in few.collect()]  # at most LEADING
    if not pairs or size != 3:
        return baskets.sparkSession.createDataFrame([], "count long")
    has = [F.when(F.array_contains("tables", a) & F.array_contains("tables", b), F.array(F.lit(a), F.lit(b))) for a, b in pairs]
    held_pairs = rows.select("tables", F.explode(F.filter(F.array(*has), lambda p: p.isNotNull())).alias("_p"))
    beside = held_pairs.select("_p", F.explode(F.array_except("tables", "_p")).alias("_t"))
    counts = beside.groupBy("_p", "_t").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= often)
    # a set that holds two of the pairs is met twice
    return counts.select(F.array_sort(F.concat("_p", F.array("_t"))).alias("_s"), "count").distinct()


def _ranked(top: DataFrame, members: list[str]) -> DataFrame:
    order = Window.orderBy(F.desc("count"), *members)  # k rows
    return top.withColumn("rank", F.row_number().over(order).cast("long")).select("rank", *members, "count")


def top_pairs_uncapped(df: DataFrame, k: int = 30) -> DataFrame:
    return top_combinations(held(query_tables(df)), 2, k)


def top_triples_uncapped(df: DataFrame, k: int = 20) -> DataFrame:
    return top_combinations(held(query_tables(df)), 3, k)


# --- Pareto -----------------------------------------------------------------


def impact(popular: DataFrame, cut: float = 80.0, block: int = BLOCK) -> DataFrame:
    """Share and running share in rank order; top_80 while the running share is at
    most `cut`, so the row that crosses it is tail_20.  Counts are summed as
    integers and divided once."""
    total = popular.agg(F.sum("count")).scalar()
    run = running(popular, "rank", sums={"_run": F.col("count")}, block=block)
    cumulative = F.col("_run") / total * 100
    return run.select(
        "rank",
        "namespace",
        "table",
        "full_name",
        F.col("count").alias("appearances"),
        F.round(F.col("count") / total * 100, 4).alias("appearance_share_pct"),
        F.round(cumulative, 4).alias("cumulative_pct"),
        F.when(cumulative <= cut, "top_80").otherwise("tail_20").alias("tier"),
    )


def impact_summary(rows: DataFrame) -> DataFrame:
    """Tables and appearances per tier, and over all (tier NULL)."""
    return rows.rollup("tier").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("appearances").alias("appearances")
    )


def impact_listing(rows: DataFrame, k: int = 20) -> DataFrame:
    return rows.orderBy("rank").limit(k)


def top_tier(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("tier") == "top_80")


def prefix_counts(*logs: DataFrame, n: int | None = None) -> DataFrame:
    """Occurrences (not queries) of each table and of each first name part over
    several logs: (kind, name, count); with `n`, the n most common of each kind."""
    sql = reduce(DataFrame.unionByName, [df.select("query_sql") for df in logs])
    names = sql.select(F.explode(sx.simple_tables("query_sql")).alias("t"))
    # count tables first: prefixes are then summed over distinct tables only
    tables = held(names.groupBy("t").agg(F.count(F.lit(1)).alias("count")))
    by_prefix = tables.groupBy(sx.prefix_of("t").alias("name")).agg(F.sum("count").alias("count"))
    out = tables.select(F.lit("table").alias("kind"), F.col("t").alias("name"), "count").unionByName(
        by_prefix.select(F.lit("prefix").alias("kind"), "name", "count")
    )
    if n is None:
        return out
    kinds = [
        out.filter(F.col("kind") == kind).orderBy(F.desc("count"), "name").limit(n)
        for kind in ("table", "prefix")
    ]
    return kinds[0].unionByName(kinds[1])


