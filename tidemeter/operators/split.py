"""Ordered operators that never sort a hot key in one task.

A key may hold a large share of all rows. The rows are therefore cut into pieces (key, piece) along their order, by
bounds from a sample whose size follows the number of rows and of shuffle partitions: about ``PIECES`` pieces for
each partition, whatever the values are and however they lie. Only keys of many rows have bounds, so the tables of bounds and of what passes from piece
to piece have a few rows for each partition, and are broadcast. Rows are moved and sorted once, by (key, piece).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions.columns import let
from tidemeter.session import stored

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)
#: Pieces for each shuffle partition, sampled rows for each piece, and steps of the sampling hash.
PIECES, SAMPLES, HASHES = 4, 16, 1 << 30
#: Rows of a table that may be broadcast after it has been counted.
SMALL = 500_000


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups dealt over all shuffle partitions, for work that is long for its bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(frame: DataFrame, label: str) -> DataFrame:
    """The frame written once; it is broadcast where its counted rows are few, else joined as the optimizer sees fit."""
    held = stored(frame, label)
    return F.broadcast(held) if held.count() <= SMALL else held


def _attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of a table of few rows by null-safe keys; the rows of ``df`` stay where they are."""
    renamed = table.select(*[F.col(k).alias(f"_at_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    joined = df.join(F.broadcast(renamed), reduce(lambda a, b: a & b, same) if same else F.lit(True), "left")
    return joined.drop(*[f"_at_{k}" for k in keys])


def bounds(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """(keys, _bounds): ascending places in the order that cut the keys of many rows into pieces of about equal size.

    Rows are sampled by a hash of key and order, so the sample is the same whenever it is drawn; equal rows count once.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, PIECES * SAMPLES * partitions / max(rows, 1))
    place = F.struct(*order)
    drawn = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(HASHES)) < int(share * HASHES)).select(*keys, place.alias("_place")).distinct()
    sample = F.array_sort(F.collect_list("_place"))  # at most the whole sample
    spaced = F.filter("_all", lambda x, i: i % SAMPLES == SAMPLES - 1)
    cut = drawn.groupBy(*keys).agg(sample.alias("_all")).select(*keys, spaced.alias("_bounds"))
    return cut.where(F.size("_bounds") > 0)


def piece_of(cut: Column, place: Column) -> Column:
    """Number of bounds that are not behind a place, by binary search."""

    def halve(state: Column, b: Column) -> Column:
        middle = ((state["low"] + state["high"]) / 2).cast("int")
        ahead = F.get(b, middle) <= place
        nearer = F.struct(F.when(ahead, middle + 1).otherwise(state["low"]).alias("low"), F.when(ahead, state["high"]).otherwise(middle).alias("high"))
        return F.when(state["low"] < state["high"], nearer).otherwise(state)

    def search(b: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(b) + 1)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(b).alias("high")), lambda state, _: halve(state, b))["low"]

    return F.when(cut.isNull(), F.lit(0)).otherwise(let(cut, search))


def cut(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """The rows with ``_piece``, and ``_hot`` for keys that have more than one. ``rows`` is about their number, counted if not given."""
    rows = df.count() if rows is None else rows
    placed = _attach(df, bounds(df, keys, order, rows), keys)
    piece = piece_of(F.col("_bounds"), F.struct(*order))
    return placed.withColumns({"_piece": piece, "_hot": F.col("_bounds").isNotNull()}).drop("_bounds")


def along(pieces: DataFrame, keys: list[str], order: list[str], totals: dict[str, str] | None = None, before: tuple[str, list[str]] | None = None) -> DataFrame:
    """Running totals up to each row, and a struct of columns of the row before it (null on a key's first row), in one sort.

    ``pieces`` comes from ``cut``. ``totals`` maps output to input columns; ``before`` is (output, columns).
    """
    totals = totals or {}
    by_piece = [*keys, "_piece"]
    within = Window.partitionBy(*by_piece).orderBy(*order)
    columns = {out: F.sum(value).over(within.rowsBetween(*UP_TO)) for out, value in totals.items()}
    ends = [F.sum(value).alias(f"_t_{out}") for out, value in totals.items()]
    earlier = Window.partitionBy(*keys).orderBy("_piece")
    carried = [F.sum(f"_t_{out}").over(earlier.rowsBetween(*BEFORE)).alias(f"_o_{out}") for out in totals]
    added = {out: F.col(out) + F.coalesce(f"_o_{out}", F.lit(0)) for out in totals}
    if before:
        columns[before[0]] = F.lag(F.struct(*before[1])).over(within)
        ends.append(F.max_by(F.struct(*before[1]), F.struct(*order)).alias("_last"))
        carried.append(F.lag("_last").over(earlier).alias("_carried"))
        added[before[0]] = F.coalesce(before[0], "_carried")
    hot = pieces.where("_hot").groupBy(*by_piece).agg(*ends)
    joined = _attach(pieces.withColumns(columns), hot.select(*by_piece, *carried), by_piece)
    return joined.withColumns(added).drop("_carried", *[f"_o_{out}" for out in totals])


def in_order(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str] | None = None, before: tuple[str, list[str]] | None = None, rows: int | None = None) -> DataFrame:
    return along(cut(df, keys, order, rows), keys, order, totals, before).drop("_piece", "_hot")


def running_total(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], rows: int | None = None) -> DataFrame:
    """Running totals including the current row; ``values`` maps output name to input column."""
    return in_order(df, keys, order, totals=values, rows=rows)


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Struct of ``columns`` from the previous row of the key, null on its first row."""
    return in_order(df, keys, order, before=(out, columns), rows=rows)


def value_histogram(df: DataFrame, keys: list[str], labels: list[str], value: str) -> DataFrame:
    """Distinct non-null values with their counts: equal values collapse before anything is sorted."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, *labels, value).agg(F.count(F.lit(1)).alias("n"))


def rank_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For every distinct value of a key: its count ``n`` and ``upto``, the rows not above it.

    Ranks follow directly: the average rank of a tied value is ``upto - (n - 1) / 2``.
    """
    return running_total(stored(value_histogram(df, keys, [], value), "ranks"), keys, [value], {"upto": "n"})
