"""Card-level operators: repeat use, inferred trips, origin-destination shares, gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators.split import along, cut, previous_row


def trips(taps: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """A trip per card whenever two consecutive taps are at different stations."""
    clean = taps.where("station IS NOT NULL AND card IS NOT NULL").select("card", "ts", "station", tiebreak)
    paired = previous_row(clean, ["card"], ["ts", tiebreak], ["ts", "station"], "before")
    return paired.where(F.col("before.station") != F.col("station")).select(
        "card",
        F.col("before.station").alias("origin"),
        F.col("station").alias("destination"),
        F.col("before.ts").alias("t1"),
        F.col("ts").alias("t2"),
    )


def shares(counts: DataFrame, within: list[str], n: str = "n") -> DataFrame:
    """Share of each destination among the trips of its origin."""
    total = F.sum(n).over(Window.partitionBy(*within, "origin"))
    return counts.withColumn("p", F.col(n) / total)


def destination_shares(trip_rows: DataFrame) -> DataFrame:
    return shares(trip_rows.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n")), [])


def destination_shares_by_window(trip_rows: DataFrame, minutes: int = 15) -> DataFrame:
    """Historical shares by the window in which the trip started."""
    window = C.floor_minutes("t1", minutes).alias("window")
    return shares(trip_rows.groupBy(window, "origin", "destination").agg(F.count(F.lit(1)).alias("n")), ["window"])


def rolling_shares(trip_rows: DataFrame, minutes: int = 15, tick_minutes: int = 15) -> DataFrame:
    """Shares at aligned ticks over trips that are finished and whose origin is recent enough."""
    first = C.ceil_minutes("t2", tick_minutes)
    last = C.floor_minutes(F.col("t1") + F.expr(f"INTERVAL {minutes} MINUTES"), tick_minutes)
    live = trip_rows.where(first <= last).select(
        "origin",
        "destination",
        F.explode(F.sequence(first, last, F.expr(f"INTERVAL {tick_minutes} MINUTES"))).alias("tick"),
    )
    counted = live.groupBy("tick", "origin", "destination").agg(F.count(F.lit(1)).alias("n"))
    return shares(counted, ["tick"])


def card_counts(taps: DataFrame) -> DataFrame:
    return taps.where("card IS NOT NULL").groupBy("card").agg(F.count(F.lit(1)).alias("n"))


def repeat_summary(taps: DataFrame) -> DataFrame:
    """Cards, repeat cards, repeated records and the distribution of taps among repeat cards.

    The distribution is taken from the histogram of counts, which is short whatever the number of cards.
    """
    histogram = card_counts(taps).groupBy("n").agg(F.count(F.lit(1)).alias("cards"))
    repeat = F.col("n") > 1
    n, cards = F.when(repeat, F.col("n")), F.when(repeat, F.col("cards"))
    size = F.sum(cards)
    total = F.sum(n * cards)
    quartile = F.expr(
        "percentile(CASE WHEN n > 1 THEN n END, array(0.25D, 0.5D, 0.75D), CASE WHEN n > 1 THEN cards ELSE 0 END)"
    )
    summary = histogram.agg(
        F.sum("cards").alias("cards"),
        size.alias("repeat_cards"),
        (F.sum(F.col("n") * F.col("cards")) - F.sum("cards")).alias("repeated_records"),
        (total / size).alias("mean"),
        F.sqrt(F.try_divide(F.sum(n * n * cards) - total * total / size, size - 1)).alias("std"),
        F.min(n).alias("min"),
        quartile.alias("q"),
        F.max(n).alias("max"),
    )
    parts = [F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))]
    return summary.select("*", *parts).drop("q")


def repeat_card_rows(taps: DataFrame, at_least: int = 2) -> DataFrame:
    """All taps of cards with several taps."""
    qualifying = card_counts(taps).where(F.col("n") >= at_least).select("card")
    return taps.join(qualifying, "card", "left_semi")


def two_tap_gaps(taps: DataFrame) -> DataFrame:
    """Minutes between the taps of cards that have exactly two."""
    per_card = taps.where("card IS NOT NULL").groupBy("card").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return per_card.where("n = 2").select("card", (C.seconds_between("last", "first") / 60).alias("minutes"))


def batches(taps: DataFrame, gap_s: float = 5.0, keys: list[str] | None = None, tiebreak: str = "event_id") -> DataFrame:
    """Collapse bursts: a batch ends where the gap to the next tap exceeds ``gap_s``; its first tap remains."""
    return numbered_batches(taps, gap_s, keys, tiebreak, numbers=False).where("first").drop("first")


def batch_ids(taps: DataFrame, gap_s: float = 5.0, keys: list[str] | None = None, tiebreak: str = "event_id") -> DataFrame:
    """Number every tap with its batch, counted from 1 per key."""
    return numbered_batches(taps, gap_s, keys, tiebreak).drop("first")


def numbered_batches(taps: DataFrame, gap_s: float = 5.0, keys: list[str] | None = None, tiebreak: str = "event_id", numbers: bool = True) -> DataFrame:
    """Every tap with ``first``, whether it opens a batch, and with the number of its ``batch``; one sort serves both."""
    keys, order = keys or ["station"], ["ts", tiebreak]
    gaps = along(cut(taps, keys, order), keys, order, before=("_before", ["ts"]))
    gap = C.seconds_between("ts", "_before.ts")
    flagged = gaps.withColumn("first", gap.isNull() | (gap > gap_s)).drop("_before")
    if numbers:
        flagged = along(flagged.withColumn("_opens", F.col("first").cast("int")), keys, order, totals={"batch": "_opens"}).drop("_opens")
    return flagged.drop("_piece", "_hot")
