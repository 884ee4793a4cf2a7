"""Interval-to-day grids: occupied hours, midnight presence and turnover per unit and day; as-of census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_occupancy(stays: DataFrame, *, unit: str, start: str, end: str, first: str, last: str, units: DataFrame | None = None) -> DataFrame:
    """``unit, day, occupied_hours (at most 24), at_midnight, stays``.

    Each stay is expanded to the days it touches inside [first, last], so no stay meets a day it does not touch.
    With ``units`` every unit has a row for every day; a unit nobody used has 0 hours. An open stay lasts on.
    """
    lo, hi = F.lit(first).cast("timestamp"), F.lit(last).cast("date")
    until = (hi + F.expr("interval 1 day")).cast("timestamp")
    s = stays.filter(F.col(unit).isNotNull() & F.col(start).isNotNull()).select(F.col(unit).alias(unit), F.greatest(F.col(start).cast("timestamp"), lo).alias("_s"), F.least(F.coalesce(F.col(end).cast("timestamp"), until), until).alias("_e")).filter("_s < _e")
    days = s.withColumn("day", F.explode(F.sequence(F.to_date("_s"), F.to_date(F.timestamp_micros(F.unix_micros("_e") - 1)), F.expr("interval 1 day"))))
    d0 = F.col("day").cast("timestamp")
    d1 = (F.col("day") + F.expr("interval 1 day")).cast("timestamp")
    secs = F.least("_e", d1).cast("long") - F.greatest("_s", d0).cast("long")
    out = days.groupBy(unit, "day").agg(
        F.least(F.sum(secs) / 3600.0, F.lit(24.0)).alias("occupied_hours"), F.max((F.col("_s") <= d0).cast("int")).alias("at_midnight"), F.count("*").alias("stays")
    )
    if units is None:
        return out
    grid = units.select(unit).distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), hi, F.expr("interval 1 day"))))
    return grid.join(out, [unit, "day"], "left").na.fill({"occupied_hours": 0.0, "at_midnight": 0, "stays": 0})


def census(df: DataFrame, *, start: str, end: str, days: DataFrame, day: str = "day") -> DataFrame:
    """How many had begun and not ended at the end of each day: running sum of entries minus exits, no range join."""
    ins = df.filter(F.col(start).isNotNull()).groupBy(F.to_date(start).alias("_d")).agg(F.count("*").alias("_n"))
    outs = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(F.greatest(F.to_date(end), F.to_date(start)).alias("_d")).agg((-F.count("*")).alias("_n"))
    moves = ins.unionByName(outs).groupBy("_d").agg(F.sum("_n").alias("_n"))
    # one row per day on both sides, so the window is over days and not over stays
    from pyspark.sql import Window

    ask = days.select(F.col(day).alias("_d"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask"))
    both = moves.withColumn("_ask", F.lit(0)).unionByName(ask)
    run = F.sum("_n").over(Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("census", run).filter("_ask = 1").select(F.col("_d").alias(day), "census")


def readmissions(df: DataFrame, *, person: str, start: str, end: str, key: str, planned: Column, ended_elsewhere: Column, days: int = 30) -> DataFrame:
    """``is_index`` and ``is_readmission`` flags.

    An admission is a readmission when the same person's previous one ended at most ``days`` before, was not a
    transfer or death (``ended_elsewhere`` of that one), and this one is not planned. Unknown persons never link.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(person).orderBy(start, key)
    prev_end, prev_bad = F.lag(end).over(w), F.lag(ended_elsewhere).over(w)
    gap = F.datediff(F.col(start), prev_end)
    hit = F.col(person).isNotNull() & gap.between(0, days) & ~planned & ~F.coalesce(prev_bad, F.lit(False))
    return df.withColumn("days_since_previous", F.when(F.col(person).isNotNull(), gap)).withColumn("is_readmission", F.coalesce(hit, F.lit(False))).withColumn("is_index", F.col(end).isNotNull() & ~ended_elsewhere)
