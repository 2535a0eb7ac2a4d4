"""Dates, seasons and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """The date of an ISO date or timestamp text, with or without a trailing ``Z``."""
    return F.to_date(F.substring(text.cast("string"), 1, 10))


def season_of(day: Column) -> Column:
    """Season id ``yyyyYYYY``; a season starts in August."""
    first = F.year(day) - F.when(F.month(day) >= 8, 0).otherwise(1)
    return (first * 10001 + 1).cast("long")


def season_start(season: Column) -> Column:
    return F.make_date(F.floor(season / 10000).cast("int"), F.lit(10), F.lit(1))


def season_end(season: Column) -> Column:
    return F.make_date((season % 10000).cast("int"), F.lit(6), F.lit(30))


def season_label(season: Column) -> Column:
    text = season.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 7, 2))


def snapshot_dates(season: Column, stop: Column | None = None) -> Column:
    """Season start, then each first of month from November, then the last day — as an array of dates."""
    start = season_start(season)
    end = season_end(season) if stop is None else F.least(season_end(season), stop)
    first_month = F.add_months(start, 1)
    months = F.when(first_month <= end, F.sequence(first_month, end, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )
    return F.array_distinct(F.concat(F.array(start), months, F.array(end)))


def date_range(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def clock_seconds(clock: Column) -> Column:
    """``MM:SS`` as seconds; anything else is null."""
    parts = F.split(clock, ":", 2)
    return F.get(parts, F.lit(0)).try_cast("bigint") * 60 + F.get(parts, F.lit(1)).try_cast("bigint")


def game_seconds(period: Column, clock: Column, *, live: bool = False) -> Column:
    """Seconds since the start: 1200 per regulation period, 300 per overtime.

    The live variant puts periods before the first at second 0.
    """
    elapsed = clock_seconds(clock)
    number = period.cast("long")
    running = F.when(number <= 3, (number - 1) * 1200 + elapsed).otherwise(3600 + (number - 4) * 300 + elapsed)
    if live:
        running = F.when((number <= 0) & elapsed.isNotNull(), F.lit(0)).otherwise(running)
    return running.cast("long")


def remaining_regulation(seconds: Column) -> Column:
    return F.greatest(F.lit(0), 3600 - F.least(F.coalesce(seconds, F.lit(0)), F.lit(3600))).cast("long")


def remaining_game(seconds: Column, max_periods: Column) -> Column:
    total = 3600 + F.greatest(F.lit(0), max_periods - 3) * 300
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), total - seconds)).cast("long")


def progress(seconds: Column, max_periods: Column) -> Column:
    total = (max_periods - 3) * 300 + 3600
    return F.rint(F.coalesce(seconds, F.lit(0)) / total * 1e5) / 1e5


def short_time(start_utc: Column, game_date: Column) -> Column:
    """``Tue 29 Sep, 23:00 UTC`` when the start time parses, else the date text."""
    moment = F.try_to_timestamp(F.nullif(start_utc, F.lit("")))
    return F.coalesce(F.concat(F.date_format(moment, "EEE dd MMM, HH:mm"), F.lit(" UTC")), game_date.cast("string"))
