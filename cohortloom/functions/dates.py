"""Days and periods: how far a time lies from a start, and which period it falls into."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

DAY_US = 86_400_000_000


def get_periods(start: datetime, end: datetime, unit: str, delta: int = 1) -> list[datetime]:
    """Starts of periods of `delta` days or weeks from start towards end; the end belongs if it is hit exactly. A negative delta counts back."""
    if unit not in ("day", "days", "week", "weeks"):
        raise ValueError("unit must be day or week")
    if delta == 0 or (delta > 0) != (end >= start):
        raise ValueError("delta must lead from start to end")
    step = timedelta(days=delta * (7 if unit.startswith("week") else 1))
    out = [start]
    while (out[-1] + step <= end) if delta > 0 else (out[-1] + step >= end):
        out.append(out[-1] + step)
    return out if delta > 0 else out[::-1]


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the latter as UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def get_days(df: DataFrame, when: str, day: str = "day", in_range: str = "in_range", keep: Column | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """df with whole days since `start` (or since the least time that is kept) and whether a time is kept and within [start, end).

    The least time is a one-row aggregate.
    """
    t = micros(F.col(when))
    kept = keep if keep is not None else F.lit(True)
    epoch = lambda d: int((d - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    inside = kept & t.isNotNull()
    if start is not None:
        inside = inside & (t >= epoch(start))
    if end is not None:
        inside = inside & (t < epoch(end))
    if start is not None:
        based = df.withColumn("_base", F.lit(epoch(start)))
    else:
        least = df.filter(kept).agg(F.min(t).alias("_base"))
        based = df.crossJoin(F.broadcast(least))  # one row
    days = F.floor((t - F.col("_base")) / DAY_US).cast("int")
    return based.withColumns({day: days, in_range: F.coalesce(inside, F.lit(False))}).drop("_base")


def period_offsets(periods: list[datetime]) -> list[int]:
    """For each day from the first period's start to the last's: the number of its period."""
    days = [(p - periods[0]).days for p in periods]
    return [k for k, (a, b) in enumerate(zip(days, days[1:])) for _ in range(b - a)]


def get_period_offset(day: Column, offsets: list[int], in_range: Column | None = None) -> Column:
    """The period of a day, -1 where it is out of range."""
    table = F.array(*[F.lit(x) for x in offsets])
    inside = (day >= 0) & (day < len(offsets))
    if in_range is not None:
        inside = inside & in_range
    return F.coalesce(F.when(inside, F.element_at(table, day + 1)), F.lit(-1)).cast("int")
