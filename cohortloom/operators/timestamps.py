"""Timestamps in many writings and zones, brought to one UTC instant.

Every writing is first rewritten by a chain of anchored patterns into one delimited form (kind, numbers, zone), then
read once from that form. Zones written in the text decide, then the zone column. Where both are absent the zone is
estimated per source and period: local times are aligned with their arrivals, or with the arrivals before and after
them in sequence, and of all offset histories (regions with their daylight-saving changes, and changes of region from
one period to another) the one is taken that violates this alignment least; where the default does well, it stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortloom.functions.common import bound, need, sealed, strip

#: The writing that is already unambiguous.
CANONICAL = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}\+00:00\z"

# Month names by their first letters, English and German.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
MONTH_WORD = r"(january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|maerz|mrz|mai|juni|juli|oktober|dezember|jan|feb|mar|mär|apr|jun|jul|aug|sept|sep|oct|okt|nov|dec|dez)"
WEEKDAY = r"(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day|mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonnabend|sonntag|mo|di|mi|do|fr|sa|so)"

# Minutes east of Greenwich of the abbreviations of zones, first where the abbreviation stands for itself,
# then where the row's zone tells which is meant.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120,
}
ABBREVIATIONS_OF_ZONE = {("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("CST", "Asia/Shanghai"): 480, ("BST", "Asia/Dhaka"): 360}

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d{2}(?:[:.]?\d{2})?|[+-]\d{2}:?\d{2} ?\[[A-Za-z0-9_/+-]+\]|\[[A-Za-z0-9_/+-]+\])?"
HALF = r"(?:\s*([ap])\.?m\.?)?"
MARK = "\u0001"
FORMS = (
    # year first, with separators
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]\s*{TIME}{HALF}{ZONE})?$", f"{MARK}Y|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    # compact, year first
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{ZONE}$", f"{MARK}Y|$1|$2|$3|$4|$5|$6|$7||$8"),
    # numbers only, year last
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:,?[T ]\s*{TIME}{HALF}{ZONE})?$", f"{MARK}N|$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    # day, name of the month, year
    (rf"^(?:{WEEKDAY}\.?,? +)?(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -]*{MONTH_WORD}\.?,?[ -]*(\d{{4}})(?:,?(?: at| um)?[T ]\s*{TIME}(?: Uhr)?{HALF}{ZONE})?$", f"{MARK}M|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    # name of the month, day, year
    (rf"^(?:{WEEKDAY}\.?,? +)?{MONTH_WORD}\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})(?:,?(?: at)?[T ]\s*{TIME}{HALF}{ZONE})?$", f"{MARK}M|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
SECONDS = r"^\d{9,10}(\.\d{1,9})?\z"
MILLIS = r"^\d{12,13}(\.\d{1,6})?\z"

#: Candidate histories for sources without a zone that go before the other regions.
CANDIDATES = ("America/Los_Angeles", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney", "Europe/Berlin", "Europe/London")


def zone_names(spark: SparkSession) -> list[str]:
    """The region names this JVM knows (some six hundred, from its time zone data)."""
    return sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z or z in ("UTC", "GMT"))


def _rewritten(texts: Column) -> Column:
    """An array of one text, rewritten by the first form that matches; a text that is done passes the others unread."""

    def step(pattern: str, form: str):
        return lambda t: F.when(t.startswith(MARK), t).otherwise(F.regexp_replace(t, "(?i)" + pattern, form))

    for pattern, form in FORMS:
        texts = F.transform(texts, step(pattern, form))
    return texts


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _from_parts(p: Column, month_first: Column) -> Column:
    """(local, zone) of the parts kind, year, two of month and day, hour, minute, second, fraction, half of the day, zone."""
    kind, a, b = p[0], p[2], p[3]
    name = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(str(v)))])
    day_first = (kind == "N") & ~month_first
    month = F.when(kind == "M", F.try_element_at(name, F.lower(F.substring(p[2], 1, 3)))).when(day_first, b).otherwise(a)
    day = F.when(day_first, a).otherwise(b)
    zero = lambda c: F.when(c == "", "0").otherwise(c)
    shown = p[4].cast("int")
    half = F.when(shown.between(1, 12), (shown % 12 + F.when(p[8].isin("p", "P"), 12).otherwise(0)).cast("string"))
    hour = F.when(p[8] == "", zero(p[4])).otherwise(half)
    # One text in the writing that the cast reads fastest; it refuses impossible dates and times.
    text = F.concat(p[1], F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":"), zero(p[5]), F.lit(":"), zero(p[6]), F.lit("."), F.substring(F.concat(p[7], F.lit("0")), 1, 6), F.lit("Z"))
    local = F.unix_micros(text.try_cast("timestamp"))
    return F.struct(local.alias("local"), F.nullif(p[9], F.lit("")).alias("zone"))


def read_writing(df: DataFrame, text: str, locale: str | None) -> DataFrame:
    """Adds _local (wall-clock time as microseconds, as if it were UTC), _zone (as written), _exact (an instant that needs no zone)."""
    canonical = F.col(text).rlike(CANONICAL)
    month_first = F.coalesce(F.col(locale) == "en_US", F.lit(False)) if locale else F.lit(False)
    form = F.when(F.col(text).isNotNull() & ~canonical, _rewritten(F.array(strip(F.col(text)))))[0]
    df = bound(df, "_form", form)
    df = bound(df, "_part", F.when(F.col("_form").startswith(MARK), F.split(F.substring("_form", 2, 2**31 - 1), r"\|", -1)))
    df = bound(df, "_read", F.when(F.col("_part").isNotNull(), _from_parts(F.col("_part"), month_first)))
    other = F.col("_part").isNull() & F.col("_form").isNotNull()
    number = F.when(F.col("_form").rlike(SECONDS), F.col("_form").try_cast("decimal(30,9)") * 1_000_000).when(F.col("_form").rlike(MILLIS), F.col("_form").try_cast("decimal(30,9)") * 1000)
    exact = F.when(F.col("_form").isNull(), F.unix_micros(F.col(text).try_cast("timestamp"))).when(other, F.floor(number).cast("bigint"))
    df = bound(df, "_exact", exact)
    return df.withColumns({"_local": F.col("_read.local"), "_zone": F.col("_read.zone")}).drop("_read", "_part", "_form")


def _written_offset(zone: Column, row_zone: Column) -> Column:
    """Minutes east that the text itself gives: an offset or an abbreviation."""
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    hours, minutes = _number(F.substring(zone, 2, 2)), F.coalesce(_number(F.regexp_extract(zone, r"^[+-]\d{2}[:.]?(\d{2})", 1)), F.lit(0))
    numeric = F.when(zone.rlike(r"^[+-]\d") & (hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))
    fixed = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    special = F.coalesce(*[F.when((F.upper(zone) == a) & (row_zone == z), F.lit(v)) for (a, z), v in ABBREVIATIONS_OF_ZONE.items()])
    return F.coalesce(numeric, special, F.try_element_at(fixed, F.upper(zone)))


def _in_zone(local: Column, zone: Column) -> Column:
    """Wall-clock time in a region. Of a time that occurs twice the first; a skipped one by the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


DAY_US, MINUTE_US = 86_400_000_000, 60_000_000


def _period(local: Column, days: int) -> Column:
    return F.floor(local / F.lit(days * DAY_US)).cast("int")


def _aligned(rows: DataFrame, source: str, arrival: str, sequence: str | None, late_min: int, period_days: int) -> DataFrame:
    """(_source, _local, _low, _high): minutes from the local time to the earliest and latest instant it may stand for.

    A row's own arrival bounds it; without one, the arrivals before and after it in the source's sequence do. That
    window holds the rows of one source and a year, and only where a sequence is asked for.
    """
    at = F.unix_micros(F.col(arrival))
    rows = rows.select(F.col(source).alias("_source"), "_local", at.alias("_at"), *([F.col(sequence).alias("_seq")] if sequence else []))
    before = after = F.col("_at")
    if sequence:
        w = Window.partitionBy("_source", _period(F.col("_local"), 365)).orderBy("_seq")
        rows = rows.withColumns({"_before": F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.first("_at", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
        before, after = F.coalesce("_at", "_before"), F.coalesce("_at", "_after")
    minutes = lambda c: F.floor((c - F.col("_local")) / MINUTE_US).cast("int")
    return rows.select("_source", "_local", (minutes(before) - late_min).alias("_low"), minutes(after).alias("_high")).filter(F.col("_low").isNotNull() & F.col("_high").isNotNull())


def _history(zones: list[str], min_rows: int):
    """The function that finds one source's history from its violations per period and zone."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        periods, at = np.unique(rows["_period"].to_numpy(), return_inverse=True)
        shape = (len(periods), len(zones))
        rank = rows["_rank"].to_numpy()
        n, bad, late = (np.zeros(shape) for _ in range(3))
        for out, c in ((n, "n"), (bad, "violations"), (late, "late")):
            out[at, rank] = rows[c].to_numpy(float)
        # Of histories with as many violations, that nearest to the arrivals, then the first.
        cost = bad + 1e-3 * late / max(late.sum(axis=0).max(), 1) + 1e-9 * np.arange(len(zones))
        total, came = cost[0], np.zeros(shape, int)
        for p in range(1, len(periods)):
            best = int(np.argmin(total))
            change = total[best] + min_rows / 2 < total
            came[p] = np.where(change, best, np.arange(len(zones)))
            total = cost[p] + np.where(change, total[best] + min_rows / 2, total)
        chosen = np.zeros(len(periods), int)
        chosen[-1] = int(np.argmin(total))
        for p in range(len(periods) - 1, 0, -1):
            chosen[p - 1] = came[p][chosen[p]]
        out = []
        edges = [0, *(np.flatnonzero(np.diff(chosen)) + 1), len(periods)]
        for lo, hi in zip(edges, edges[1:]):
            z = chosen[lo]
            rows_in, base, own = n[lo:hi, z].sum(), bad[lo:hi, 0].sum(), bad[lo:hi, z].sum()
            if z and rows_in >= min_rows and base * 2 > rows_in and own * 2 < base:
                out += [(rows["_source"].iloc[0], int(p), zones[z]) for p in periods[lo:hi]]
        return pd.DataFrame(out, columns=["_source", "_when", "_guess"])

    return find


def estimate_zones(rows: DataFrame, source: str, arrival: str, default_zone: str = "UTC", candidates: Sequence[str] = CANDIDATES, min_rows: int = 20, slack_min: int = 2, late_min: int = 30, period_days: int = 7, sequence: str | None = None) -> DataFrame:
    """(_source, _when, _guess): sources and periods (of local time) that another zone than the default fits clearly better.

    A violation is an instant after its arrival (beyond slack_min), or over late_min before it: a history that is too
    far west puts instants into the future, one too far east puts all of them hours back. Rows are first counted by
    source, day and the minutes between local time and arrival, which merges map-side: a hot source sends its
    different days and lags. Only sources with at least min_rows violations in periods that the default mostly violates
    are held against the other zones, on those counts. The best history of such a source changes zone only where that
    saves min_rows / 2 violations (a shortest path over its periods and the zones). A stretch of it replaces the default
    with min_rows rows or more, of which the default violates over half, and twice as many as the history.
    """
    zones = [default_zone, *[z for z in dict.fromkeys(candidates) if z != default_zone]]
    folded = _aligned(rows, source, arrival, sequence, late_min, period_days).groupBy("_source", F.floor(F.col("_local") / DAY_US).alias("_day"), "_low", "_high").agg(F.count("*").alias("_c"))
    folded = sealed(folded)  # used twice; else the filter of the doubtful would go below the counts
    noon = F.col("_day") * DAY_US + DAY_US // 2

    def broken(east: Column) -> Column:
        """Whether an instant so many minutes before its local time lies outside its bounds."""
        return (-east < F.col("_low")) | (-east > F.col("_high") + slack_min)

    east = lambda zone: ((noon - _in_zone(noon, zone)) / MINUTE_US).cast("int")
    base = F.lit(0) if default_zone == "UTC" else east(F.lit(default_zone))
    own = folded.groupBy("_source", _period(noon, period_days).alias("_p")).agg(F.sum("_c").alias("n"), F.sum(F.when(broken(base), F.col("_c")).otherwise(0)).alias("v"))
    doubtful = own.filter(F.col("v") * 2 > F.col("n")).groupBy(F.col("_source").alias("_doubted")).agg(F.sum("v").alias("v")).filter(F.col("v") >= min_rows).select("_doubted")
    table = rows.sparkSession.createDataFrame(list(enumerate(zones)), "_rank int, _zone string")
    each = folded.join(doubtful, F.col("_source") == F.col("_doubted")).crossJoin(F.broadcast(table)).withColumn("_east", east(F.col("_zone")))
    counts = each.groupBy("_source", _period(noon, period_days).alias("_period"), "_rank").agg(
        F.sum("_c").alias("n"), F.sum(F.when(broken(F.col("_east")), F.col("_c")).otherwise(0)).alias("violations"), F.sum(F.when(~broken(F.col("_east")), F.abs(F.col("_high") + F.col("_east")) * F.col("_c")).otherwise(0)).alias("late")
    )
    kind = dict(rows.dtypes)[source]
    return counts.groupBy("_source").applyInPandas(_history(zones, min_rows), f"_source {kind}, _when int, _guess string")


def normalise_timestamps(df: DataFrame, text: str = "date", zone: str | None = "time_zone", locale: str | None = "locale", arrival: str | None = "received_at", source: str | None = "user_id", default_zone: str = "UTC", out: str = "utc_us", estimate: bool = True, sequence: str | None = None, period_days: int = 7) -> DataFrame:
    """df with `out`: microseconds since 1970 UTC, null where the text is no real date.

    Defined results: null, blank, non-date text and impossible dates or times give null; parts not written are zero;
    an unknown zone in the zone column counts as none; an unknown zone in the text gives null; null locale reads the
    day first; a null source takes no part in the estimate and falls back to default_zone, and so does a null arrival
    unless `sequence` names a column by which a source's rows are in order. Repeated rows each get their instant. Columns of df are kept as they are, whatever their names; a column named `out` is replaced.
    Only rows without any zone are shuffled.
    """
    used = [c for c in (text, zone, locale, *((arrival, source, sequence) if estimate else ())) if c]
    need(df, used)
    columns, given_out, out = df.columns, out, "_out"
    df = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    text, zone, locale, arrival, source, sequence = (f"_c{columns.index(c)}" if c in used else None for c in (text, zone, locale, arrival, source, sequence))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c.lower() != given_out.lower()], F.col(out).alias(given_out))

    known = F.lit(False)
    row_zone = F.lit(None).cast("string")
    if zone:
        known = F.col(zone).isin(zone_names(df.sparkSession))
        row_zone = F.when(known, F.col(zone))
    written = F.col("_zone")
    names = zone_names(df.sparkSession)

    # The instant by the zone in the text. An offset before a bracketed region goes before the region.
    region = F.regexp_extract(written, r"\[(.+)\]$", 1)
    offset = _written_offset(F.regexp_replace(written, r" ?\[.+\]$", ""), F.col("_row_zone"))
    by_text = F.when(written.startswith("["), F.when(region.isin(names), _in_zone(F.col("_local"), region))).otherwise(F.col("_local") - offset.cast("bigint") * 60_000_000)

    helpers = ("_local", "_zone", "_exact", "_row_zone")

    def instant(rows: DataFrame, fallback: Column) -> DataFrame:
        z = F.coalesce(F.col("_row_zone"), fallback)
        got = F.coalesce(F.col("_exact"), F.when(written.isNotNull(), by_text).otherwise(_in_zone(F.col("_local"), z)))
        return bound(rows, out, got).drop(*helpers)

    def read(rows: DataFrame) -> DataFrame:
        return read_writing(rows.withColumn("_row_zone", row_zone), text, locale)

    default = F.lit(default_zone)
    if not (estimate and arrival and source):
        return named(instant(read(df), default))
    # Only rows whose zone column tells nothing can need an estimate; they are told apart before anything is parsed.
    told = F.coalesce(known, F.lit(False))
    apart = read(df.filter(~told))
    zoneless = F.col("_exact").isNull() & F.col("_local").isNotNull() & written.isNull()
    guess = estimate_zones(apart.filter(zoneless & F.col(source).isNotNull()), source, arrival, default_zone, [*CANDIDATES, *names], period_days=period_days, sequence=sequence)
    fits = (F.col(source) == F.col("_source")) & (_period(F.col("_local"), period_days) == F.col("_when"))
    open_rows = instant(apart.join(guess, fits, "left"), F.coalesce(F.col("_guess"), default)).drop("_source", "_when", "_guess")
    return named(instant(read(df.filter(told)), default).unionByName(open_rows))


def is_canonical(text: Column) -> Column:
    """Whether a text is already written as YYYY-MM-DD HH:MM:SS.ffffff+00:00."""
    return F.coalesce(text.rlike(CANONICAL), F.lit(False))


__all__ = ["CANDIDATES", "estimate_zones", "is_canonical", "normalise_timestamps", "read_writing"]
