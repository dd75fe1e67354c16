"""Missing values filled from similar records, by group statistics from fine groups to coarse ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.functions.common import day_of, entity_key, exact, need, sealed


def _median(folded: DataFrame, names: Sequence[str], wide: bool) -> DataFrame:
    """(names, _stat, _n) of (names, _v, _c).

    Few wide groups take a mergeable histogram of their different values; many fine ones a window over these.
    """
    if wide:
        return folded.groupBy(*names).agg(F.percentile("_v", F.lit(0.5), F.col("_c")).alias("_stat"), F.sum("_c").alias("_n"))
    group = Window.partitionBy(*names)
    ranked = folded.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).withColumn("_all", F.sum("_c").over(group))
    low, high = F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("_v"))), F.min(F.when(F.col("_upto") * 2 > F.col("_all"), F.col("_v")))
    return ranked.groupBy(*names).agg(((low + high) / 2).alias("_stat"), F.sum("_c").alias("_n"))


def _mode(folded: DataFrame, names: Sequence[str]) -> DataFrame:
    return folded.groupBy(*names).agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias("_stat"), F.sum("_c").alias("_n"))


@dataclass(frozen=True)
class Level:
    """A grouping that may fill: its name, its keys, and the number of present values it must have."""

    name: str
    keys: tuple[Column, ...]
    support: int = 1


def missing_number(c: Column) -> Column:
    """Null, NaN, or a number that only stands for "not measured": zero or below, 900 or above."""
    return c.isNull() | F.isnan(c.cast("double")) | (c <= 0) | (c >= 900)


def fill_missing(df: DataFrame, record: str, value: str | Sequence[str], levels: Sequence[Level], missing: Callable[[Column], Column] | None = None, kind: str = "median", decimals: int = 2, keep: Sequence[str] = (), only_missing: bool = False, together: int = 0) -> DataFrame:
    """(record, *keep, [field,] original, filled, is_filled, filled_from): the values of df with the missing ones filled.

    A missing value takes the median (numbers) or mode (categories) of its group at the first level whose group has
    enough present values; groups with a null key fill nothing. `is_filled` marks what was filled, `filled_from` names
    the level, or is 'none' where no level could (then `filled` is null). Medians are of values rounded to `decimals`.
    Several numeric fields are filled in one pass: `field` names each, and values come as double. Values are counted
    per group of all keys first, which merges map-side; every level is folded from those counts, so a hot group is no
    larger than its number of different values. `together` leading levels are laid out by the keys of the last of them,
    which must be among those of the others, and so share one shuffle. Only the missing rows are joined with the
    statistics. Rows that are equal in all columns used count once; ties of a mode go to the smallest value; an empty
    table gives none.
    """
    fields = [value] if isinstance(value, str) else list(value)
    need(df, [record, *fields, *keep])
    types = dict(df.dtypes)
    whole = [f for f in fields if types[f] in ("tinyint", "smallint", "int", "bigint")]
    # An expression that several levels use becomes one column.
    columns: dict[int, tuple[str, Column]] = {}
    for level in levels:
        for c in level.keys:
            columns.setdefault(id(c), (f"_k{len(columns)}", c))
    keys = [n for n, _ in columns.values()]
    if isinstance(value, str):
        values = [F.lit(value).alias("_field"), F.col(value).alias("_value")]
    else:
        values = [F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f).cast("double").alias("_value")) for f in fields]))]
    base = df.select(F.col(record).alias("_record"), *values, *[c.alias(n) for n, c in columns.values()], *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = base.distinct()
    gone = missing(F.col("_value")) if missing is not None else missing_number(F.col("_value")) if kind == "median" else F.col("_value").isNull()
    gone = F.coalesce(gone, F.lit(True))
    # Sealed, as a literal field would be folded away, and with it the key by which a level of all rows is joined.
    present, absent = base.filter(~gone), sealed(base.filter(gone))
    number = F.col("_value").cast("double")
    number = number if len(whole) == len(fields) else F.round(number, decimals)
    filled = absent
    choices = []
    v = number if kind == "median" else F.col("_value")
    counted = present.select("_field", *keys, v.alias("_v")).groupBy("_field", *keys, "_v").agg(F.count("*").alias("_c"))
    counted = sealed(counted)  # else each level's filters would go below the counts, and none could be shared
    laid = counted.repartition("_field", *[columns[id(c)][0] for c in levels[together - 1].keys]) if together else counted
    for i, level in enumerate(levels):
        names = ["_field", *[columns[id(c)][0] for c in level.keys]]
        folded = laid if i < together else counted.groupBy(*names, "_v").agg(F.sum("_c").alias("_c"))
        stat = (_median(folded, names, not level.keys) if kind == "median" else _mode(folded, names)).withColumnRenamed("_stat", f"_s{i}")
        stat = stat.filter(F.col("_n") >= level.support).select(*[F.col(n).alias(f"{n}_r") for n in names], f"_s{i}")
        stat = stat if level.keys else F.broadcast(stat)  # a row for each field
        filled = filled.join(stat, [F.col(n) == F.col(f"{n}_r") for n in names], "left").drop(*[f"{n}_r" for n in names])
        choices.append((level.name, F.col(f"_s{i}")))
    got = F.coalesce(*[c for _, c in choices])
    if kind == "median" and whole:
        got = F.when(F.col("_field").isin(whole), F.round(got)).otherwise(got)
    if isinstance(value, str):
        got = got.cast(types[value])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in choices], F.lit("none"))
    front = [F.col("_record").alias(record), *[F.col(f"_keep_{c}").alias(c) for c in keep], *([] if isinstance(value, str) else [F.col("_field").alias("field")]), F.col("_value").alias("original")]
    out = filled.select(*front, got.alias("filled"), F.lit(True).alias("is_filled"), source.alias("filled_from"))
    if only_missing:
        return out
    same = present.select(*front, F.col("_value").alias("filled"), F.lit(False).alias("is_filled"), F.lit("self").alias("filled_from"))
    return same.unionByName(out)


def _decade(c: Column) -> Column:
    return F.floor(c / 10)


def user_levels(support: int = 20) -> tuple[Level, ...]:
    """Comparable users: same decade of birth, diabetes and area; then without area; then the decade; then all."""
    born = _decade(F.col("year_of_birth"))
    return (
        Level("decade, diabetes and area", (born, F.col("has_diabetes"), F.col("lsoa11cd")), support),
        Level("decade and diabetes", (born, F.col("has_diabetes")), support),
        Level("decade", (born,), support),
        Level("all", (), 1),
    )


def temperature_levels(support: int = 3) -> tuple[Level, ...]:
    """Readings of the same user in the month, then of the same user, then of the month, then all."""
    at = day_of(F.col("received_at"))
    user, month = entity_key(F.col("user_id")), (F.year(at) * 12 + F.month(at)).cast("int")
    return (
        Level("user and month", (user, month), support),
        Level("user", (user,), support),
        Level("month", (month,), 20),
        Level("all", (), 1),
    )


def fill_users(users: DataFrame, field: str | Sequence[str], only_missing: bool = False) -> DataFrame:
    fields = [field] if isinstance(field, str) else list(field)
    return fill_missing(exact(users, ("id", *fields, "year_of_birth", "has_diabetes", "lsoa11cd")), "id", field, user_levels(), only_missing=only_missing)


def fill_diabetes(users: DataFrame, only_missing: bool = False) -> DataFrame:
    """The codes of has_diabetes, of which null and 0 are missing, by the mode of the decade and area, of the decade, of all."""
    born = _decade(F.col("year_of_birth"))
    levels = (Level("decade and area", (born, F.col("lsoa11cd")), 20), Level("decade", (born,), 20), Level("all", (), 1))
    return fill_missing(exact(users, ("id", "has_diabetes", "year_of_birth", "lsoa11cd")), "id", "has_diabetes", levels, missing=lambda c: c.isNull() | (c == 0), kind="mode", only_missing=only_missing)


def fill_temperatures(assessments: DataFrame, only_missing: bool = False) -> DataFrame:
    return fill_missing(exact(assessments, ("id", "temperature_f", "user_id", "received_at")), "id", "temperature_f", temperature_levels(), only_missing=only_missing, together=2)
