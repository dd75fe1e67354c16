"""Joins of two tables with fills and validity flags, and helpers on foreign keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.common import fresh, need
from cohortloom.operators.order import number_rows
from cohortloom.types import zero_of

#: Row numbers from here on stand for keys that don't exist.
INVALID_INDEX = 1 << 62

HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full", "cross": "cross"}


def _list(x: Sequence[str] | str) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def merge(
    left: DataFrame, right: DataFrame, left_on: Sequence[str] | str = (), right_on: Sequence[str] | str = (), how: str = "left",
    left_fields: Sequence[str] | None = None, right_fields: Sequence[str] | None = None, left_suffix: str = "_l", right_suffix: str = "_r",
    fill: str = "zero", hint: str | None = None,
) -> DataFrame:
    """Joins two tables on one or more equal keys.

    Names on both sides get the suffixes. Where a side may lack a row, its fields are filled by the zero of their type
    ('' for text; or null with fill='null'), and valid_l or valid_r tells whether the row was there. Null keys match
    nothing. `hint` passes a strategy on to the optimizer ('merge', 'shuffle_hash'); without one it chooses by size,
    and splits skewed partitions. 'cross' pairs all rows and takes no keys.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    left_on, right_on = _list(left_on), _list(right_on)
    if how == "cross":
        if left_on or right_on:
            raise ValueError("a cross merge takes no keys")
    elif not left_on or len(left_on) != len(right_on):
        raise ValueError("both sides need the same number of keys")
    need(left, left_on)
    need(right, right_on)
    lf = _list(left_fields) if left_fields is not None else left.columns
    rf = _list(right_fields) if right_fields is not None else right.columns
    need(left, lf)
    need(right, rf)
    both = {c.lower() for c in lf} & {c.lower() for c in rf}
    l = left.select(*[F.col(c).alias(f"_lk{i}") for i, c in enumerate(left_on)], *[F.col(c).alias(f"_lf{i}") for i, c in enumerate(lf)], F.lit(True).alias("_lthere"))
    r = right.select(*[F.col(c).alias(f"_rk{i}") for i, c in enumerate(right_on)], *[F.col(c).alias(f"_rf{i}") for i, c in enumerate(rf)], F.lit(True).alias("_rthere"))
    if hint:
        r = r.hint(hint)
    joined = l.crossJoin(r) if how == "cross" else l.join(r, [F.col(f"_lk{i}") == F.col(f"_rk{i}") for i in range(len(left_on))], HOW[how])
    open_left, open_right = how in ("right", "outer"), how in ("left", "outer")
    out = []
    for side, fields, source, may_lack, suffix in (("l", lf, left, open_left, left_suffix), ("r", rf, right, open_right, right_suffix)):
        for i, name in enumerate(fields):
            c = F.col(f"_{side}f{i}")
            if may_lack and fill == "zero":
                c = F.when(F.col(f"_{side}there").isNotNull(), c).otherwise(zero_of(source.schema[name].dataType))
            out.append(c.alias(name + suffix if name.lower() in both else name))
        if may_lack:
            out.append(F.col(f"_{side}there").isNotNull().alias(f"valid_{side}"))
    return joined.select(*out)


def ordered_merge_left(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_unique: bool = False, **more) -> DataFrame:
    """A left merge onto a key declared unique, which is checked while it runs: a repeated key raises."""
    if not right_unique:
        raise ValueError("the right key must be declared unique")
    return merge(left, assert_unique(right, right_on), left_on, right_on, "left", hint="merge", **more)


def ordered_merge_right(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_unique: bool = False, **more) -> DataFrame:
    """A right merge onto a left key declared unique, checked while it runs."""
    if not left_unique:
        raise ValueError("the left key must be declared unique")
    return merge(assert_unique(left, left_on), right, left_on, right_on, "right", hint="merge", **more)


def ordered_merge_inner(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_unique: bool = False, right_unique: bool = False, **more) -> DataFrame:
    """An inner merge; the keys that are declared unique are checked while it runs."""
    l = assert_unique(left, left_on) if left_unique else left
    r = assert_unique(right, right_on) if right_unique else right
    return merge(l, r, left_on, right_on, "inner", hint="merge", **more)


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, raising at run time where a key repeats."""
    n = fresh(df, "_count")
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_unique_key")).agg(F.count("*").alias(n))
    checked = df.join(counts, F.col(key) == F.col("_unique_key"), "left")
    return checked.filter(F.when(F.col(n) > 1, F.raise_error(F.lit("a key that was declared unique repeats")).cast("boolean")).otherwise(True)).drop(n, "_unique_key")


def key_exists(foreign: DataFrame, primary: DataFrame, foreign_key: str, primary_key: str, name: str = "exists") -> DataFrame:
    """foreign with whether its key is among the primary keys; null is in none."""
    known = primary.select(F.col(primary_key).alias("_pk")).distinct()
    return foreign.join(known, F.col(foreign_key) == F.col("_pk"), "left").withColumn(name, F.col("_pk").isNotNull()).drop("_pk")


def get_index(foreign: DataFrame, primary: DataFrame, foreign_key: str, primary_key: str, foreign_row: str, primary_row: str, name: str = "index") -> DataFrame:
    """foreign with the row number of its key in primary; of repeated keys the last row counts.

    Keys that don't exist get 2**62, 2**62 + 1, ... by their first appearance.
    """
    places = primary.filter(F.col(primary_key).isNotNull()).groupBy(F.col(primary_key).alias("_pk")).agg(F.max(primary_row).cast("bigint").alias("_at"))
    seen = foreign.groupBy(F.col(foreign_key).alias("_mk")).agg(F.min(foreign_row).alias("_seen"))
    missing = seen.join(places, F.col("_mk") == F.col("_pk"), "left_anti")
    numbered = number_rows(missing, [F.col("_seen")], "_new").select(F.col("_mk").alias("_pk"), (F.lit(INVALID_INDEX) + F.col("_new")).alias("_at"))
    return foreign.join(places.union(numbered), F.col(foreign_key).eqNullSafe(F.col("_pk")), "left").withColumn(name, F.col("_at")).drop("_at", "_pk")


def shared_index(columns: Sequence[tuple[DataFrame, str]], name: str = "shared_index") -> list[DataFrame]:
    """Each table with the place of its key among the sorted distinct keys of all tables."""
    keys = columns[0][0].select(F.col(columns[0][1]).alias("_key"))
    for df, c in columns[1:]:
        keys = keys.union(df.select(F.col(c)))
    places = number_rows(keys.distinct(), [F.col("_key")], name)
    return [df.join(places, F.col(c).eqNullSafe(F.col("_key")), "left").drop("_key") for df, c in columns]


def join_by_row(destination: DataFrame, source: DataFrame, row: str, index: str, value: str, order: str, name: str | None = None) -> DataFrame:
    """destination with a value of the source row whose `index` is its row number, 0 where there is none.

    Of several source rows the last by `order` counts; indices of 2**62 and above point nowhere.
    """
    per = source.filter(F.col(index) < INVALID_INDEX).groupBy(F.col(index).alias("_to")).agg(F.max_by(value, order).alias("_value"))
    zero = zero_of(source.schema[value].dataType)
    return destination.join(per, F.col(row) == F.col("_to"), "left").withColumn(name or value, F.coalesce("_value", zero)).drop("_to", "_value")
