"""Expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, whatever kind of white space it is."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def entity_key(c: Column) -> Column:
    """A reference as it is compared: trimmed and in lower case; null where nothing is left."""
    plain = c.rlike(r"^[0-9a-z]+\z")
    key = F.when(plain, c).otherwise(F.lower(strip(c)))
    return F.nullif(key, F.lit(""))


def day_of(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def month_of(ts: Column) -> Column:
    """YYYY-MM of an instant in UTC."""
    return F.date_format(day_of(ts), "yyyy-MM")


def fresh(df: DataFrame | Iterable[str], name: str) -> str:
    """`name`, lengthened until no column of df has it (Spark's names ignore case)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name = "_" + name
    return name


def exact(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df narrowed to the columns of exactly these names, the first of each, whatever else clashes with them."""
    names = list(dict.fromkeys(names))
    need(df, names)
    columns = df.columns
    by_place = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return by_place.select(*[F.col(f"_c{columns.index(n)}").alias(n) for n in names])


def need(df: DataFrame, columns: Iterable[str]) -> None:
    """Raises where a column that an operator needs is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are absent; there are {df.columns}")


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row.

    A generator of one row, which filters above it can't be pushed through; pushing them would copy a costly
    expression into each filter that mentions its result.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def sealed(df: DataFrame) -> DataFrame:
    """df behind a one-row generator of all its columns, so that plans that use it in several ways keep it alike and share its shuffles."""
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_sealed")).select("_sealed.*")
