"""Columns and rows of one table: filters, predicates, renaming, casting, categories."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.arithmetic import wrap
from cohortloom.functions.common import fresh, need
from cohortloom.types import Kind, NUMERIC


def apply_filter(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that fulfil a condition; a number counts as true where it isn't zero."""
    c = F.col(condition) if isinstance(condition, str) else condition
    kind = df.select(c.alias("_c")).schema[0].dataType.typeName()
    if kind == "boolean":
        return df.filter(c)
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return df.filter(c != 0)
    raise ValueError(f"a {kind} can't be a filter")


def isin(c: Column, elements: Iterable) -> Column:
    """Membership; nulls among the elements are passed over, and no element gives false."""
    if elements is None:
        raise TypeError("elements must not be None")
    found = [e for e in elements if e is not None]
    return F.coalesce(c.isin(found), F.lit(False)) if found else F.lit(False)


def flag_failures(c: Column, missing: int, bad: int, is_type: Callable[[Column], Column], valid: Callable[[Column], Column], flags: Column | None = None) -> Column:
    """Bit flags of a field: `missing` where it is null or not of its type, `bad` where it is of its type but not valid."""
    typed = F.coalesce(is_type(c), F.lit(False))
    flag = F.when(~typed, missing).when(~F.coalesce(valid(c), F.lit(False)), bad).otherwise(0)
    return flag if flags is None else flags.bitwiseOR(flag)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """All at once, so that names may be swapped; clashes raise and nothing is renamed."""
    need(df, names)
    new = [names.get(c, c) for c in df.columns]
    twice = {c for c in new if [x.lower() for x in new].count(c.lower()) > 1}
    if twice:
        raise ValueError(f"these names would occur twice: {sorted(twice)}")
    return df.toDF(*new)


def drop(df: DataFrame, *names: str) -> DataFrame:
    need(df, names)
    return df.drop(*names)


def assign(df: DataFrame, name: str, value: Column, kind: Kind | None = None) -> DataFrame:
    """A column put in or replaced; with a kind it is cast to it and keeps it as metadata."""
    if kind is None:
        return df.withColumn(name, value)
    return df.select(*[F.col(c) for c in df.columns if c.lower() != name.lower()], value.cast(kind.spark).alias(name, metadata=kind.metadata()))


def empty_like(df: DataFrame, *names: str) -> DataFrame:
    """No rows, but columns of the names and kinds of df's (all, or those named)."""
    need(df, names)
    return (df.select(*names) if names else df).limit(0)


def copy_column(source: DataFrame, name: str, target: DataFrame, row: str, to: str | None = None) -> DataFrame:
    """target with a column of source, kind and all, by equal row numbers; null where source has no such row, a row for each where it has several. A column of that name is replaced."""
    need(source, [name, row])
    need(target, [row])
    kind = source.schema[name].metadata or {}
    at, copied = fresh(target, "_row"), fresh(target, "_copied")
    own = source.select(F.col(row).alias(at), F.col(name).alias(copied))
    kept = [F.col(c) for c in target.columns if c.lower() != (to or name).lower() or c == row]
    return target.join(own, F.col(row) == F.col(at), "left").select(*kept, F.col(copied).alias(to or name, metadata=kind))


def move_column(source: DataFrame, name: str, target: DataFrame, row: str, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(source without the column, target with it)."""
    return drop(source, name), copy_column(source, name, target, row, to)


def astype(df: DataFrame, name: str, nformat: str) -> DataFrame:
    """A numeric column in another format, unchecked: whole numbers wrap around, floats are cut towards zero first."""
    if nformat not in NUMERIC:
        raise ValueError(f"unknown format {nformat}")
    source = dict(df.dtypes)[name]
    c = F.col(name)
    if source == "boolean":
        c = c.cast("int")
    if source in ("float", "double") and nformat not in ("float32", "float64", "bool"):
        c = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    return df.withColumn(name, wrap(c, nformat))


def remap(df: DataFrame, name: str, pairs: Sequence[tuple[int, int]], labels: Mapping[str, int]) -> DataFrame:
    """Category codes exchanged and relabelled. Codes of the old labels that no pair maps raise."""
    field = df.schema[name]
    old = Kind.of(field)
    missing = set(old.labels.values()) - {a for a, _ in pairs}
    if missing:
        raise ValueError(f"codes {sorted(missing)} aren't mapped")
    mapping = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return assign(df, name, F.try_element_at(mapping, F.col(name).cast("int")), Kind("categorical", old.nformat or "int8", 0, dict(labels)))


def keys(df: DataFrame, name: str) -> dict[int, str]:
    """Code to label of a categorical column."""
    return {v: k for k, v in Kind.of(df.schema[name]).labels.items()}


def encode_categories(c: Column, labels: Mapping[str, int], strict: bool = False, nformat: str = "int8") -> Column:
    """Codes of labels, matched exactly; others, and null, are 0, or raise if strict."""
    code = F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(c, F.lit("")))
    other = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(c, F.lit("null")))).cast("int") if strict else F.lit(0)
    return F.coalesce(code, other).cast(NUMERIC[nformat])


def encode_leaky(c: Column, labels: Mapping[str, int], nformat: str = "int8") -> tuple[Column, Column]:
    """Codes, -1 for unknown labels, and the unknown labels as free text ('' elsewhere)."""
    text = F.coalesce(c, F.lit(""))
    code = F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), text)
    return F.coalesce(code, F.lit(-1)).cast(NUMERIC[nformat]), F.when(code.isNull(), text).otherwise("")


def first_occurrence(df: DataFrame, key: str, row: str, name: str = "is_first") -> DataFrame:
    """df with whether a row is the first of its key: by the key's least row number, not by a window over hot keys."""
    first = df.groupBy(key).agg(F.min(row).alias("_first")).select("_first")
    return df.join(first, F.col(row) == F.col("_first"), "left").withColumn(name, F.col("_first").isNotNull()).drop("_first")
