"""Group-by aggregates, distinct values, histograms and summary statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortloom.functions.common import need
from cohortloom.operators.order import _laid_out, number_rows
from cohortloom.types import Kind


class GroupBy:
    """Aggregates per group of equal keys. Null keys form a group of their own.

    `order` names the columns that say which row is first and last; it must settle all ties.
    """

    def __init__(self, df: DataFrame, by: Sequence[str] | str, order: Sequence[str] = ()):
        self.df, self.by, self.order = df, [by] if isinstance(by, str) else list(by), list(order)
        need(df, [*self.by, *self.order])

    def _agg(self, *aggregates: Column, write_keys: bool = True) -> DataFrame:
        out = self.df.groupBy(*self.by).agg(*aggregates)
        return out if write_keys else out.drop(*self.by)

    def _targets(self, target: Sequence[str] | str) -> list[str]:
        targets = [target] if isinstance(target, str) else list(target)
        need(self.df, targets)
        if set(targets) & set(self.by):
            raise ValueError("a target can't be a key")
        return targets

    def count(self, write_keys: bool = True) -> DataFrame:
        return self._agg(F.count("*").alias("count"), write_keys=write_keys)

    def distinct(self) -> DataFrame:
        return self.df.select(*self.by).distinct()

    def max(self, target: Sequence[str] | str, write_keys: bool = True) -> DataFrame:
        return self._agg(*[F.max(t).alias(f"{t}_max") for t in self._targets(target)], write_keys=write_keys)

    def min(self, target: Sequence[str] | str, write_keys: bool = True) -> DataFrame:
        return self._agg(*[F.min(t).alias(f"{t}_min") for t in self._targets(target)], write_keys=write_keys)

    def _ordered(self) -> Column:
        if not self.order:
            raise ValueError("first and last need an order")
        return F.struct(*self.order)

    def first(self, target: Sequence[str] | str, write_keys: bool = True) -> DataFrame:
        o = self._ordered()
        return self._agg(*[F.min_by(t, o).alias(f"{t}_first") for t in self._targets(target)], write_keys=write_keys)

    def last(self, target: Sequence[str] | str, write_keys: bool = True) -> DataFrame:
        o = self._ordered()
        return self._agg(*[F.max_by(t, o).alias(f"{t}_last") for t in self._targets(target)], write_keys=write_keys)


def drop_duplicates(df: DataFrame, by: Sequence[str] | str) -> DataFrame:
    """The distinct keys; other columns are dropped."""
    return GroupBy(df, by).distinct()


def unique(df: DataFrame, column: str, row: str | None = None) -> DataFrame:
    """(value, [first_index,] inverse, count): distinct values; `inverse` is the place among the sorted values."""
    parts = [F.count("*").alias("count")] + ([F.min(row).alias("first_index")] if row else [])
    per = df.groupBy(F.col(column).alias("value")).agg(*parts)
    return number_rows(per, [F.col("value")], "inverse")


def with_inverse(df: DataFrame, column: str, name: str = "inverse") -> DataFrame:
    """df with the place of each value among the sorted distinct values."""
    places = unique(df, column).select(F.col("value").alias("_value"), F.col("inverse").alias(name))
    return df.join(places, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def histogram(df: DataFrame, value: Column, name: str = "value", where: Column | None = None) -> DataFrame:
    """Counts of a column, or of an expression of it, over the rows that are kept."""
    kept = df if where is None else df.filter(where)
    return kept.groupBy(value.alias(name)).agg(F.count("*").alias("count"))


def count_flags(df: DataFrame, flags: str, mask: int) -> DataFrame:
    """(n_empty, n_set, n_not_set): rows without any flag, with one of the mask, and without."""
    hit = F.col(flags).bitwiseAND(F.lit(mask)) != 0
    return df.agg(F.count_if(F.col(flags) == 0).alias("n_empty"), F.count_if(hit).alias("n_set"), F.count_if(~hit).alias("n_not_set"))


def aggregate_custom(df: DataFrame, key: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of one's own over each group as a pandas frame; a group must fit into a task's memory."""
    return df.groupBy(*key).applyInPandas(function, schema)


def exact_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(field, q0, q1, ...): interpolated quantiles of the values of numeric columns that are neither null nor NaN.

    Values are counted first, so that a hot one is one row, and the counts of all columns pass one distributed sort.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_f"), F.col(c).cast("double").alias("_val")) for k, c in enumerate(columns)])).alias("_x")).select("_x.*")
    counts = values.filter(F.col("_val").isNotNull() & ~F.isnan("_val")).groupBy("_f", "_val").agg(F.count("*").alias("_count"))
    laid, _ = _laid_out(counts, [F.col("_f"), F.col("_val")])
    within = laid.withColumn("_so_far", F.sum("_count").over(Window.partitionBy("_pid", "_f").orderBy("_n")))
    sums = laid.groupBy(F.col("_pid").alias("_p"), F.col("_f").alias("_field")).agg(F.sum("_count").alias("_own"))  # a row for each partition and column
    w = Window.partitionBy("_field")
    seams = sums.select("_p", "_field", (F.sum("_own").over(w.orderBy("_p")) - F.col("_own")).alias("_base"), F.sum("_own").over(w).alias("_total"))
    both = within.join(F.broadcast(seams), (F.col("_pid") == F.col("_p")) & (F.col("_f") == F.col("_field"))).withColumn("_to", F.col("_base") + F.col("_so_far"))
    out = []
    for i, q in enumerate(fractions):
        at = F.lit(q) * (F.col("_total") - 1)
        low = F.floor(at)
        inside = lambda k: (F.col("_to") > k) & (F.col("_to") - F.col("_count") <= k)
        share = F.when(inside(low), 1 - (at - low)).otherwise(0) + F.when(inside(low + 1), at - low).otherwise(0)
        out.append(F.sum(share * F.col("_val")).alias(f"q{i}"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_f") + 1)
    return both.groupBy("_f").agg(*out).select(name.alias("field"), *[f"q{i}" for i in range(len(fractions))])


def _chosen(df: DataFrame, which, said: str) -> list[str]:
    """The columns that a name, 'all', a type (a class of pyspark.sql.types) or a list of either stands for."""
    if which == "all":
        return df.columns
    wanted = [which] if isinstance(which, (str, type)) else list(which)
    names = [w for w in wanted if isinstance(w, str)]
    kinds = tuple(w for w in wanted if isinstance(w, type))
    if len(names) + len(kinds) != len(wanted) or names and kinds:
        raise ValueError(f"{said} takes names or types")
    found = [f.name for f in df.schema.fields if f.name in names or kinds and isinstance(f.dataType, kinds)]
    if not found and said == "include":
        raise ValueError("no such field")
    return found


def describe(df: DataFrame, include=None, exclude=None, true_quartiles: bool = False) -> DataFrame:
    """(field, count, unique, top, freq, mean, std, min, 25%, 50%, 75%, max), all as text, numbers with two decimals.

    Without `include` all numeric and timestamp fields are described. Both take a field's name, a list of names, a type
    of pyspark.sql.types or a list of them, include also 'all'; names can't be excluded from names, nor types from
    types. Numbers, truth values and timestamps (as seconds since 1970) have moments (population deviation) and
    quantiles; text, and categories by their codes, have unique, top (of ties the smallest) and freq. Quantiles are by
    default those at 0.25, 0.5 and 0.75 per cent; `true_quartiles` takes the quartiles. Where a NaN is among the values
    all figures but the count are NaN. An empty table gives counts of 0 and nulls. All numeric fields together take one
    pass for the moments and one for the quantiles.
    """
    if include is not None and exclude is not None and include != "all":
        kind = lambda x: isinstance(x if isinstance(x, (str, type)) else next(iter(x)), str)
        if kind(include) == kind(exclude):
            raise ValueError("names can't be excluded from names, nor types from types")
    measured = lambda f: Kind.of(f).name in ("numeric", "timestamp") and isinstance(f.dataType, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType))
    names = [f.name for f in df.schema.fields if measured(f)] if include is None else _chosen(df, include, "include")
    gone = set(_chosen(df, exclude, "exclude")) if exclude is not None else set()
    fields = [f for f in df.schema.fields if f.name in names and f.name not in gone]
    if not fields:
        raise ValueError("no field to describe")
    show = lambda c: F.when(F.isnan(c), "NaN").otherwise(F.call_function("format_number", c, F.lit("0.00")))
    fractions = (0.25, 0.5, 0.75) if true_quartiles else (0.0025, 0.005, 0.0075)
    heads, tails = ("count", "unique", "top", "freq", "mean", "std", "min"), ("25%", "50%", "75%")
    null = F.lit(None).cast("string")
    parts = []
    numbers = [f for f in fields if measured(f)]
    if numbers:

        def seconds(f: T.StructField) -> Column:
            c = F.col(f.name)
            if isinstance(f.dataType, T.BooleanType):
                return c.cast("int").cast("double")
            return F.unix_micros(c.cast("timestamp")) / 1e6 if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else c.cast("double")

        v = df.select(*[seconds(f).alias(f"_v{k}") for k, f in enumerate(numbers)])
        moments = v.agg(F.array(*[F.struct(F.lit(f.name).alias("field"), F.count(c := f"_v{k}").alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")) for k, f in enumerate(numbers)]).alias("x"))
        moments = moments.select(F.explode("x").alias("x")).select("x.*")
        q = exact_quantiles(v.toDF(*[f.name for f in numbers]), [f.name for f in numbers], fractions).withColumnRenamed("field", "_qf")
        both = moments.join(F.broadcast(q), F.col("field") == F.col("_qf"), "left")  # a row for each field
        tell = lambda c: show(F.when(F.isnan("mean"), F.lit(float("nan"))).otherwise(F.col(c)))
        parts.append(both.select("field", F.col("n").cast("string").alias("count"), *[null.alias(x) for x in heads[1:4]], tell("mean").alias("mean"), tell("std").alias("std"), tell("lo").alias("min"), *[tell(f"q{i}").alias(t) for i, t in enumerate(tails)], tell("hi").alias("max")))
    for f in fields:
        if measured(f):
            continue
        per = df.groupBy(F.col(f.name).alias("_v")).agg(F.count("*").alias("_n")).filter("_v is not null")
        one = per.agg(F.sum("_n").alias("count"), F.count("*").alias("unique"), F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("top"), F.max("_n").alias("freq"))
        text = [F.coalesce("count", F.lit(0)), F.col("unique"), F.col("top"), F.col("freq")]
        parts.append(one.select(F.lit(f.name).alias("field"), *[c.cast("string").alias(n) for c, n in zip(text, heads)], *[null.alias(x) for x in (*heads[4:], *tails, "max")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
