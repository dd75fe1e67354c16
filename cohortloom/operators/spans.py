"""Spans: runs of equal neighbouring keys in a given order, and aggregates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.functions.common import need
from cohortloom.functions.text import csv_quote
from cohortloom.operators.order import _laid_out, running_sum


def with_spans(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: str = "span_id", row: str = "row_number") -> DataFrame:
    """df with the number of each row (0-based) and of its span (0-based) in the order. Equal nulls are equal.

    Changes are found within partitions of a range-partitioned copy; a table of one row for each partition (its first
    and last key and its number of changes) then closes the seams. No task sees all rows, nor a whole long span.
    """
    need(df, [*keys, *order])
    laid, before = _laid_out(df, [F.col(c) for c in order])
    key = F.struct(*keys)
    w = Window.partitionBy("_pid").orderBy("_n")
    marked = laid.withColumn("_key", key).withColumn("_new", F.when(F.col("_n") > 1, (~F.lag("_key").over(w).eqNullSafe(F.col("_key"))).cast("int")).otherwise(0))
    per = marked.groupBy("_pid").agg(F.sum("_new").alias("_news"), F.min_by("_key", "_n").alias("_head"), F.max_by("_key", "_n").alias("_tail"))
    seam = Window.orderBy("_pid")  # one row for each partition
    per = per.withColumn("_seam", F.coalesce((~F.lag("_tail").over(seam).eqNullSafe(F.col("_head"))).cast("int"), F.lit(1)))
    per = per.withColumn("_seam", F.when(F.row_number().over(seam) == 1, 0).otherwise(F.col("_seam")))
    per = per.withColumn("_base", F.sum(F.col("_news") + F.col("_seam")).over(seam) - F.col("_news"))
    joined = marked.join(F.broadcast(before.join(per, F.col("_p") == F.col("_pid")).select("_p", "_before", "_base")), F.col("_pid") == F.col("_p"))
    out = joined.withColumn(span, F.col("_base") + F.sum("_new").over(w)).withColumn(row, F.col("_before") + F.col("_n") - 1)
    return out.drop("_pid", "_n", "_key", "_new", "_p", "_before", "_base")


def last_in_run(df: DataFrame, span: str = "span_id", row: str = "row_number", name: str = "is_last") -> DataFrame:
    """df (with spans) with whether a row is the last of its span."""
    ends = df.groupBy(span).agg(F.max(row).alias("_end")).select("_end")
    return df.join(ends, F.col(row) == F.col("_end"), "left").withColumn(name, F.col("_end").isNotNull()).drop("_end")


def span_starts(df: DataFrame, span: str = "span_id", row: str = "row_number", name: str = "start") -> DataFrame:
    """(start): the first row of each span, and the number of rows as the end of the last: the boundaries of df's spans."""
    return df.groupBy(span).agg(F.min(row).alias(name)).select(name).union(df.agg((F.max(row) + 1).alias(name)).filter(F.col(name).isNotNull()))


def union_spans(*boundaries: DataFrame, name: str = "start") -> DataFrame:
    """The boundaries of the spans that no boundary of any list crosses: each once."""
    out = boundaries[0].select(name)
    for b in boundaries[1:]:
        out = out.union(b.select(name))
    return out.filter(F.col(name).isNotNull()).distinct()


def spans_from(df: DataFrame, boundaries: DataFrame, row: str = "row_number", name: str = "start", span: str = "span_id") -> DataFrame:
    """df with the span of each row by a list of boundaries (0, ..., number of rows); its own range-partitioned copy closes the seams.

    A boundary that occurs twice is an empty span, which has no first or least value: that raises.
    """
    checked = boundaries.groupBy(name).agg(F.count("*").alias("_times")).select(F.when(F.col("_times") > 1, F.raise_error(F.lit("a span is empty")).cast("bigint")).otherwise(F.col(name)).alias("_start"))
    marked = df.join(checked, F.col(row) == F.col("_start"), "left")
    return running_sum(marked, [F.col(row)], F.col("_start").isNotNull().cast("bigint"), span).withColumn(span, F.col(span) - 1).drop("_start")


def span_aggregate(df: DataFrame, aggregates: dict[str, tuple[str, str | None]], span: str = "span_id", row: str = "row_number") -> DataFrame:
    """One row for each span: aggregates by output name as (operator, column).

    Operators: count, min, max, first, last, index_of_min, index_of_max (the first row that attains it),
    index_of_first, index_of_last, concat. All but concat merge map-side.
    """
    made = {name: _aggregate(op, c, row).alias(name) for name, (op, c) in aggregates.items()}
    return df.groupBy(span).agg(*made.values())


def _aggregate(op: str, column: str | None, row: str) -> Column:
    r = F.col(row)
    if op == "count":
        return F.count("*")
    if op in ("index_of_first", "index_of_last"):
        return F.min(r) if op == "index_of_first" else F.max(r)
    v = F.col(column)
    if op in ("min", "max"):
        return F.min(v) if op == "min" else F.max(v)
    if op == "first":
        return F.min_by(v, r)
    if op == "last":
        return F.max_by(v, r)
    if op == "index_of_min":
        return F.min_by(r, F.struct(v, r))
    if op == "index_of_max":
        return F.max_by(r, F.struct(v, -r))
    if op == "concat":
        listed = F.transform(F.array_sort(F.collect_list(F.struct(r.alias("r"), v.alias("v")))), lambda x: x["v"])
        return F.array_join(F.transform(F.filter(listed, lambda x: x != ""), csv_quote), ",")
    raise ValueError(f"unknown operator {op}")


def group_transform(df: DataFrame, key: Sequence[str], aggregate: Column, name: str) -> DataFrame:
    """df with an aggregate of each row's group. Aggregates first, then joins, so that a hot group isn't gathered."""
    per = df.groupBy(*key).agg(aggregate.alias(name))
    right = per.select(*[F.col(k).alias(f"_g_{k}") for k in key], name)
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in key]
    return df.join(right, on, "left").drop(*[f"_g_{k}" for k in key])
