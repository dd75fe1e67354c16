"""Row numbers, sorting and gathering. Numbers are dense and global, yet no task ever sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.functions.common import fresh, need
from cohortloom.session import checkpoint_dir


def _laid_out(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """df range-partitioned by order and written to the checkpoint folder, with _pid and _n (1.. in its partition); and the rows before each partition.

    Writing it down fixes which row lies where: sampling for ranges anew could place rows differently.
    """
    checkpoint_dir(df.sparkSession)
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    laid = df.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    laid = laid.withColumn("_pid", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).drop(*keys).checkpoint()
    # One row for each partition; a window over so few is no bottleneck.
    before = laid.groupBy("_pid").agg(F.count("*").alias("_rows")).select(F.col("_pid").alias("_p"), (F.sum("_rows").over(Window.orderBy("_pid")) - F.col("_rows")).alias("_before"))
    return laid, before


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """df with the place of each row (0-based) in ascending order of the given values (negate one to turn it round). Ties keep no promised order; add a unique column to settle them."""
    laid, before = _laid_out(df, order)
    joined = laid.join(F.broadcast(before), F.col("_pid") == F.col("_p"))
    return joined.withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_pid", "_n", "_p", "_before")


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of a value over all rows up to each, in the given order, which must settle ties. A table of one row for each partition closes the seams."""
    laid, _ = _laid_out(df.withColumn("_added", value), order)
    within = laid.withColumn("_so_far", F.sum("_added").over(Window.partitionBy("_pid").orderBy("_n")))
    seam = Window.orderBy("_p")  # one row for each partition
    sums = laid.groupBy(F.col("_pid").alias("_p")).agg(F.sum("_added").alias("_all"))
    before = sums.select("_p", (F.sum("_all").over(seam) - F.col("_all")).alias("_base"))
    return within.join(F.broadcast(before), F.col("_pid") == F.col("_p")).withColumn(name, F.col("_base") + F.col("_so_far")).drop("_pid", "_n", "_p", "_base", "_so_far", "_added")


def sort_values(df: DataFrame, by: Sequence[str], tie: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """Rows in order of `by`; `tie` (usually the row's number) makes it stable. Only ascending order is offered."""
    if not ascending:
        raise ValueError("only ascending order is supported")
    need(df, [*by, *tie])
    return df.orderBy(*by, *tie)


def sort_index(df: DataFrame, by: Sequence[str], row: str, name: str = "position") -> DataFrame:
    """(row, position): where each row goes when sorted by `by`, ties by row number."""
    return number_rows(df.select(*by, row), [F.col(c) for c in [*by, row]], name).select(row, name)


def apply_index(df: DataFrame, index: DataFrame, row: str, position: str = "position", source: str = "source") -> DataFrame:
    """Gathers rows by number: for each (position, source) of index the row of df whose `row` is source; sources may repeat.

    Numbers without a row give none. Order the result by `position` if order matters.
    """
    i = index.select(F.col(position).alias("_position"), F.col(source).alias("_source"))
    out = i.join(df, F.col("_source") == F.col(row)).drop("_source")
    return out.withColumnRenamed("_position", fresh(df, position))


def is_sorted(df: DataFrame, by: Sequence[str], row: str) -> DataFrame:
    """(is_sorted): whether rows in order of their number are in order of `by`. Nulls sort first. An empty table is sorted."""
    laid, before = _laid_out(df.select(*by, row), [F.col(row)])
    key = F.struct(*by)
    within = laid.withColumn("_prev", F.lag(key).over(Window.partitionBy("_pid").orderBy("_n")))
    per = within.groupBy("_pid").agg(F.count_if(F.col("_prev") > key).alias("_bad"), F.min_by(key, "_n").alias("_head"), F.max_by(key, "_n").alias("_tail"))
    w = Window.orderBy("_pid")  # one row for each partition
    per = per.withColumn("_bad", F.col("_bad") + F.when(F.lag("_tail").over(w) > F.col("_head"), 1).otherwise(0))
    return per.agg((F.coalesce(F.sum("_bad"), F.lit(0)) == 0).alias("is_sorted"))
