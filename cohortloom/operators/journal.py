"""Snapshots of a table kept as versions with the time they hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.common import need

FROM, TO = "j_valid_from", "j_valid_to"
OPEN_END = "3000-01-01 00:00:00"


def journal_datasets(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], keys: Mapping[str, str]) -> dict[str, DataFrame]:
    """journal_table for each table that has a key in `keys`. Both datasets must have the same tables."""
    if set(old) != set(new):
        raise ValueError(f"the datasets must have the same tables, but have {sorted(old)} and {sorted(new)}")
    return {name: journal_table(old[name], new[name], key) for name, key in keys.items() if name in set(old)}


def journal_table(old: DataFrame, new: DataFrame, key: str, compare: Sequence[str] | None = None, close: bool = True) -> DataFrame:
    """All old versions, and the new row of each key that is new or differs from its latest version in a compared field.

    Fields of both tables are kept (key, compared fields, journal times). With `close` the version that a new one
    follows ends where that begins; without it old times stay as they are. The latest version is found by an aggregate
    per key, so the history of a hot key isn't sorted in one task. Differences treat nulls as equal. A key that occurs
    only in the old table keeps its versions; repeated new rows of one key count as the first by value.
    """
    fields = list(compare) if compare is not None else [c for c in old.columns if c in new.columns and c not in (key, FROM, TO)]
    need(old, [key, FROM, TO, *fields])
    need(new, [key, FROM, *fields])
    values = F.struct(*fields)
    latest = old.groupBy(F.col(key).alias("_key")).agg(F.max(FROM).alias("_last"), F.max_by(values, F.struct(FROM, TO)).alias("_old"))
    fresh_rows = new.groupBy(F.col(key).alias("_nkey")).agg(F.min(F.struct(F.col(FROM).alias("_start"), values.alias("_values"))).alias("_row"))
    both = fresh_rows.join(latest, F.col("_nkey") == F.col("_key"), "left")
    keep = both.filter(F.col("_key").isNull() | ~F.col("_row._values").eqNullSafe(F.col("_old")))
    end = F.lit(OPEN_END).cast(old.schema[TO].dataType)
    added = keep.select(F.col("_nkey").alias(key), *[F.col(f"_row._values.{f}").alias(f) for f in fields], F.col("_row._start").cast(old.schema[FROM].dataType).alias(FROM), end.alias(TO))
    kept = old.select(key, *fields, FROM, TO)
    if close:
        followed = keep.filter(F.col("_key").isNotNull()).select(F.col("_key").alias("_fkey"), F.col("_last"), F.col("_row._start").cast(old.schema[TO].dataType).alias("_ends"))
        kept = kept.join(followed, (F.col(key) == F.col("_fkey")) & (F.col(FROM) == F.col("_last")), "left")
        kept = kept.withColumn(TO, F.coalesce(F.least("_ends", F.col(TO)), F.col(TO))).select(key, *fields, FROM, TO)
    return kept.unionByName(added)
