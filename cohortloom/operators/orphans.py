"""References to records that don't exist, were deleted before, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.common import entity_key, exact, month_of, need


def find_orphans(
    references: DataFrame, parents: DataFrame, *, record: str, reference: Column, parent: Column, at: Column | None = None,
    valid_from: str | None = None, valid_to: str | None = None, period: Column, table_name: str,
) -> DataFrame:
    """(table_name, record_id, period, kind) of the references that point nowhere.

    Both streams are partitioned and sorted by key and merged linearly (a sort-merge join, asked for by hint); a
    reference is `missing` where no parent has its key, `later` where it is before all of the parent's intervals,
    `deleted` where it is at or after the end of one it could belong to. Intervals hold their start, not their end; a
    null start or end is open. Several versions of one parent are gathered into an array first, so that a reference
    meets one parent row whatever the number of versions. A hot key makes one long run on the reference side only;
    the merge streams that side, and adaptive execution splits it. Defined results: null and blank references are no
    cases; a null time leaves `missing` as the only kind; a repeated row counts once; tables may be empty.
    """
    need(references, [record])
    r = references.select(F.col(record).alias("_record"), reference.alias("_key"), (at if at is not None else F.lit(None).cast("timestamp")).alias("_at"), period.alias("_period")).filter(F.col("_key").isNotNull())
    p = parents.select(parent.alias("_parent"), (F.col(valid_from) if valid_from else F.lit(None).cast("timestamp")).alias("_from"), (F.col(valid_to) if valid_to else F.lit(None).cast("timestamp")).alias("_to")).filter(F.col("_parent").isNotNull())
    p = p.groupBy("_parent").agg(F.collect_set(F.struct("_from", "_to")).alias("_intervals"))
    both = r.join(p.hint("merge"), F.col("_key") == F.col("_parent"), "left")
    started = lambda i: F.coalesce(F.col("_at") >= i["_from"], F.lit(True))
    ended = lambda i: F.coalesce(F.col("_at") >= i["_to"], F.lit(False))
    alive = F.exists("_intervals", lambda i: started(i) & ~ended(i))
    past = F.exists("_intervals", lambda i: started(i) & ended(i))
    kind = F.when(F.col("_parent").isNull(), "missing").when(~alive & past, "deleted").when(~alive, "later")
    found = both.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return found.select(F.lit(table_name).alias("table_name"), F.col("_record").alias("record_id"), F.col("_period").alias("period"), "kind").distinct()


def orphans_of_assessments(assessments: DataFrame, users: DataFrame) -> DataFrame:
    assessments, users = exact(assessments, ("id", "user_id", "received_at")), exact(users, ("id", "j_valid_from", "j_valid_to"))
    return find_orphans(
        assessments, users, record="id", reference=entity_key(F.col("user_id")), parent=entity_key(F.col("id")), at=F.col("received_at"),
        valid_from="j_valid_from", valid_to="j_valid_to", period=month_of(F.col("received_at")), table_name="assessments",
    )


def orphans_of_users(users: DataFrame, areas: DataFrame) -> DataFrame:
    users, areas = exact(users, ("id", "lsoa11cd", "j_valid_from")), exact(areas, ("lsoa11cd",))
    blank = F.col("lsoa11cd").rlike(r"^[\s ]*$")
    return find_orphans(users, areas, record="id", reference=F.when(~blank, F.col("lsoa11cd")), parent=F.col("lsoa11cd"), period=month_of(F.col("j_valid_from")), table_name="users")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, period and kind."""
    return orphans.groupBy("table_name", "period", "kind").agg(F.count("*").alias("n_orphans"))
