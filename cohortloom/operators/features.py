"""One row per entity from events: counts, last times and totals for each type of event, as sparse vectors that merge."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.common import bound, fresh, need

#: Types that a dictionary may hold, and types beyond the known ones that may become columns.
DICTIONARY_LIMIT, TYPES_LIMIT = 100_000, 2_000


def types_of(events: DataFrame, type_of: Column, known: Sequence[str] = (), limit: int = DICTIONARY_LIMIT) -> list[str]:
    """The dictionary of types: the known ones and then, sorted, all others found in the events; a null type is ''.

    A type's index is its place. Raises beyond `limit` others, as the dictionary goes to every task.
    """
    found = events.select(F.coalesce(type_of, F.lit("")).alias("type")).distinct()
    rows = (found.filter(~F.col("type").isin(list(known))) if known else found).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} types that aren't known")
    return [*known, *sorted(r["type"] for r in rows)]


def _dictionary(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """(type, index), broadcast: at most DICTIONARY_LIMIT rows beyond the known ones."""
    return F.broadcast(df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(types)], "_name string, _type int"))


def _vectors(folded: DataFrame) -> DataFrame:
    """(entity, vector) from rows (_entity, _type, n, last_us, total), of which several may be of one entity and type."""
    laid = folded.repartition("_entity")  # both folds below keep to this layout
    each = laid.groupBy("_entity", "_type").agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"), F.sum("total").alias("total"))
    entries = F.sort_array(F.collect_list(F.struct("_type", F.struct("n", "last_us", "total"))))
    return each.groupBy(F.col("_entity").alias("entity")).agg(F.map_from_entries(entries).alias("vector"))


def sparse_features(events: DataFrame, entity: Column, type_of: Column, at: Column, types: Sequence[str], value: Column | None = None, record: Sequence[str] | None = None, parts: int | None = None) -> DataFrame:
    """(entity, vector): per entity a sparse vector, a map from the index of a type in `types` to (n, last_us, total).

    Events are narrowed to numbers first: the type's index, the time, the value and a 64-bit hash of `record`, the
    columns by which an exact copy is known (copies of one event, which agree in all else, count once). These rows are
    laid out by entity, type and a part of the hash, so that a hot entity, or a hot type of it, lies in all tasks; there
    copies are dropped and events folded without another shuffle, and what the second shuffle moves are at most `parts`
    rows (by default as many as the session has shuffle partitions) for each entity and type. Defined results: null entities are left out, a null type counts as '' and types that `types` lacks
    are left out, null times leave the last time as it is, null values add nothing to a total; no events give no rows.
    """
    value = value if value is not None else F.lit(None).cast("double")
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.xxhash64(*[F.col(c) for c in record]) if record else F.monotonically_increasing_id()
    rows = events.select(entity.alias("_entity"), F.coalesce(type_of, F.lit("")).alias("_name0"), F.unix_micros(at).alias("_at"), value.cast("double").alias("_value"), own.alias("_own")).filter(F.col("_entity").isNotNull())
    rows = rows.join(_dictionary(events, types), F.col("_name0") == F.col("_name")).select("_entity", "_type", F.pmod("_own", F.lit(parts)).cast("int").alias("_part"), "_own", "_at", "_value")
    laid = rows.repartition("_entity", "_type", "_part")
    once = laid.distinct() if record else laid
    folded = once.groupBy("_entity", "_type", "_part").agg(F.count("*").alias("n"), F.max("_at").alias("last_us"), F.sum("_value").alias("total"))
    return _vectors(folded.drop("_part"))


def merge_vectors(a: Column, b: Column) -> Column:
    """The vector of the events of two vectors together."""
    plus = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)
    return F.map_zip_with(a, b, lambda _, x, y: F.struct(plus(x["n"], y["n"]).alias("n"), F.greatest(x["last_us"], y["last_us"]).alias("last_us"), plus(x["total"], y["total"]).alias("total")))


def merge_features(*parts: DataFrame) -> DataFrame:
    """Feature tables of separate events (days, regions) by the same dictionary as one: vectors of an entity are merged."""
    rows = expand_rows(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(expand_rows(p))
    return _vectors(rows.select(F.col("entity").alias("_entity"), F.col("type").alias("_type"), "n", "last_us", "total"))


def expand_rows(features: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The sparse vectors as rows (entity, type, n, last_us, total); with the dictionary types come by name."""
    rows = features.select("entity", F.explode("vector").alias("_type", "_x")).select("entity", "_type", "_x.n", "_x.last_us", "_x.total")
    if types is None:
        return rows.withColumnRenamed("_type", "type")
    return rows.join(_dictionary(features, types), "_type").select("entity", F.col("_name").alias("type"), "n", "last_us", "total")


def column_names(names: Iterable[str]) -> list[str]:
    """The names, lengthened where they only differ in case or are the same."""
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        out.append(fresh(taken, name))
        taken.add(out[-1])
    return out


def expand_columns(features: DataFrame, types: Sequence, names: Sequence[str], parts: Sequence[str] = ("n", "last_us", "total")) -> DataFrame:
    """One column for each type and part. Absent types have count 0 and null elsewhere. No shuffle: each row expands by itself."""
    need(features, ["entity", "vector"])
    if len(types) != len(names):
        raise ValueError("types and names differ in number")
    # The vector is laid out as one dense array, from which each column takes its place.
    dense = bound(features, "_dense", F.transform(F.sequence(F.lit(0), F.lit(max(len(types) - 1, 0))), lambda k: F.try_element_at(F.col("vector"), k)))
    cols = []
    for k, name in enumerate(names):
        got = F.get(F.col("_dense"), F.lit(k))
        for part in parts:
            c = got[part]
            cols.append((F.coalesce(c, F.lit(0)) if part == "n" else c).alias(f"{name}__{part}"))
    return dense.select("entity", *cols)


# Labels of the codes.
SMELL = ("", "False", "True")
TESTED = ("", "waiting", "no", "yes")


def label(code: Column, labels: Sequence[str]) -> Column:
    """The label of a code; '' for null and for codes without a label."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in labels]), code.cast("int") + 1), F.lit(""))


def assessment_type(form: Column, smell: Column, tested: Column) -> Column:
    """The kind of an assessment: form/loss_of_smell/tested_covid_positive."""
    safe = lambda c: F.when(c >= 0, c)
    return F.concat_ws("/", F.coalesce(form, F.lit("")), label(safe(smell), SMELL), label(safe(tested), TESTED))
