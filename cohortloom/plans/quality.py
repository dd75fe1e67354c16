"""Queries p1 to p6: data-quality operators over the tables of a folder, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.functions.common import entity_key, exact
from cohortloom.operators import features as X, impute as I, orphans as O, parse_errors as P, spikes as S, timestamps as T
from cohortloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_errors(table(spark, d, "raw_records"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Each unreadable record with its reason and all its bad fields."""
    report = P.error_report(p1_found(spark, d))
    return report.select("record_id", "reason", F.array_join("fields", ",").alias("fields"))


def p1_clean_users(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records")
    return P.clean_rows(raw, P.USERS_CSV, P.parse_errors(raw))


def p1_clean_assessments(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records")
    return P.clean_rows(raw, P.ASSESSMENTS_CSV, P.parse_errors(raw))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "assessments").select("id", "date", "time_zone", "locale", "received_at", entity_key(F.col("user_id")).alias("user_id"))
    # Rows that need no work are left out before anything is parsed; copies go last, when few columns are left.
    odd = a.filter(F.col("date").isNotNull() & ~T.is_canonical(F.col("date")))
    return T.normalise_timestamps(odd).filter(F.col("utc_us").isNotNull()).select("id", "utc_us").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users")
    return O.orphans_of_assessments(table(spark, d, "assessments"), users).unionByName(O.orphans_of_users(users, table(spark, d, "lsoa11")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return S.disturbed(S.score_temperatures(table(spark, d, "assessments"), flagged_only=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    users = I.fill_users(table(spark, d, "users"), ["bmi", "height_cm"], True)
    temperatures = I.fill_temperatures(table(spark, d, "assessments"), True).withColumn("field", F.lit("temperature_f"))
    # Each missing value comes out filled, or as one that no group could fill; asking for that keeps the fill in the plan.
    settled = F.col("is_filled") & (F.col("filled").isNotNull() | (F.col("filled_from") == "none"))
    named = [df.filter(settled).select(F.lit(t).alias("table_name"), F.col("id").alias("record_id"), "field") for t, df in (("users", users), ("assessments", temperatures))]
    return named[0].unionByName(named[1])


def p5_fills(spark: SparkSession, d: str) -> DataFrame:
    """What each missing value of p5_found was filled with, and from which group."""
    users = I.fill_users(table(spark, d, "users"), ["bmi", "height_cm"], True)
    temperatures = I.fill_temperatures(table(spark, d, "assessments"), True).withColumn("field", F.lit("temperature_f"))
    named = [df.select(F.lit(t).alias("table_name"), F.col("id").alias("record_id"), "field", F.round(F.col("filled").cast("double"), 3).alias("filled"), "filled_from") for t, df in (("users", users), ("assessments", temperatures))]
    return named[0].unionByName(named[1])


def p5_users_diabetes(spark: SparkSession, d: str) -> DataFrame:
    """A categorical field, filled by the mode."""
    return I.fill_diabetes(table(spark, d, "users"))


def p5_users_bmi(spark: SparkSession, d: str) -> DataFrame:
    return I.fill_users(table(spark, d, "users"), "bmi")


def p5_users_height(spark: SparkSession, d: str) -> DataFrame:
    return I.fill_users(table(spark, d, "users"), "height_cm")


def p5_temperature(spark: SparkSession, d: str) -> DataFrame:
    return I.fill_temperatures(table(spark, d, "assessments"))


#: Kinds of the known forms; they have their columns always, whatever the data hold.
KNOWN_TYPES = tuple(f"q{k:02d}/{s}/{t}" for k in range(1, 29) for s in X.SMELL for t in X.TESTED)


def assessment_features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The vectors of all users, and the dictionary of the kinds of assessment."""
    a = exact(table(spark, d, "assessments"), ("id", "user_id", "entry_form", "loss_of_smell", "tested_covid_positive", "received_at", "temperature_f"))
    kind = X.assessment_type(F.col("entry_form"), F.col("loss_of_smell"), F.col("tested_covid_positive"))
    user = entity_key(F.col("user_id"))
    temperature = F.when(~F.coalesce(I.missing_number(F.col("temperature_f")), F.lit(True)), F.col("temperature_f"))
    types = X.types_of(a.filter(user.isNotNull()), kind, KNOWN_TYPES)
    return X.sparse_features(a, user, kind, F.col("received_at"), types, temperature, record=["id"]), types


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = X.expand_rows(*assessment_features(spark, d))
    return rows.select(F.col("entity").alias("user_id"), F.col("type").alias("event_type"), F.col("n").alias("n_events"), "last_us")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """p6_found with the totals: the sum of the temperatures that were measured."""
    rows = X.expand_rows(*assessment_features(spark, d))
    return rows.select(F.col("entity").alias("user_id"), F.col("type").alias("event_type"), F.col("n").alias("n_events"), "last_us", F.round("total", 3).alias("total"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """Count, last time and total of every kind of assessment as columns, one row for each user.

    The kinds of the known forms always have their columns; whatever else the table holds (a new, null or blank form)
    follows in order of name, so that the counts of a user add up to all of the user's assessments.
    """
    features, types = assessment_features(spark, d)
    if len(types) > len(KNOWN_TYPES) + X.TYPES_LIMIT:
        raise ValueError(f"over {X.TYPES_LIMIT} kinds beyond the known ones can't all be columns; p6_found has them as rows")
    wide = X.expand_columns(features, types, X.column_names(t.replace("/", "_") for t in types))
    return wide.select(*[F.round(c, 3).alias(c) if c.endswith("__total") else F.col(c) for c in wide.columns])


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_clean_users, p1_clean_assessments, p2_found, p3_found, p3_report, p4_found, p5_found, p5_fills, p5_users_bmi, p5_users_height, p5_users_diabetes, p5_temperature, p6_found, p6_totals, p6_table)}

_KEY = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"
_P3 = f"""
 select distinct 'assessments' as table_name, a.id as record_id, strftime(a.received_at at time zone 'UTC', '%Y-%m') as period,
   case when u.id is null then 'missing' when a.received_at < u.j_valid_from then 'later' else 'deleted' end as kind
 from (select *, {_KEY.format("user_id")} as k from assessments) a
 left join (select distinct id, j_valid_from, j_valid_to from users) u on a.k = {_KEY.format("u.id")}
 where a.k is not null and (u.id is null or a.received_at < u.j_valid_from or a.received_at >= u.j_valid_to)
 union all
 select distinct 'users', u.id, strftime(u.j_valid_from at time zone 'UTC', '%Y-%m'), 'missing'
 from users u where trim(lsoa11cd) <> '' and not exists (select 1 from lsoa11 l where l.lsoa11cd = u.lsoa11cd)
"""
_MISSING = "({0} is null or {0} <= 0 or {0} >= 900)"
_LABELS = "coalesce(entry_form, '') || '/' || case loss_of_smell when 1 then 'False' when 2 then 'True' else '' end || '/' || case tested_covid_positive when 1 then 'waiting' when 2 then 'no' when 3 then 'yes' else '' end"

_FILL = f"""
 with u as (select distinct id, {{0}} as v, floor(year_of_birth / 10.0)::bigint as born, has_diabetes as ill, lsoa11cd as area, {_MISSING.format("{0}")} as gone from users),
 p as (select * from u where not gone),
 l1 as (select born, ill, area, median(v) as m from p where born is not null and ill is not null and area is not null group by all having count(*) >= 20),
 l2 as (select born, ill, median(v) as m from p where born is not null and ill is not null group by all having count(*) >= 20),
 l3 as (select born, median(v) as m from p where born is not null group by all having count(*) >= 20),
 l4 as (select median(v) as m from p)
 select u.id, u.v as original, case when gone then cast(round(coalesce(l1.m, l2.m, l3.m, l4.m)) as integer) else v end as filled, gone as is_filled,
  case when not gone then 'self' when l1.m is not null then 'decade, diabetes and area' when l2.m is not null then 'decade and diabetes' when l3.m is not null then 'decade' when l4.m is not null then 'all' else 'none' end as filled_from
 from u left join l1 on u.born = l1.born and u.ill = l1.ill and u.area = l1.area left join l2 on u.born = l2.born and u.ill = l2.ill left join l3 on u.born = l3.born cross join l4
"""

_CELL = '(?:"(?:[^"]|"")*"|[^",]*)'


def cell_sql(k: int) -> str:
    """The k-th cell (from 0) of raw_text, quotes undone."""
    found = f"regexp_extract(raw_text, '^(?:{_CELL}, *){{{k}}}({_CELL})(?:,|$)', 1)"
    return f"case when starts_with({found}, '\"') then replace(substr({found}, 2, length({found}) - 2), '\"\"', '\"') else {found} end"


def _cell(k: int) -> str:
    return f"regexp_replace({cell_sql(k)}, '^\\s+|\\s+$', '', 'g')"


_BAD_INT = "v <> '' and not (regexp_full_match(v, '[+-]?[0-9]+') and try_cast(ltrim(v, '+') as integer) is not null)"
_BAD_FLOAT = "v <> '' and not (regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') and isfinite(coalesce(try_cast(ltrim(v, '+') as double), 'inf'::double)))"
RECORDS_SQL = f"""
 with r as (select record_id, file_name, raw_text, case file_name when 'users.csv' then 7 when 'assessments.csv' then 8 else -1 end as width,
   case when raw_text is null then 'column_count' when not regexp_full_match(raw_text, '{_CELL}(?:, *{_CELL})*') then 'quoting'
    when length(regexp_replace(regexp_replace(raw_text, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 <> width then 'column_count' end as reason from raw_records),
 c as (select record_id, 'bmi' as field, {_cell(3)} as v, false as is_float from r where reason is null and file_name = 'users.csv'
  union all select record_id, 'year_of_birth', {_cell(6)}, false from r where reason is null and file_name = 'users.csv'
  union all select record_id, 'temperature_f', {_cell(7)}, true from r where reason is null and file_name = 'assessments.csv')
 select record_id, reason, '' as field from r where reason is not null
 union all select record_id, 'bad_value', field from c where case when is_float then {_BAD_FLOAT} else {_BAD_INT} end
"""


def _clean(layout: P.Layout) -> str:
    """The readable records of a layout, typed."""
    kinds = {"int": "integer", "float": "float"}
    cells = ", ".join(f'{cell_sql(k)} as "{name}"' if kind == "string" else f"try_cast(ltrim({_cell(k)}, '+') as {kinds[kind]}) as \"{name}\"" for k, (name, kind) in enumerate(layout.columns))
    return f"select record_id, {cells} from raw_records where file_name = '{layout.file_name}' and raw_text is not null and record_id not in (select record_id from ({RECORDS_SQL}))"


_TEMPERATURES = f"""
 with a as (select distinct id, temperature_f as v, {_KEY.format("user_id")} as who, (year(received_at at time zone 'UTC') * 12 + month(received_at at time zone 'UTC'))::integer as m, {_MISSING.format("temperature_f")} or isnan(temperature_f) as gone from assessments),
 p as (select who, m, round(v::double, 2) as v from a where not gone),
 l1 as (select who, m, median(v) as f from p where who is not null and m is not null group by all having count(*) >= 3),
 l2 as (select who, median(v) as f from p where who is not null group by all having count(*) >= 3),
 l3 as (select m, median(v) as f from p where m is not null group by all having count(*) >= 20),
 l4 as (select median(v) as f from p)
 select a.id, round(coalesce(l1.f, l2.f, l3.f, l4.f)::float::double, 3) as filled, case when l1.f is not null then 'user and month' when l2.f is not null then 'user' when l3.f is not null then 'month' when l4.f is not null then 'all' else 'none' end as filled_from
 from a left join l1 on a.who = l1.who and a.m = l1.m left join l2 on a.who = l2.who left join l3 on a.m = l3.m cross join l4 where gone
"""
_EVENTS = f"""(select {_KEY.format("user_id")} as user_id, {_LABELS} as event_type, received_at, case when not isnan(temperature_f) and temperature_f > 0 and temperature_f < 900 then temperature_f::double end as measured
 from (select distinct id, user_id, entry_form, loss_of_smell, tested_covid_positive, received_at, temperature_f from assessments) where {_KEY.format("user_id")} is not null)"""
_COLUMNS = ", ".join(f"""coalesce(map_extract(m, '{t}')[1].n, 0) as "{c}__n", map_extract(m, '{t}')[1].l as "{c}__last_us", map_extract(m, '{t}')[1].t as "{c}__total\"""" for t, c in ((t, t.replace("/", "_")) for t in KNOWN_TYPES))

ORACLES = {
    "p1_found": RECORDS_SQL,
    "p1_clean_users": _clean(P.USERS_CSV),
    "p1_clean_assessments": _clean(P.ASSESSMENTS_CSV),
    "p1_report": f"select record_id, min(reason) as reason, coalesce(string_agg(distinct nullif(field, ''), ',' order by nullif(field, '')), '') as fields from ({RECORDS_SQL}) group by record_id",
    "p5_fills": f"""
 select 'users' as table_name, id as record_id, 'bmi' as field, filled::double as filled, filled_from from ({_FILL.format("bmi")}) where is_filled
 union all select 'users', id, 'height_cm', filled::double, filled_from from ({_FILL.format("height_cm")}) where is_filled
 union all select 'assessments', id, 'temperature_f', filled, filled_from from ({_TEMPERATURES})
""",
    "p5_users_diabetes": """
 with u as (select distinct id, has_diabetes as v, floor(year_of_birth / 10.0)::bigint as born, lsoa11cd as area, has_diabetes is null or has_diabetes = 0 as gone from users),
 l1 as (select born, area, arg_min(v, (-n, v)) as f from (select born, area, v, count(*) as n from u where not gone and born is not null and area is not null group by all) group by all having sum(n) >= 20),
 l2 as (select born, arg_min(v, (-n, v)) as f from (select born, v, count(*) as n from u where not gone and born is not null group by all) group by all having sum(n) >= 20),
 l3 as (select arg_min(v, (-n, v)) as f from (select v, count(*) as n from u where not gone group by all))
 select id, v as original, case when gone then coalesce(l1.f, l2.f, l3.f) else v end as filled, gone as is_filled,
  case when not gone then 'self' when l1.f is not null then 'decade and area' when l2.f is not null then 'decade' when l3.f is not null then 'all' else 'none' end as filled_from
 from u left join l1 on u.born = l1.born and u.area = l1.area left join l2 on u.born = l2.born cross join l3
""",
    "p6_totals": f"select user_id, event_type, count(*) as n_events, max(epoch_us(received_at)) as last_us, round(sum(measured), 3) as total from {_EVENTS} group by all",
    "p6_table": f"select user_id as entity, {_COLUMNS} from (select user_id, map(list(event_type), list({{'n': n, 'l': last_us, 't': total}})) as m from (select user_id, event_type, count(*) as n, max(epoch_us(received_at)) as last_us, round(sum(measured), 3) as total from {_EVENTS} group by all) group by user_id)",
    "p5_users_bmi": _FILL.format("bmi"),
    "p5_users_height": _FILL.format("height_cm"),
    "p3_found": _P3,
    "p3_report": f"select table_name, period, kind, count(*) as n_orphans from ({_P3}) group by all",
    "p5_found": f"""
 select distinct 'users' as table_name, id as record_id, 'bmi' as field from users where {_MISSING.format("bmi")}
 union all select distinct 'users', id, 'height_cm' from users where {_MISSING.format("height_cm")}
 union all select distinct 'assessments', id, 'temperature_f' from assessments where {_MISSING.format("temperature_f")} or isnan(temperature_f)
""",
    "p6_found": f"""
 select {_KEY.format("user_id")} as user_id, {_LABELS} as event_type, count(*) as n_events, max(epoch_us(received_at)) as last_us
 from (select distinct id, user_id, entry_form, loss_of_smell, tested_covid_positive, received_at from assessments)
 where {_KEY.format("user_id")} is not null group by all
""",
}
