"""Queries of the relational operators over the tables of a folder, with the SQL they are compared with."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.functions import arithmetic as A, dates as D, text as X
from cohortloom.functions.common import bound
from cohortloom.operators import aggregate as G, frame as R, journal as J, merge as M, order as O, parse_errors as P, spans as S
from cohortloom.plans.quality import RECORDS_SQL, cell_sql
from cohortloom.session import checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder of the shared one for what a query writes, the same each time it runs over the same tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{zlib.crc32(d.encode()):08x}"


# ---- filters and columns ----------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 40")
def filter_compare(spark, d):
    return R.apply_filter(table(spark, d, "lineitem"), F.col("l_quantity") > 40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select id, loss_of_smell from assessments where loss_of_smell <> 0")
def filter_numeric_nonzero(spark, d):
    return R.apply_filter(table(spark, d, "assessments"), "loss_of_smell").select("id", "loss_of_smell")


@query("select o_orderkey, o_totalprice > 100000 and o_orderstatus = 'O' as both_hold, o_totalprice > 100000 or o_orderstatus = 'O' as either_holds, (o_totalprice > 100000) <> (o_orderstatus = 'O') as one_holds, not (o_totalprice > 100000) as inverted from orders")
def filter_logic(spark, d):
    a, b = F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").select("o_orderkey", A.both(a, b, True).alias("both_hold"), A.either(a, b, True).alias("either_holds"), A.exclusive(a, b, True).alias("one_holds"), A.invert(a, True).alias("inverted"))


@query("select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') as urgent from orders")
def isin_categories(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.isin(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", None]).alias("urgent"))


@query("select id, case when bmi is null then 1 when bmi < 10 or bmi > 80 then 2 else 0 end as flags from (select distinct id, bmi from users)")
def flagged_filter(spark, d):
    flags = R.flag_failures(F.col("bmi"), 1, 2, lambda c: c.isNotNull(), lambda c: c.between(10, 80))
    return table(spark, d, "users").select("id", "bmi").distinct().select("id", flags.alias("flags"))


@query("select count(*) filter (where f = 0) as n_empty, count(*) filter (where f & 2 <> 0) as n_set, count(*) filter (where f & 2 = 0) as n_not_set from (select case when bmi is null then 1 when bmi < 10 or bmi > 80 then 2 else 0 end as f from (select distinct id, bmi from users))")
def flag_counters(spark, d):
    return G.count_flags(flagged_filter(spark, d), "flags", 2)


@query("select n_nationkey as n_regionkey, n_regionkey as n_nationkey, n_name as title from nation")
def rename_swap(spark, d):
    return R.rename(table(spark, d, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "title"})


@query("select o_orderkey, cast(((o_custkey + 128) % 256) - 128 as tinyint) as wrapped, cast(trunc(o_totalprice) as bigint) as whole from orders")
def astype_wrap(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("wrapped"), F.col("o_totalprice").alias("whole"))
    return R.astype(R.astype(df, "wrapped", "int8"), "whole", "int64")


_PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 else 0 end as tinyint) as priority from orders")
def categorical_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.encode_categories(F.col("o_orderpriority"), _PRIORITY).alias("priority"))


@query("select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 else -1 end as tinyint) as priority, case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then '' else o_orderpriority end as priority_freetext from orders")
def categorical_encode_leaky(spark, d):
    code, text = R.encode_leaky(F.col("o_orderpriority"), _PRIORITY)
    return table(spark, d, "orders").select("o_orderkey", code.alias("priority"), text.alias("priority_freetext"))


@query("select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 10 when '2-HIGH' then 10 when '3-MEDIUM' then 30 else 0 end as tinyint) as priority from orders")
def categorical_remap(spark, d):
    from cohortloom.types import Kind

    coded = R.assign(categorical_encode(spark, d), "priority", F.col("priority"), Kind("categorical", "int8", 0, {"": 0, **_PRIORITY}))
    return R.remap(coded, "priority", [(0, 0), (1, 10), (2, 10), (3, 30)], {"": 0, "fast": 10, "slow": 30})


# ---- arithmetic -------------------------------------------------------------------------------------------------------


@query("select o_orderkey, floor((o_custkey - 700) / 7.0)::bigint as q_up, floor((o_custkey - 700) / -7.0)::bigint as q_down, (o_custkey - 700) - 7 * floor((o_custkey - 700) / 7.0)::bigint as r_up, (o_custkey - 700) + 7 * floor((o_custkey - 700) / -7.0)::bigint as r_down from orders")
def arith_floor_ops(spark, d):
    x = F.col("o_custkey") - 700
    up, down = F.lit(7).cast("bigint"), F.lit(-7).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", A.floor_divide(x, up).alias("q_up"), A.floor_divide(x, down).alias("q_down"), A.modulo(x, up).alias("r_up"), A.modulo(x, down).alias("r_down"))


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice + l_tax as added, l_extendedprice - l_discount as taken, l_quantity * l_tax as times, case when l_discount = 0 then 'inf' else 'finite' end as quotient from lineitem")
def arith_basic(spark, d):
    c = F.col
    quotient = A.true_divide(c("l_quantity"), c("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", A.add(c("l_extendedprice"), c("l_tax")).alias("added"), A.subtract(c("l_extendedprice"), c("l_discount")).alias("taken"),
        A.multiply(c("l_quantity"), c("l_tax")).alias("times"), F.when(quotient == float("inf"), "inf").otherwise("finite").alias("quotient"),
    )


@query("select p_partkey, p_size & 12 as conj, p_size | 12 as disj, xor(p_size, 12) as exor, ~p_size as inv, p_size = 0 as lnot from part")
def bitwise_ops(spark, d):
    s, m = F.col("p_size"), F.lit(12)
    return table(spark, d, "part").select("p_partkey", A.both(s, m).alias("conj"), A.either(s, m).alias("disj"), A.exclusive(s, m).alias("exor"), A.invert(s).alias("inv"), A.logical_not(s).alias("lnot"))


# ---- aggregation ------------------------------------------------------------------------------------------------------


@query("select o_custkey, max(o_totalprice) as o_totalprice_max from orders group by o_custkey")
def groupby_max(spark, d):
    return G.GroupBy(table(spark, d, "orders"), "o_custkey").max("o_totalprice")


@query("select o_custkey, min(o_totalprice) as o_totalprice_min from orders group by o_custkey")
def groupby_min(spark, d):
    return G.GroupBy(table(spark, d, "orders"), "o_custkey").min("o_totalprice")


@query("select o_custkey, count(*) as count from orders group by o_custkey")
def groupby_count(spark, d):
    return G.GroupBy(table(spark, d, "orders"), "o_custkey").count()


@query("select user_id, arg_min(event_type, event_id) as event_type_first from events group by user_id")
def groupby_first(spark, d):
    return G.GroupBy(table(spark, d, "events"), "user_id", order=["event_id"]).first("event_type")


@query("select user_id, arg_max(event_type, event_id) as event_type_last from events group by user_id")
def groupby_last(spark, d):
    return G.GroupBy(table(spark, d, "events"), "user_id", order=["event_id"]).last("event_type")


@query("select l_returnflag, l_linestatus, count(*) as count from lineitem group by all")
def groupby_multi_keys(spark, d):
    return G.GroupBy(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).count()


@query("select distinct l_orderkey, l_linenumber from lineitem")
def drop_duplicates(spark, d):
    return G.drop_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select event_type as value, min(event_id) as first_index, count(*) as count, rank() over (order by event_type) - 1 as inverse from events group by event_type")
def unique_counts(spark, d):
    return G.unique(table(spark, d, "events"), "event_type", "event_id")


@query("select event_id, dense_rank() over (order by event_type) - 1 as inverse from events")
def unique_inverse(spark, d):
    return G.with_inverse(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "inverse")


@query("select cast(year(o_orderdate) as integer) as order_year, count(*) as count from orders where o_totalprice > 1000 group by 1")
def histogram(spark, d):
    return G.histogram(table(spark, d, "orders"), F.year("o_orderdate"), "order_year", F.col("o_totalprice") > 1000)


_DESCRIBE = """
 select 'o_totalprice' as field, count(o_totalprice)::varchar as count, null::varchar as "unique", null::varchar as top, null::varchar as freq,
  printf('%.2f', avg(o_totalprice)) as mean, printf('%.2f', stddev_pop(o_totalprice)) as std, printf('%.2f', min(o_totalprice)) as min,
  printf('%.2f', quantile_cont(o_totalprice, {0})) as "25%", printf('%.2f', quantile_cont(o_totalprice, {1})) as "50%", printf('%.2f', quantile_cont(o_totalprice, {2})) as "75%", printf('%.2f', max(o_totalprice)) as max from orders
"""


@query(_DESCRIBE.format(0.0025, 0.005, 0.0075))
def describe_numeric(spark, d):
    return G.describe(table(spark, d, "orders"), include=["o_totalprice"])


@query(_DESCRIBE.format(0.25, 0.5, 0.75))
def describe_quartiles(spark, d):
    return G.describe(table(spark, d, "orders"), include=["o_totalprice"], true_quartiles=True)


@query("select 'o_orderpriority' as field, sum(n)::varchar as count, count(*)::varchar as \"unique\", arg_min(v, (-n, v)) as top, max(n)::varchar as freq, null::varchar as mean, null::varchar as std, null::varchar as min, null::varchar as \"25%\", null::varchar as \"50%\", null::varchar as \"75%\", null::varchar as max from (select o_orderpriority as v, count(*) as n from orders group by 1)")
def describe_string(spark, d):
    return G.describe(table(spark, d, "orders"), include=["o_orderpriority"])


@query("select o_orderpriority, max(o_totalprice) - min(o_totalprice) as price_range from orders group by 1")
def aggregate_custom(spark, d):
    import pandas as pd

    def spread(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderpriority": p["o_orderpriority"].head(1), "price_range": p["o_totalprice"].max() - p["o_totalprice"].min()})

    # The least and greatest of each customer first: a priority's group then is no larger than twice the customers.
    small = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")).select("o_orderpriority", F.explode(F.array("a", "b")).alias("o_totalprice"))
    return G.aggregate_custom(small, ["o_orderpriority"], spread, "o_orderpriority string, price_range double")


# ---- spans ------------------------------------------------------------------------------------------------------------

_SPANS = """
 with marked as (select *, event_id_rank - 1 as row_number, case when event_id_rank > 1 and event_type is distinct from before then 1 else 0 end as new
   from (select *, row_number() over (order by event_id) as event_id_rank, lag(event_type) over (order by event_id) as before from events)),
 spans as (select *, sum(new) over (order by event_id)::bigint as span_id from marked)
"""


def _event_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.with_spans(table(spark, d, "events").select("event_id", "event_type", "value", "props"), ["event_type"], ["event_id"])


@query(_SPANS + "select event_id, row_number, span_id from spans")
def span_ids(spark, d):
    return _event_spans(spark, d).select("event_id", "row_number", "span_id")


@query(_SPANS + "select span_id, count(*) as count, min(value) as min, max(value) as max, arg_min(value, row_number) as first, arg_max(value, row_number) as last from spans group by span_id")
def span_aggregates(spark, d):
    return S.span_aggregate(_event_spans(spark, d), {"count": ("count", None), "min": ("min", "value"), "max": ("max", "value"), "first": ("first", "value"), "last": ("last", "value")})


@query(_SPANS + "select span_id, arg_min(row_number, (value, row_number)) as at_min, arg_min(row_number, (-value, row_number)) as at_max, min(row_number) as at_first, max(row_number) as at_last from spans group by span_id")
def span_indices(spark, d):
    return S.span_aggregate(_event_spans(spark, d), {"at_min": ("index_of_min", "value"), "at_max": ("index_of_max", "value"), "at_first": ("index_of_first", None), "at_last": ("index_of_last", None)})


@query(_SPANS + """select span_id, coalesce(string_agg(case when contains(props, ',') or contains(props, '"') then '"' || replace(props, '"', '""') || '"' else props end, ',' order by row_number) filter (where props <> ''), '') as props from spans group by span_id""")
def span_concat(spark, d):
    return S.span_aggregate(_event_spans(spark, d), {"props": ("concat", "props")})


@query(_SPANS + "select event_id, lead(span_id) over (order by event_id) is distinct from span_id as is_last from spans")
def last_in_run(spark, d):
    return S.last_in_run(_event_spans(spark, d)).select("event_id", "is_last")


@query("select event_id, row_number() over (partition by event_type order by event_id) = 1 as is_first from events")
def first_occurrence(spark, d):
    return R.first_occurrence(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "is_first")


@query("select event_id, max(value) over (partition by user_id) as user_max from events")
def group_transform_max(spark, d):
    return S.group_transform(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], F.max("value"), "user_max").select("event_id", "user_max")


# ---- joins ------------------------------------------------------------------------------------------------------------


@query("select o.o_orderkey, coalesce(l.l_linenumber, 0) as l_linenumber, coalesce(l.l_returnflag, '') as l_returnflag, l.l_orderkey is not null as valid_r from orders o left join lineitem l on o.o_orderkey = l.l_orderkey")
def merge_left(spark, d):
    return M.merge(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "left", ["o_orderkey"], ["l_linenumber", "l_returnflag"])


@query("select coalesce(l.l_linenumber, 0) as l_linenumber, o.o_orderkey, l.l_orderkey is not null as valid_l from lineitem l right join orders o on o.o_orderkey = l.l_orderkey")
def merge_right(spark, d):
    return M.merge(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey", "right", ["l_linenumber"], ["o_orderkey"])


@query("select o_orderkey, o_orderpriority, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def merge_inner(spark, d):
    return M.merge(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "inner", ["o_orderkey", "o_orderpriority"], ["l_linenumber", "l_quantity"])


@query("select coalesce(c_custkey, 0) as c_custkey, coalesce(user_id, 0) as user_id, c_custkey is not null as valid_l, user_id is not null as valid_r from customer full join (select distinct user_id from events) e on c_custkey = user_id")
def merge_outer(spark, d):
    return M.merge(table(spark, d, "customer"), table(spark, d, "events").select("user_id").distinct(), "c_custkey", "user_id", "outer", ["c_custkey"], ["user_id"])


@query("select a.l_orderkey, a.l_linenumber, a.l_quantity as l_quantity_l, b.l_quantity as l_quantity_r from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
def merge_compound(spark, d):
    l = table(spark, d, "lineitem")
    return M.merge(l, l, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"], "inner", ["l_orderkey", "l_linenumber", "l_quantity"], ["l_quantity"])


@query("select n.n_name as name_l, r.r_name as name_r, n.n_nationkey from nation n left join region r on n.n_regionkey = r.r_regionkey")
def merge_suffix(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_name", "name")
    r = table(spark, d, "region").withColumnRenamed("r_name", "name")
    return M.merge(n, r, "n_regionkey", "r_regionkey", "left", ["name", "n_nationkey"], ["name"]).drop("valid_r")


@query("select n_name, r_name from nation cross join region")
def merge_cross(spark, d):
    return M.merge(table(spark, d, "nation"), table(spark, d, "region"), how="cross", left_fields=["n_name"], right_fields=["r_name"])


@query("select o_orderkey, c_mktsegment, true as valid_r from orders join customer on o_custkey = c_custkey")
def ordered_merge_left(spark, d):
    return M.ordered_merge_left(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", right_unique=True, left_fields=["o_orderkey"], right_fields=["c_mktsegment"])


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey) as has_lines from orders")
def fk_exists(spark, d):
    return M.key_exists(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "has_lines")


@query("""
 with pk as (select l_orderkey, row_number() over (order by l_orderkey) - 1 as place from (select distinct l_orderkey from lineitem)),
 found as (select o_orderkey, place from orders left join pk on o_orderkey = l_orderkey)
 select o_orderkey, coalesce(place, 4611686018427387904 + row_number() over (partition by place is null order by o_orderkey) - 1) as index from found
""")
def get_index(spark, d):
    keys = O.number_rows(table(spark, d, "lineitem").select("l_orderkey").distinct(), [F.col("l_orderkey")], "at")
    orders = table(spark, d, "orders").select("o_orderkey")
    return M.get_index(orders, keys, "o_orderkey", "l_orderkey", "o_orderkey", "at")


@query("""
 with k as (select row_number() over (order by key) - 1 as shared_index, key from (select c_custkey as key from customer union select user_id from events))
 select event_id, shared_index from events join k on key = user_id
""")
def shared_index(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return M.shared_index([(table(spark, d, "customer").select("c_custkey"), "c_custkey"), (events, "user_id")])[1].select("event_id", "shared_index")


@query("select c_custkey, coalesce(arg_max(o_totalprice, o_orderkey), 0) as latest_price from customer left join orders on c_custkey = o_custkey group by c_custkey")
def session_join(spark, d):
    return M.join_by_row(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "o_totalprice", "o_orderkey", "latest_price")


# ---- order ------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_custkey, o_orderkey) - 1 as position from orders")
def sort_index(spark, d):
    return O.sort_index(table(spark, d, "orders"), ["o_orderpriority", "o_custkey"], "o_orderkey")


@query("select o_orderkey, o_orderpriority, o_custkey from orders order by o_orderpriority, o_custkey, o_orderkey")
def sort_values(spark, d):
    return O.sort_values(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), ["o_orderpriority", "o_custkey"], ["o_orderkey"])


@query("select row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position, o_orderkey, o_totalprice from orders")
def apply_index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    index = O.number_rows(orders, [-F.col("o_totalprice"), F.col("o_orderkey")], "position").select("position", F.col("o_orderkey").alias("source"))
    return O.apply_index(orders, index, "o_orderkey")


@query("select bool_and(coalesce(before <= ts, true)) as is_sorted from (select ts, lag(ts) over (order by event_id) as before from events)")
def is_sorted(spark, d):
    return O.is_sorted(table(spark, d, "events"), ["ts"], "event_id")


# ---- dates, text, versions --------------------------------------------------------------------------------------------


@query("select event_id, cast(floor((epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 86400000000.0) as integer) as day, ts < timestamp '2024-01-15' as in_range from events")
def days_since_start(spark, d):
    return D.get_days(table(spark, d, "events").select("event_id", "ts"), "ts", end=datetime(2024, 1, 15)).select("event_id", "day", "in_range")


@query("with d as (select event_id, cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 86400000000.0) as integer) as day from events) select event_id, cast(case when day between 0 and 20 then day // 7 else -1 end as integer) as period from d")
def period_offsets(spark, d):
    offsets = D.period_offsets(D.get_periods(datetime(2024, 1, 1), datetime(2024, 1, 22), "week"))
    days = D.get_days(table(spark, d, "events").select("event_id", "ts"), "ts", start=datetime(2024, 1, 1))
    return days.select("event_id", D.get_period_offset(F.col("day"), offsets, F.col("in_range")).alias("period"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%d %H:%M:%S') as second, epoch_us(ts) as parsed_us from events")
def timestamp_text(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    written = table(spark, d, "events").select("event_id", F.concat(text, F.lit("+00:00")).alias("t"))
    return written.select("event_id", X.timestamp_to_day(F.col("t")).alias("day"), X.datetime_to_seconds(F.col("t")).alias("second"), F.unix_micros(X.parse_timestamp_text(F.col("t"))).alias("parsed_us"))


@query("""
 with new_rows as (select o_custkey as id, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1),
 old_rows as (select o_custkey as id, arg_min(o_orderstatus, o_orderkey) as status from orders where o_orderdate < timestamp '1995-01-01' group by 1)
 select o.id, o.status, 0 as starts, case when n.id is not null and n.status is distinct from o.status then 100 else 32503680000 end as ends from old_rows o left join new_rows n using (id)
 union all select n.id, n.status, 100, 32503680000 from new_rows n left join old_rows o using (id) where o.id is null or n.status is distinct from o.status
""")
def journal_snapshot(spark, d):
    orders = table(spark, d, "orders")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    early = orders.filter(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    old = early.groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status")).select("id", "status", at(0).alias("j_valid_from"), at(32503680000).alias("j_valid_to"))
    new = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status")).select("id", "status", at(100).alias("j_valid_from"))
    out = J.journal_table(old, new, "id")
    return out.select("id", "status", F.unix_seconds("j_valid_from").alias("starts"), F.unix_seconds("j_valid_to").alias("ends"))


@query("select cast(n_nationkey as integer) as n_nationkey, n_name, cast(n_regionkey as integer) as n_regionkey from nation")
def csv_round_trip(spark, d):
    from cohortloom.sources.csv import Field, read_csv, to_csv

    folder = _folder(spark, d, "csv_round_trip")
    to_csv(table(spark, d, "nation"), folder)
    schema = {"n_nationkey": Field("numeric", "int32", validation_mode="strict"), "n_name": Field("string"), "n_regionkey": Field("numeric", "int32", validation_mode="strict")}
    return read_csv(spark, folder, schema, journal=False)


# ---- further forms of the operators above -----------------------------------------------------------------------------


@query("select c_mktsegment, o_orderkey, c_custkey is not null as valid_l from customer right join orders on c_custkey = o_custkey")
def ordered_merge_right(spark, d):
    return M.ordered_merge_right(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", left_unique=True, left_fields=["c_mktsegment"], right_fields=["o_orderkey"])


@query("select c_mktsegment, o_orderkey from customer join orders on c_custkey = o_custkey")
def ordered_merge_inner(spark, d):
    return M.ordered_merge_inner(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", left_unique=True, left_fields=["c_mktsegment"], right_fields=["o_orderkey"])


@query("select p_partkey, row_number() over (order by p_retailprice, p_partkey) - 1 as position from part")
def argsort(spark, d):
    return O.sort_index(table(spark, d, "part"), ["p_retailprice"], "p_partkey")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def groupby_distinct(spark, d):
    return G.GroupBy(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).distinct()


@query("select o_custkey, min(o_orderpriority) as o_orderpriority_min, min(o_orderdate) as o_orderdate_min from orders group by 1")
def groupby_min_text_and_time(spark, d):
    return G.GroupBy(table(spark, d, "orders"), "o_custkey").min(["o_orderpriority", "o_orderdate"])


@query("""
 with marked as (select event_id, case when row_number() over w > 1 and (event_type is distinct from lag(event_type) over w or user_id is distinct from lag(user_id) over w) then 1 else 0 end as new from events window w as (order by event_id))
 select event_id, sum(new) over (order by event_id)::bigint as span_id from marked
""")
def span_multi_keys(spark, d):
    return S.with_spans(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"], ["event_id"]).select("event_id", "span_id")


@query("with t as (select n_nationkey, case n_nationkey % 4 when 0 then ' Yes' when 1 then 'off' when 2 then '1' else n_name end as v from nation) select n_nationkey, case when lower(trim(v)) in ('1', 'y', 't', 'on', 'yes', 'true') then true when lower(trim(v)) in ('0', 'n', 'f', 'off', 'no', 'false') then false end as parsed from t")
def parse_bool(spark, d):
    k = F.col("n_nationkey") % 4
    v = F.when(k == 0, " Yes").when(k == 1, "off").when(k == 2, "1").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.parse_bool(v).alias("parsed"))


@query("select record_id, try_cast(nullif(trim(split_part(raw_text, ',', 6)), '') as integer) as height from raw_records where file_name = 'users.csv' and raw_text not like '%\"%' and regexp_full_match(trim(split_part(raw_text, ',', 6)), '[+-]?[0-9]+')")
def parse_numbers(spark, d):
    cells = F.split(F.col("raw_text"), ",")
    raw = table(spark, d, "raw_records").filter((F.col("file_name") == "users.csv") & ~F.col("raw_text").contains('"'))
    height = X.parse_number(F.try_element_at(cells, F.lit(6)), "int")
    return raw.select("record_id", height.alias("height")).filter("height is not null")


@query(f"""
 select record_id, case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(ltrim(v, '+') as integer) end as height
 from (select record_id, case when record_id not in (select record_id from ({RECORDS_SQL}) where reason <> 'bad_value') then trim({cell_sql(5)}) end as v from raw_records where file_name = 'users.csv')
""")
def parse_numbers_all(spark, d):
    """parse_numbers over every record of users.csv, quoted cells too: null where the cell, or the record, can't be read."""
    raw = table(spark, d, "raw_records").filter(F.col("file_name") == P.USERS_CSV.file_name)
    cells = bound(raw, "_cells", F.when(P.well_quoted(F.col("raw_text")), P.cells_of(F.col("raw_text"))))
    names = [name for name, _ in P.USERS_CSV.columns]
    height = F.when(F.size("_cells") == len(names), X.parse_number(F.try_element_at("_cells", F.lit(names.index("height_cm") + 1)), "int"))
    return cells.select("record_id", height.alias("height"))


@query("select id, cast(case tested_covid_positive when 1 then 9 when 2 then 0 when 3 then 1 else -1 end as integer) as recoded from (select distinct id, tested_covid_positive from assessments)")
def category_map(spark, d):
    codes = X.map_categories({"": 0, "waiting": 1, "no": 2, "yes": 3}, {"": -1, "waiting": 9, "no": 0, "yes": 1})
    lookup = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    a = table(spark, d, "assessments").select("id", "tested_covid_positive").distinct()
    return a.select("id", F.coalesce(F.try_element_at(lookup, F.col("tested_covid_positive").cast("int")), F.lit(-1)).alias("recoded"))


@query("select n_nationkey, coalesce(list_max(list_transform(regexp_extract_all(n_name, 'A+'), lambda x: length(x))), 0)::integer as longest from nation")
def longest_run(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.longest_run(F.col("n_name"), "A").alias("longest"))


@query("select id, epoch_us(strptime(date, '%Y-%m-%d %H:%M:%S.%f+00:00')) as at_us from (select distinct id, date from assessments) where regexp_full_match(date, '[0-9-]{10} [0-9:]{8}[.][0-9]{6}[+]00:00')")
def string_to_datetime(spark, d):
    a = table(spark, d, "assessments").select("id", "date").distinct().filter(F.col("date").rlike(r"^[0-9-]{10} [0-9:]{8}[.][0-9]{6}[+]00:00\z"))
    return a.select("id", F.unix_micros(X.string_to_datetime(F.col("date"))).alias("at_us"))


@query("select event_id, value from events where value > 50")
def dataset_copy(spark, d):
    """A table written to a dataset, copied to another one and read back."""
    from cohortloom.sources.dataset import Session

    base = _folder(spark, d, "dataset_copy")
    with Session(spark) as s:
        a, b = s.open_dataset(base + "-a", "w", "a"), s.open_dataset(base + "-b", "w", "b")
        a["events"] = R.apply_filter(table(spark, d, "events").select("event_id", "value"), F.col("value") > 50)
        return a.move("events", b, "kept")


# ---- importers: text files written first, then read by a schema --------------------------------------------------------


def _imported(spark: SparkSession, d: str, name: str, df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    from cohortloom.sources.csv import read_csv, to_csv
    from cohortloom.sources.schema import load_schema

    folder = _folder(spark, d, name)
    to_csv(df, folder)
    schema = load_schema({"cohortloom": {"version": "1.1.0"}, "schema": {name: {"fields": fields}}})
    return read_csv(spark, folder, schema[name], journal=False)


@query("select c_custkey, case when c_custkey % 5 in (0, 1) then -1.5 else c_acctbal end::double as balance, c_custkey % 5 not in (0, 1) as balance_valid, case when c_custkey % 3 = 0 then -2147483648 else c_nationkey end::integer as nation, c_custkey % 3 <> 0 as nation_known, case when c_custkey % 3 = 0 then 0 else c_nationkey end::smallint as plain, case c_custkey % 4 when 0 then true else false end as flag, c_custkey % 4 < 2 as flag_valid from customer")
def import_numbers(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 5 == 1, "n/a").when(k % 5 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(k % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("+"), F.col("c_nationkey").cast("string"))).alias("plain"), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "f").when(k % 4 == 2, "maybe").otherwise("").alias("flag"),
    )
    number = lambda kind, **more: {"field_type": "numeric", "value_type": kind, **more}
    return _imported(spark, d, "import_numbers", df, {
        "c_custkey": number("int64", validation_mode="strict"), "balance": number("float64", validation_mode="relaxed", invalid_value=-1.5), "nation": number("int32", invalid_value="min", flag_field_name="_known"),
        "plain": number("int16", create_flag_field=False), "flag": number("bool", validation_mode="relaxed"),
    })


@query("select c_custkey, c_name || ', \"' || c_mktsegment || '\"' as label, substr(c_mktsegment, 1, 6) as short from customer")
def import_text(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), F.col("c_mktsegment").alias("short"))
    return _imported(spark, d, "import_text", df, {"c_custkey": {"field_type": "numeric", "value_type": "int64", "validation_mode": "strict"}, "label": {"field_type": "string"}, "short": {"field_type": "fixed_string", "length": 6}})


@query("select o_orderkey, case when o_orderkey % 4 = 3 then 0 else epoch_us(date_trunc('second', o_orderdate)) + case when o_orderkey % 4 = 1 then 250000 else 0 end end as at_us, o_orderkey % 4 <> 3 as at_set, case when o_orderkey % 4 = 3 then '' else strftime(o_orderdate, '%Y-%m-%d') end as at_day, epoch_us(date_trunc('day', o_orderdate)) as on_us from orders")
def import_times(spark, d):
    k, at = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, at).when(k == 1, F.concat(at, F.lit(".250000+00:00"))).when(k == 2, F.concat(at, F.lit("UTC"))).otherwise("")
    df = table(spark, d, "orders").select("o_orderkey", text.alias("at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("on"))
    out = _imported(spark, d, "import_times", df, {"o_orderkey": {"field_type": "numeric", "value_type": "int64", "validation_mode": "strict"}, "at": {"field_type": "datetime", "create_day_field": True, "create_flag_field": True}, "on": {"field_type": "date"}})
    return out.select("o_orderkey", F.unix_micros("at").alias("at_us"), "at_set", "at_day", F.unix_micros("on").alias("on_us"))


@query("select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 1000 when '2-HIGH' then -2 else 0 end as smallint) as priority, cast(case o_orderstatus when 'O' then 1 when 'F' then 2 else -1 end as tinyint) as status, case when o_orderstatus in ('O', 'F') then '' else o_orderstatus end as status_other from orders")
def import_categories(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    category = lambda kind, labels, **more: {"field_type": "categorical", "categorical": {"value_type": kind, "strings_to_values": labels, **more}}
    return _imported(spark, d, "import_categories", df, {"o_orderkey": {"field_type": "numeric", "value_type": "int64", "validation_mode": "strict"}, "priority": category("int16", {"": 0, "1-URGENT": 1000, "2-HIGH": -2}), "status": category("int8", {"": 0, "O": 1, "F": 2}, out_of_range="other")})


@query("select r_regionkey::integer as r_regionkey, r_name from region where r_regionkey <> 2")
def import_set_apart(spark, d):
    """A file with unreadable lines: the valid ones, while the others are set apart."""
    from cohortloom.sources.csv import Field, read_csv_set_apart

    folder = _folder(spark, d, "import_set_apart")
    lines = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 2, F.concat(F.lit('2,"'), "r_name")).otherwise(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name")).alias("value"))
    spark.createDataFrame([("r_regionkey,r_name",)], "value string").union(lines).coalesce(1).write.mode("overwrite").text(folder)
    return read_csv_set_apart(spark, folder, {"r_regionkey": Field("numeric", "int32", flag=False)}, "regions", journal=False)[0]


# ---- whole results of operators that the queries above show in part ----------------------------------------------------


@query("with t as (select o_orderkey, o_orderkey * 1000000000001 - 7 as a from orders), b as (select unnest([7, -7])::bigint as b) select o_orderkey, b, a // b - case when a % b <> 0 and (a % b < 0) <> (b < 0) then 1 else 0 end as quotient, a % b + case when a % b <> 0 and (a % b < 0) <> (b < 0) then b else 0 end as remainder from t, b")
def arith_divmod(spark, d):
    """Beyond 2**53, where doubles would round."""
    a = F.col("o_orderkey") * F.lit(1_000_000_000_001) - 7
    both = table(spark, d, "orders").select("o_orderkey", a.alias("a"), F.explode(F.array(F.lit(7).cast("bigint"), F.lit(-7).cast("bigint"))).alias("b"))
    return both.withColumn("x", A.divmod_(F.col("a"), F.col("b"))).select("o_orderkey", "b", "x.quotient", "x.remainder")


@query("select l_orderkey, l_linenumber, l_extendedprice / l_quantity as quotient, floor(l_extendedprice / l_quantity) as floored, floor(-l_extendedprice / l_quantity) as floored_down, l_discount = 0 as by_zero from lineitem")
def arith_quotient(spark, d):
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    by_zero = A.true_divide(y, F.col("l_discount")) == float("inf")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.true_divide(x, y).alias("quotient"), A.floor_divide(x, y, whole=False).alias("floored"), A.floor_divide(-x, y, whole=False).alias("floored_down"), by_zero.alias("by_zero"))


@query("select c_custkey, case c_custkey % 7 when 0 then 1.5 when 1 then null when 2 then 0.5 when 3 then -200.0 when 4 then null when 5 then 7.0 else null end::double as parsed from customer")
def parse_floats(spark, d):
    texts = F.array(*[F.lit(x) for x in ("1.5", "1d", " .5", "-2e2", "0x1p3", "7.", "")])
    return table(spark, d, "customer").select("c_custkey", X.parse_number(F.element_at(texts, (F.col("c_custkey") % 7 + 1).cast("int")), "double").alias("parsed"))


@query("select o_orderkey, case when o_orderkey % 4 = 3 then null else epoch_us(date_trunc('second', o_orderdate)) + case o_orderkey % 4 when 0 then 250000 when 1 then -7200000000 else 0 end end as at_us from orders")
def string_to_datetime_all(spark, d):
    """All writings, offsets honoured; other text is null."""
    k, at = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, F.concat(at, F.lit(".250000+00:00"))).when(k == 1, F.concat(at, F.lit("+02:00"))).when(k == 2, at).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(X.string_to_datetime(text)).alias("at_us"))


@query("select max(o_totalprice) as o_totalprice_max from orders group by o_custkey")
def groupby_without_keys(spark, d):
    return G.GroupBy(table(spark, d, "orders"), "o_custkey").max("o_totalprice", write_keys=False)


@query("select o_custkey, max(o_totalprice) - min(o_totalprice) as price_range, count(*) as n from orders group by 1")
def aggregate_custom_groups(spark, d):
    """A function of one's own over whole groups."""
    import pandas as pd

    def spread(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_custkey": p["o_custkey"].head(1), "price_range": p["o_totalprice"].max() - p["o_totalprice"].min(), "n": len(p)})

    return G.aggregate_custom(table(spark, d, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], spread, "o_custkey bigint, price_range double, n bigint")


@query("select coalesce(c_custkey, 0) as c_custkey, coalesce(c_mktsegment, '') as c_mktsegment, coalesce(o_orderkey, 0) as o_orderkey, coalesce(o_totalprice, 0) as o_totalprice, c_custkey is not null as valid_l, o_orderkey is not null as valid_r from (select * from customer where c_custkey % 3 > 0) c full join (select * from orders where o_totalprice > 1000) o on c_custkey = o_custkey")
def merge_outer_rows(spark, d):
    """Several rows for a key, and keys that either side lacks."""
    c, o = table(spark, d, "customer").filter("c_custkey % 3 > 0"), table(spark, d, "orders").filter("o_totalprice > 1000")
    return M.merge(c, o, "c_custkey", "o_custkey", "outer", ["c_custkey", "c_mktsegment"], ["o_orderkey", "o_totalprice"])


@query("select n.n_name as name_l, coalesce(r.r_name, '') as name_r, n.n_nationkey, r.r_name is not null as valid_r from nation n left join (select * from region where r_regionkey < 3) r on n.n_regionkey = r.r_regionkey")
def merge_suffix_valid(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_name", "name")
    r = table(spark, d, "region").withColumnRenamed("r_name", "name").filter("r_regionkey < 3")
    return M.merge(n, r, "n_regionkey", "r_regionkey", "left", ["name", "n_nationkey"], ["name"])


@query("select o_custkey as row, o_orderkey, c_mktsegment as segment from orders left join customer on c_custkey = o_custkey")
def copy_field(spark, d):
    source = table(spark, d, "customer").select(F.col("c_custkey").alias("row"), "c_mktsegment")
    return R.copy_column(source, "c_mktsegment", table(spark, d, "orders").select(F.col("o_custkey").alias("row"), "o_orderkey"), "row", "segment")


@query("select n_nationkey as row, n_regionkey, n_name as title from nation")
def move_field(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "row")
    rest, moved = R.move_column(nation.select("row", "n_name"), "n_name", nation.select("row", "n_regionkey"), "row", "title")
    assert rest.columns == ["row"]
    return moved


@query("""
 with m as (select row_number() over w - 1 as start, event_type is distinct from lag(event_type) over w or user_id is distinct from lag(user_id) over w or event_id = min(event_id) over () as new from events window w as (order by event_id))
 select start from m where new union all select count(*) from events
""")
def span_union(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    a, b = (S.span_starts(S.with_spans(events, [k], ["event_id"])) for k in ("event_type", "user_id"))
    return S.union_spans(a, b)


@query("select bool_and(coalesce(before <= now, true)) as is_sorted from (select (event_type, event_id) as now, lag((event_type, event_id)) over (order by event_id) as before from events)")
def is_sorted_multi(spark, d):
    return O.is_sorted(table(spark, d, "events"), ["event_type", "event_id"], "event_id")


_JOURNAL = """
 select '{0}' as field, * from (
 with new_rows as (select o_custkey as id, arg_max({0}, o_orderkey) as value from orders group by 1),
 old_rows as (select o_custkey as id, arg_min({0}, o_orderkey) as value from orders where o_orderkey % 3 = 0 group by 1)
 select o.id, o.value, 0 as starts, case when n.value is distinct from o.value then 100 else 32503680000 end as ends from old_rows o left join new_rows n using (id)
 union all select n.id, n.value, 100, 32503680000 from new_rows n left join old_rows o using (id) where o.id is null or n.value is distinct from o.value)
"""


@query(_JOURNAL.format("o_orderstatus") + " union all " + _JOURNAL.format("o_orderpriority"))
def journal_all_tables(spark, d):
    orders, at = table(spark, d, "orders"), lambda s: F.timestamp_seconds(F.lit(s))
    old, new = {}, {}
    for f in ("o_orderstatus", "o_orderpriority"):
        old[f] = orders.filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by(f, "o_orderkey").alias("value")).select("id", "value", at(0).alias("j_valid_from"), at(32503680000).alias("j_valid_to"))
        new[f] = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by(f, "o_orderkey").alias("value")).select("id", "value", at(100).alias("j_valid_from"))
    both = J.journal_datasets(old, new, {"o_orderstatus": "id", "o_orderpriority": "id"})
    parts = [df.select(F.lit(f).alias("field"), "id", "value", F.unix_seconds("j_valid_from").alias("starts"), F.unix_seconds("j_valid_to").alias("ends")) for f, df in both.items()]
    return parts[0].unionByName(parts[1])


@query("select event_id, event_type, value from events")
def dataset_copy_all(spark, d):
    """Every row of a table, through a dataset into a table made like it in another one."""
    from cohortloom.sources.dataset import Session

    base = _folder(spark, d, "dataset_copy_all")
    with Session(spark) as s:
        a, b = s.open_dataset(base + "-a", "w", "a"), s.open_dataset(base + "-b", "w", "b")
        a["events"] = table(spark, d, "events").select("event_id", "event_type", "value")
        b.create_like("kept", a["events"])
        return b.create("kept", a["events"], "append")


_SHOWN = """
 select '{0}' as field, count({0})::varchar as count, null::varchar as "unique", null::varchar as top, null::varchar as freq, printf('%.2f', avg({1})) as mean, printf('%.2f', stddev_pop({1})) as std, printf('%.2f', min({1})) as min,
  printf('%.2f', quantile_cont({1}, 0.0025)) as "25%", printf('%.2f', quantile_cont({1}, 0.005)) as "50%", printf('%.2f', quantile_cont({1}, 0.0075)) as "75%", printf('%.2f', max({1})) as max from orders
"""


@query(_SHOWN.format("o_orderkey", "o_orderkey::double") + " union all " + _SHOWN.format("o_custkey", "o_custkey::double") + " union all " + _SHOWN.format("o_totalprice", "o_totalprice") + " union all " + _SHOWN.format("o_orderdate", "epoch(o_orderdate)::double"))
def describe_default(spark, d):
    """All numeric and time fields."""
    return G.describe(table(spark, d, "orders"))
