"""Operators on small tables, against plain Python over the same rows."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from cohortloom.functions import arithmetic as A, dates as D, text as X
from cohortloom.operators import aggregate as G, frame as R, journal as J, merge as M, order as O, spans as S
from cohortloom.types import Kind, bounds


def column(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"rid int, v {kind}")


def boats(seed, n=60):
    """(rid, harbour, catch) of landings, in runs of one harbour."""
    rng, out, harbour = random.Random(seed), [], 0
    for rid in range(n):
        harbour = rng.randrange(5) if rng.random() < 0.4 else harbour
        out.append((rid, harbour, rng.randrange(-30, 30)))
    return out


def test_group_by(spark, as_rows):
    data = boats(1)
    df = spark.createDataFrame(data, "rid int, harbour int, catch int")
    g = G.GroupBy(df, "harbour", order=["rid"])
    by = defaultdict(list)
    for _, h, c in data:
        by[h].append(c)
    for op, f in (("max", max), ("min", min), ("first", lambda x: x[0]), ("last", lambda x: x[-1])):
        assert as_rows(getattr(g, op)("catch")) == sorted((h, f(c)) for h, c in by.items())
    assert as_rows(g.count()) == sorted((h, len(c)) for h, c in by.items())
    assert as_rows(G.drop_duplicates(df, "harbour")) == sorted((h,) for h in by)
    pairs = Counter((h, c) for _, h, c in data)
    assert as_rows(G.GroupBy(df, ["harbour", "catch"]).count()) == sorted((*k, n) for k, n in pairs.items())
    assert g.max("catch", write_keys=False).columns == ["catch_max"]
    with pytest.raises(ValueError):
        g.max("harbour")
    with pytest.raises(ValueError):
        G.GroupBy(df, "harbour").first("catch")


def test_spans(spark):
    data = boats(2)
    df = spark.createDataFrame(data, "rid int, k int, v int")
    s = S.with_spans(df, ["k"], ["rid"])
    ops = {"n": ("count", None), "lo": ("min", "v"), "hi": ("max", "v"), "a": ("first", "v"), "z": ("last", "v"), "ilo": ("index_of_min", "v"), "ihi": ("index_of_max", "v"), "i0": ("index_of_first", None), "i1": ("index_of_last", None)}
    got = sorted(tuple(r) for r in S.span_aggregate(s, ops).collect())
    want = []
    for k, (_, run) in enumerate(groupby(data, lambda r: r[1])):
        run = list(run)
        v = [r[2] for r in run]
        want.append((k, len(v), min(v), max(v), v[0], v[-1], run[v.index(min(v))][0], run[v.index(max(v))][0], run[0][0], run[-1][0]))
    assert got == want
    assert {r.rid for r in S.last_in_run(s).filter("is_last").collect()} == {w[-1] for w in want}
    one = S.with_spans(column(spark, [4, 4, 7, 4, None, None]), ["v"], ["rid"])
    assert [r.span_id for r in one.orderBy("rid").collect()] == [0, 0, 1, 2, 3, 3]
    assert S.with_spans(df.limit(0), ["k"], ["rid"]).collect() == []


def test_union_of_boundaries(spark):
    data = boats(3)
    df = spark.createDataFrame([(r, h, c // 20) for r, h, c in data], "rid int, k int, v int")
    a, b, both = (S.with_spans(df, keys, ["rid"]) for keys in (["k"], ["v"], ["k", "v"]))
    union = S.union_spans(S.span_starts(a), S.span_starts(b))
    assert sorted(r.start for r in union.collect()) == sorted(r.start for r in S.span_starts(both).collect())
    again = S.spans_from(a.select("rid", "row_number"), union)
    assert {r.rid: r.span_id for r in again.collect()} == {r.rid: r.span_id for r in both.collect()}
    with pytest.raises(Exception, match="empty"):
        S.spans_from(a.select("rid", "row_number"), union.union(union)).collect()
    assert S.span_starts(a.limit(0)).collect() == []


def test_span_concat_quotes(spark):
    data = [(0, 0, "pike"), (1, 0, "eel,smoked"), (2, 1, "carp"), (3, 2, ""), (4, 2, 'the "big" one'), (5, 3, "")]
    s = S.with_spans(spark.createDataFrame(data, "rid int, k int, v string"), ["k"], ["rid"])
    assert sorted(tuple(r) for r in S.span_aggregate(s, {"c": ("concat", "v")}).collect()) == [(0, 'pike,"eel,smoked"'), (1, "carp"), (2, '"the ""big"" one"'), (3, "")]


def test_order(spark):
    rng = random.Random(4)
    values = [rng.randrange(9) for _ in range(40)]
    df = column(spark, values)
    places = {rid: k for k, (_, rid) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {tuple(r) for r in O.sort_index(df, ["v"], "rid").collect()} == set(places.items())
    index = spark.createDataFrame([(0, 12), (1, 30), (2, 12), (3, 99)], "position int, source int")
    assert sorted((r.position, r.v) for r in O.apply_index(df, index, "rid").collect()) == [(0, values[12]), (1, values[30]), (2, values[12])]
    assert not O.is_sorted(df, ["v"], "rid").collect()[0][0] and O.is_sorted(df.limit(0), ["v"], "rid").collect()[0][0]
    assert O.is_sorted(column(spark, [None, *sorted(values)]), ["v"], "rid").collect()[0][0]
    sums = {r.rid: r.total for r in O.running_sum(df, [F.col("rid")], F.col("v"), "total").collect()}
    assert sums == {i: sum(values[: i + 1]) for i in range(40)}
    with pytest.raises(ValueError):
        O.sort_values(df, ["v"], ascending=False)


def test_merges(spark, as_rows):
    rng = random.Random(6)
    ports = [(k,) for k in range(6)]
    ships = [(rng.choice([1, 3, 4, 8, None]), rng.choice(["Alke", "Möwe", ""])) for _ in range(14)]
    left, right = spark.createDataFrame(ports, "port int"), spark.createDataFrame(ships, "home int, ship string")
    inner = [(p, h, s) for (p,) in ports for h, s in ships if p == h]
    assert as_rows(M.merge(left, right, "port", "home", "inner")) == sorted(inner)
    alone = [(p, 0, "", False) for (p,) in ports if p not in {h for h, _ in ships}]
    assert as_rows(M.merge(left, right, "port", "home", "left")) == sorted([(*r, True) for r in inner] + alone)
    outer = M.merge(left, right, "port", "home", "outer", fill="null")
    assert Counter(tuple(r) for r in outer.filter("not valid_l").collect()) == Counter((None, False, h, s, True) for h, s in ships if h not in range(6))
    assert outer.count() == len(inner) + len(alone) + sum(h not in range(6) for h, _ in ships)
    clash = M.merge(left.withColumnRenamed("port", "ID"), right.withColumnRenamed("home", "id"), "ID", "id", "inner")
    assert clash.columns == ["ID_l", "id_r", "ship"]
    with pytest.raises(ValueError):
        M.merge(left, right, "port", "home", "sideways")
    with pytest.raises(ValueError):
        M.ordered_merge_left(left, right, "port", "home")
    with pytest.raises(Exception, match="repeats"):
        M.ordered_merge_left(left, right, "port", "home", right_unique=True).collect()


def test_foreign_keys(spark):
    pk = spark.createDataFrame([("oak", 0), ("elm", 1), ("elm", 2), (None, 3)], "k string, row int")
    fk = spark.createDataFrame([(0, "elm"), (1, "yew"), (2, "oak"), (3, "fir"), (4, "yew"), (5, None), (6, None)], "frow int, k string")
    got = {r.frow: r["index"] for r in M.get_index(fk, pk, "k", "k", "frow", "row").collect()}
    base = M.INVALID_INDEX
    assert got == {0: 2, 1: base, 2: 0, 3: base + 1, 4: base, 5: base + 2, 6: base + 2}
    assert {r.frow for r in M.key_exists(fk, pk, "k", "k").filter("exists").collect()} == {0, 2}
    words = [["elm", "fir", "oak"], ["oak", "oak", "ash", "yew", "elm"]]
    places = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    shared = M.shared_index([(spark.createDataFrame([(w,) for w in x], "k string"), "k") for x in words])
    for x, df in zip(words, shared):
        assert sorted((r.k, r.shared_index) for r in df.collect()) == sorted((w, places[w]) for w in x)
    dest = spark.createDataFrame([(i,) for i in range(5)], "row int")
    src = spark.createDataFrame([(0, 2, 17), (1, 2, 18), (2, 4, 19), (3, base, 11)], "o int, i bigint, v int")
    assert sorted((r.row, r.v) for r in M.join_by_row(dest, src, "row", "i", "v", "o").collect()) == [(0, 0), (1, 0), (2, 18), (3, 0), (4, 19)]


def at_month(m):
    return datetime(2019, 1, 1) + timedelta(days=31 * m)


END = datetime(3000, 1, 1)


def test_journal(spark, as_rows):
    rng = random.Random(9)
    old = [(k, rng.randrange(3), at_month(m), END) for k in "pqrstu" for m in range(rng.randrange(1, 4))]
    latest = {k: v for k, v, _, _ in old}
    new = [(k, latest[k] if k in "st" else rng.randrange(3), at_month(9)) for k in "rstuvw"]
    added = {(k, v) for k, v, _ in new if latest.get(k) != v}
    assert 0 < len(added) < len(new)
    a = spark.createDataFrame(old, "id string, val int, j_valid_from timestamp, j_valid_to timestamp")
    b = spark.createDataFrame(new, "id string, val int, j_valid_from timestamp")
    got = as_rows(J.journal_table(a, b, "id"))
    assert len(got) == len(old) + len(added) and {(r[0], r[1]) for r in got if r[2] == at_month(9)} == added
    closed = {(k, latest[k]) for k, _ in added if k in latest}
    assert {(r[0], r[1]) for r in got if r[3] == at_month(9)} == closed
    assert as_rows(J.journal_table(a, b, "id", close=False).select("id", "val")) == sorted((r[0], r[1]) for r in got)
    both = J.journal_datasets({"t": a, "u": a}, {"t": b, "u": b}, {"t": "id", "other": "id"})
    assert list(both) == ["t"] and as_rows(both["t"]) == got
    with pytest.raises(ValueError):
        J.journal_datasets({"t": a}, {"u": b}, {"t": "id"})


def test_arithmetic(spark):
    big = 2**60 + 1
    pairs = [(a, b) for a in (7, -7, 6, 0, big, -big) for b in (3, -3, 1, 0)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(A.floor_divide(a, b), A.modulo(a, b), A.divmod_(a, b), A.true_divide(a, b)).collect()]
    for (x, y), (q, r, both, t) in zip(pairs, got):
        assert (q, r) == ((x // y, x % y) if y else (None, None)) and (both.quotient, both.remainder) == (q, r)
        assert t == x / y if y else (math.isnan(t) if x == 0 else t == math.copysign(math.inf, x))
    floats = [(x, y) for x in (7.5, -7.5, 0.0, 1e300, math.inf) for y in (2.0, -2.0, 0.0, 0.1, 1e-9)]
    f = spark.createDataFrame(floats, "a double, b double").select(A.floor_divide(F.col("a"), F.col("b"), whole=False).alias("q")).collect()
    with np.errstate(all="ignore"):
        want = [float(np.floor_divide(np.float64(x), np.float64(y))) for x, y in floats]
    assert all(r.q == w or math.isclose(r.q, w, rel_tol=1e-12) or (math.isnan(r.q) and math.isnan(w)) for r, w in zip(f, want))
    values = [300, -200, 127, 0, -1]
    wide = spark.createDataFrame([(v, v + 0.75 if v >= 0 else v - 0.75) for v in values], "v int, d double")
    for nformat, t in (("int8", np.int8), ("uint8", np.uint8), ("int16", np.int16)):
        assert [r.v for r in R.astype(wide, "v", nformat).collect()] == np.array(values).astype(t).tolist()
    assert [r.d for r in R.astype(wide, "d", "int32").collect()] == values
    assert bounds("int16") == (-(2**15), 2**15 - 1) and bounds("uint16") == (0, 2**16 - 1) and bounds("float32") == (-(2**31), 2**31 - 1)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    swapped = R.rename(df, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a"] and swapped.collect()[0].a == 2
    with pytest.raises(ValueError):
        R.rename(df, {"a": "b"})
    with pytest.raises(ValueError):
        R.apply_filter(df.withColumn("s", F.lit("x")), "s")
    cat = R.assign(df, "c", F.lit(1), Kind("categorical", "int8", 0, {"calm": 1, "gale": 2}))
    assert R.keys(cat, "c") == {1: "calm", 2: "gale"}
    with pytest.raises(ValueError):
        R.remap(cat, "c", [(1, 5)], {"calm": 5})
    assert R.keys(R.remap(cat, "c", [(1, 5), (2, 6)], {"calm": 5, "gale": 6}), "c") == {5: "calm", 6: "gale"}
    assert [r[0] for r in spark.createDataFrame([("a",), (None,)], "s string").select(R.isin(F.col("s"), ["a", None])).collect()] == [True, False]
    with pytest.raises(TypeError):
        R.isin(F.col("a"), None)
    assert R.drop(df, "a").columns == ["b"]
    like = R.empty_like(cat, "c")
    assert like.collect() == [] and like.columns == ["c"] and R.keys(like, "c") == R.keys(cat, "c")


def test_columns_across_tables(spark):
    kind = Kind("categorical", "int16", 0, {"calm": 300, "gale": 2})
    a = R.assign(spark.createDataFrame([(0, 300), (1, 2), (5, 2)], "row int, w int"), "w", F.col("w"), kind)
    b = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row int, W string")
    out = R.copy_column(a, "w", b, "row")
    assert sorted((r.row, r.w) for r in out.collect()) == [(0, 300), (1, 2), (2, None)] and R.keys(out, "w") == {300: "calm", 2: "gale"}
    rest, moved = R.move_column(a, "w", b, "row", "wind")
    assert rest.columns == ["row"] and moved.columns == ["row", "W", "wind"]
    clash = b.withColumnsRenamed({"W": "_copied"}).withColumn("_row", F.lit(1))
    assert sorted((r.row, r.w, r._row) for r in R.copy_column(a, "w", clash, "row").collect()) == [(0, 300, 1), (1, 2, 1), (2, None, 1)]
    with pytest.raises(ValueError):
        R.copy_column(a, "nope", b, "row")


def test_categories_beyond_a_byte(spark):
    df = spark.createDataFrame([("calm",), ("gale",), ("fog",), (None,)], "s string")
    labels = {"calm": 300, "gale": -2}
    assert [r[0] for r in df.select(R.encode_categories(F.col("s"), labels, nformat="int16")).collect()] == [300, -2, 0, 0]
    code, text = R.encode_leaky(F.col("s"), labels, "int32")
    assert [tuple(r) for r in df.select(code, text).collect()] == [(300, ""), (-2, ""), (-1, "fog"), (-1, "")]


def test_text(spark):
    times = {"2018-09-03 14:20:05": 14, "2018-09-03 14:20:05UTC": 14, "2018-09-03 14:20:05.250000+00:00": 14, "2018-09-03 09:00:00+00.00": 9, "2018-09-03 14:20:05.5": None, "soon": None}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    got = df.select("t", F.hour(X.parse_timestamp_text(F.col("t"))).alias("h"), X.timestamp_to_day(F.col("t")).alias("d")).collect()
    assert {r.t: r.h for r in got} == times and {r.d for r in got} == {"2018-09-03", "soon"}
    one = spark.createDataFrame([("harbourage", "aßb", " oFF ", "eel,smoked", "xxyxxx")], "f string, u string, b string, q string, r string")
    r = one.select(X.cut_bytes(F.col("f"), 7), X.cut_bytes(F.col("u"), 2), X.parse_bool(F.col("b")), X.csv_quote(F.col("q")), X.longest_run(F.col("r"), "x")).collect()[0]
    assert tuple(r) == ("harbour", "a", False, '"eel,smoked"', 3)
    assert X.map_categories({"calm": 1}, {"calm": 4}) == {1: 4}


def test_numbers_in_text(spark):
    numbers = {"1.5": 1.5, " -2e3 ": -2000.0, ".5": 0.5, "7.": 7.0, "inf": math.inf, "-Infinity": -math.inf, "1d": None, "1.5f": None, "0x1p3": None, "1_0": None, "e5": None, "": None, "1e": None}
    df = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert {r.t: r.v for r in df.select("t", X.parse_number(F.col("t"), "double").alias("v")).collect()} == numbers
    assert math.isnan(spark.createDataFrame([("NaN",)], "t string").select(X.parse_number(F.col("t"), "double")).collect()[0][0])
    whole = {"12": 12, "+7": 7, "-128": -128, "128": None, "1.0": None, "1\n": 1, "٣": None}
    df = spark.createDataFrame([(t,) for t in whole], "t string")
    assert [r.v for r in df.select(X.parse_number(F.trim(F.col("t"), F.lit("\n")), "tinyint").alias("v")).collect()] == list(whole.values())


def test_periods(spark):
    start = datetime(2018, 9, 3)
    weeks = D.get_periods(start, start + timedelta(days=15), "week")
    assert weeks == [start, start + timedelta(days=7), start + timedelta(days=14)]
    assert D.get_periods(start + timedelta(days=6), start, "day", -3) == [start, start + timedelta(days=3), start + timedelta(days=6)]
    sizes = [4, 1, 5]
    edges = [start + timedelta(days=sum(sizes[:k])) for k in range(4)]
    offsets = D.period_offsets(edges)
    assert offsets == [k for k, n in enumerate(sizes) for _ in range(n)]
    df = column(spark, [*range(12), -1, None])
    assert [r[0] for r in df.orderBy("rid").select(D.get_period_offset(F.col("v"), offsets)).collect()] == [*offsets, -1, -1, -1, -1]


def told(values, fractions=(0.25, 0.5, 0.75)):
    """The figures of numbers as describe tells them; quantiles in per cent."""
    q = np.percentile(values, fractions)
    return tuple(f"{x:.2f}" for x in (np.mean(values), np.std(values), np.min(values), *q, np.max(values)))


def figures(row):
    return tuple(row[x] for x in ("mean", "std", "min", "25%", "50%", "75%", "max"))


def test_describe(spark):
    rng = random.Random(12)
    data = [(rng.randrange(50), rng.choice([0.0, 0.0, 0.0, rng.uniform(-5, 5)]), rng.random() < 0.3, at_month(rng.randrange(9)), rng.choice(["b", "a", None]), rng.randrange(2)) for _ in range(90)]
    df = spark.createDataFrame(data, "n int, x double, yes boolean, at timestamp, s string, c int")
    df = R.assign(df, "c", F.col("c"), Kind("categorical", "int8", 0, {"calm": 0, "gale": 1}))
    got = {r.field: r for r in G.describe(df).collect()}
    assert set(got) == {"n", "x", "yes", "at"}
    cols = list(zip(*data))
    for k, f in enumerate(("n", "x", "yes")):
        assert figures(got[f]) == told([float(v) for v in cols[k]]) and got[f]["count"] == "90"
    assert figures(got["at"]) == told([(v - datetime(1970, 1, 1)).total_seconds() for v in cols[3]])
    assert figures(G.describe(df, "x", true_quartiles=True).collect()[0]) == told(cols[1], (25, 50, 75))
    every = {r.field: r for r in G.describe(df, "all").collect()}
    for k, f in ((4, "s"), (5, "c")):
        n = Counter(v for v in cols[k] if v is not None)
        top = min(n, key=lambda v: (-n[v], v))
        assert [every[f][x] for x in ("count", "unique", "top", "freq", "mean")] == [str(n.total()), str(len(n)), str(top), str(n[top]), None]
    fields = lambda *a, **k: {r.field for r in G.describe(df, *a, **k).collect()}
    assert fields(["n", "s"]) == {"n", "s"} and fields(T.DoubleType) == {"x"} and fields([T.StringType, T.DoubleType], exclude="x") == {"s"} and fields(exclude=[T.NumericType, T.TimestampType]) == {"yes"}
    for bad in (dict(include="nope"), dict(include=["n"], exclude=["x"]), dict(include=T.DoubleType, exclude=T.DoubleType), dict(include="n", exclude=T.IntegerType), dict(include=3)):
        with pytest.raises((ValueError, TypeError)):
            G.describe(df, **bad)
    with_nan = df.select(F.when(F.col("n") == data[0][0], float("nan")).otherwise(F.col("x")).alias("x"))
    assert set(figures(G.describe(with_nan).collect()[0])) == {"NaN"}
    empty = G.describe(df.limit(0), ["n", "s"]).collect()
    assert [r["count"] for r in empty] == ["0", "0"] and all(x is None for r in empty for x in figures(r))


def test_unique(spark):
    words = ["fir", "oak", "elm", "oak", "ash", "fir", "oak"]
    ordered = sorted(set(words))
    u = G.unique(column(spark, words, "string"), "v", "rid")
    assert sorted((x.value, x["count"], x.first_index, x.inverse) for x in u.collect()) == [(w, words.count(w), words.index(w), k) for k, w in enumerate(ordered)]
    assert {r.rid: r.inverse for r in G.with_inverse(column(spark, words, "string"), "v").collect()} == {i: ordered.index(w) for i, w in enumerate(words)}
