"""Orphans, imputation and entity features."""

from datetime import datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import features as X, impute as I, orphans as O

D = datetime


def test_orphans_of_assessments(spark, as_rows):
    users = spark.createDataFrame([("aa", D(2020, 2, 1), D(2020, 6, 1), 1), ("aa", D(2020, 2, 1), D(2020, 6, 1), 1), ("bb", D(2020, 1, 1), D(3000, 1, 1), 1), (None, D(2020, 1, 1), D(3000, 1, 1), 1)], "id string, j_valid_from timestamp, j_valid_to timestamp, ID int")
    data = [("1", " AA ", D(2020, 1, 31)), ("2", "aa", D(2020, 2, 1)), ("3", "aa", D(2020, 6, 1)), ("4", "cc", D(2020, 6, 1)), ("5", None, D(2020, 6, 1)), ("6", "  ", D(2020, 6, 1)), ("7", "bb\n", D(2020, 6, 1)), ("4", "cc", D(2020, 6, 1)), ("8", "aa", None), ("9", "zz", None)]
    got = as_rows(O.orphans_of_assessments(spark.createDataFrame(data, "id string, user_id string, received_at timestamp"), users))
    assert got == [("assessments", "1", "2020-01", "later"), ("assessments", "3", "2020-06", "deleted"), ("assessments", "4", "2020-06", "missing"), ("assessments", "9", None, "missing")]
    empty = spark.createDataFrame([], "id string, user_id string, received_at timestamp")
    assert O.orphans_of_assessments(empty, users).collect() == []
    assert len(O.orphans_of_assessments(spark.createDataFrame(data, empty.schema), users.limit(0)).collect()) == 7


def test_orphans_of_users_compare_as_stored(spark, as_rows):
    areas = spark.createDataFrame([("Z1",)], "lsoa11cd string")
    users = spark.createDataFrame([("a", "Z1", D(2020, 2, 1)), ("b", "z1", D(2020, 2, 1)), ("c", " ", D(2020, 2, 1)), ("d", None, D(2020, 2, 1))], "id string, lsoa11cd string, j_valid_from timestamp")
    assert as_rows(O.orphans_of_users(users, areas)) == [("users", "b", "2020-02", "missing")]


def test_versions_of_a_parent(spark, as_rows):
    parents = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 2, 1)), ("a", D(2020, 3, 1), D(2020, 4, 1))], "id string, f timestamp, t timestamp")
    refs = spark.createDataFrame([("1", "a", D(2019, 1, 1)), ("2", "a", D(2020, 1, 15)), ("3", "a", D(2020, 2, 15)), ("4", "a", D(2020, 3, 15))], "id string, k string, at timestamp")
    got = as_rows(O.find_orphans(refs, parents, record="id", reference=F.col("k"), parent=F.col("id"), at=F.col("at"), valid_from="f", valid_to="t", period=F.lit("p"), table_name="t"))
    assert [(r[1], r[3]) for r in got] == [("1", "later"), ("3", "deleted")]


def levels():
    return (I.Level("both", (F.col("g"), F.col("h")), 3), I.Level("g", (F.col("g"),), 3), I.Level("all", (), 1))


def test_fill_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(str(i), rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, -1, 0, 999, *range(20, 40)])) for i in range(400)]
    df = spark.createDataFrame(data, "id string, g string, h int, v int")
    got = {r.id: r for r in I.fill_missing(df.union(df), "id", "v", levels()).collect()}
    assert len(got) == 400
    there = [x for x in data if x[3] is not None and 0 < x[3] < 900]
    for i, g, h, v in data:
        r = got[i]
        if v is not None and 0 < v < 900:
            assert (r.filled, r.is_filled, r.filled_from) == (v, False, "self")
            continue
        groups = [("both", [x[3] for x in there if g is not None and x[1:3] == (g, h)], 3), ("g", [x[3] for x in there if g is not None and x[1] == g], 3), ("all", [x[3] for x in there], 1)]
        name, values = next((n, vs) for n, vs, s in groups if len(vs) >= s)
        m = median(values)
        assert r.is_filled and r.filled_from == name and r.filled in {round(m), int(m + 0.5)}


def test_fill_nothing_known_and_nan(spark):
    df = spark.createDataFrame([("1", "a", 1, float("nan")), ("2", "a", 1, float("-inf"))], "id string, g string, h int, v float")
    assert {(r.id, r.filled, r.filled_from) for r in I.fill_missing(df, "id", "v", levels()).collect()} == {("1", None, "none"), ("2", None, "none")}
    assert I.fill_missing(df.limit(0), "id", "v", levels()).collect() == []


def test_fill_mode_breaks_ties_downwards(spark):
    df = spark.createDataFrame([("1", "a", 1, "y"), ("2", "a", 1, "x"), ("3", "a", 1, None), ("4", "a", 1, "z"), ("5", "a", 1, "z"), ("6", "b", 1, None)], "id string, g string, h int, v string")
    got = {r.id: (r.filled, r.filled_from) for r in I.fill_missing(df, "id", "v", levels(), kind="mode", only_missing=True).collect()}
    assert got == {"3": ("z", "both"), "6": ("z", "all")}


def events(spark):
    data = [("1", "A ", "x", D(2020, 1, 1), 1.0), ("1", "A ", "x", D(2020, 1, 1), 1.0), ("2", "a", "x", D(2020, 1, 2), None), ("3", "a", "y", None, 2.0), ("4", None, "x", D(2020, 1, 1), 2.0), ("5", " ", "x", D(2020, 1, 1), 2.0), ("6", "b", None, D(2020, 1, 1), None)]
    return spark.createDataFrame(data, "id string, u string, k string, at timestamp, v double")


def features(df, types, **more):
    from cohortloom.functions.common import entity_key

    return X.sparse_features(df, entity_key(F.col("u")), F.col("k"), F.col("at"), types, F.col("v"), **more)


def test_features_fold_and_expand(spark):
    df = events(spark)
    types = X.types_of(df, F.col("k"), ["x", "z"])
    assert types == ["x", "z", "", "y"]
    f = features(df, types, record=["id"])
    assert {tuple(r) for r in X.expand_rows(f, types).collect()} == {("a", "x", 2, 1577923200000000, 1.0), ("a", "y", 1, None, 2.0), ("b", "", 1, 1577836800000000, None)}
    assert {(r.entity, r.type, r.n) for r in X.expand_rows(f).collect()} == {("a", 0, 2), ("a", 3, 1), ("b", 2, 1)}
    wide = X.expand_columns(f, ["x", "z"], ["x", "z"]).filter("entity = 'a'").collect()[0].asDict()
    assert wide == {"entity": "a", "x__n": 2, "x__last_us": 1577923200000000, "x__total": 1.0, "z__n": 0, "z__last_us": None, "z__total": None}
    assert {(r.entity, r.n) for r in X.expand_rows(features(df, types), types).filter("type = 'x'").collect()} == {("a", 3)}
    assert features(df.limit(0), types, record=["id"]).collect() == [] and X.types_of(df.limit(0), F.col("k")) == []
    with pytest.raises(ValueError):
        X.expand_columns(f, ["x"], [])


def test_features_of_parts_merge_to_those_of_the_whole(spark):
    import random

    rng = random.Random(2)
    rows = [(str(i), rng.choice(["hot", "hot", "b", "c"]), rng.choice("pqrs"), rng.choice([None, D(2020, 1, rng.randrange(1, 29))]), rng.choice([None, 0.5, 1.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, u string, k string, at timestamp, v double")
    types = X.types_of(df, F.col("k"))
    whole = features(df, types, record=["id"])
    halves = [features(df.filter(F.col("id") % 2 == k), types, record=["id"]) for k in (0, 1)]
    plain = lambda f: sorted(tuple(map(str, r)) for r in X.expand_rows(f, types).collect())
    want = plain(whole)
    assert plain(X.merge_features(*halves)) == want
    a, b = halves[0].withColumnRenamed("vector", "va"), halves[1].withColumnRenamed("vector", "vb")
    assert plain(a.join(b, "entity").select("entity", X.merge_vectors(F.col("va"), F.col("vb")).alias("vector"))) == want
    got = {(e, t): (int(n), last) for e, t, n, last, _ in want}
    for e in ("hot", "b", "c"):
        for t in "pqrs":
            own = [r for r in rows if r[1] == e and r[2] == t]
            last = [int((r[3] - D(1970, 1, 1)).total_seconds()) * 1_000_000 for r in own if r[3]]
            assert got[(e, t)] == (len(own), str(max(last)))
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 2


def test_several_fields_are_filled_as_each_alone(spark):
    import random

    rng = random.Random(5)
    data = [(str(i), rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, -1, *range(20, 40)]), rng.choice([None, 950.0, *[k / 4 for k in range(80, 99)]])) for i in range(300)]
    df = spark.createDataFrame(data, "id string, g string, h int, v int, w double")
    both = {(r.id, r.field): (r.filled, r.filled_from) for r in I.fill_missing(df, "id", ["v", "w"], levels()).collect()}
    assert len(both) == 600
    for f in ("v", "w"):
        assert {(r.id, f): (float(r.filled), r.filled_from) for r in I.fill_missing(df, "id", f, levels()).collect()}.items() <= both.items()
    for value in (["v", "w"], "v"):
        plan = I.fill_missing(df, "id", value, levels())._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_diabetes_is_filled_by_the_mode(spark):
    users = spark.createDataFrame([(f"u{i}", 1980, "Z1", 1 if i < 15 else 2) for i in range(40)] + [("n", 1985, "Z1", None), ("z", None, "Z1", 0)], "id string, year_of_birth int, lsoa11cd string, has_diabetes int")
    got = {r.id: (r.filled, r.filled_from) for r in I.fill_diabetes(users, True).collect()}
    assert got == {"n": (2, "decade and area"), "z": (2, "all")}


def test_labels(spark):
    df = spark.createDataFrame([(None, 0, 3), ("q1", 2, None), ("q1", -1, 9)], "f string, s tinyint, t tinyint")
    assert [r[0] for r in df.select(X.assessment_type(F.col("f"), F.col("s"), F.col("t"))).collect()] == ["//yes", "q1/True/", "q1//"]


def test_table_of_users_holds_all_kinds_and_totals(spark, tmp_path):
    from cohortloom.plans import quality

    data = [
        ("1", " U1 ", "q01", 1, 2, D(2020, 1, 1), 98.5), ("1", " U1 ", "q01", 1, 2, D(2020, 1, 1), 98.5), ("2", "u1", "q01", 1, 2, D(2020, 1, 3), 99.0), ("3", "u1", "q01", 1, 2, D(2020, 1, 2), float("nan")),
        ("4", "u1", None, None, None, D(2020, 1, 4), 97.0), ("5", "u1", "q29", 2, 3, D(2020, 1, 5), 999.0), ("6", "u1", "Q01", 1, 2, D(2020, 1, 6), 100.0), ("7", "u1", " ", 0, 0, D(2020, 1, 7), None), ("8", None, "q30", 1, 1, D(2020, 1, 8), 98.0),
    ]
    spark.createDataFrame(data, "id string, user_id string, entry_form string, loss_of_smell tinyint, tested_covid_positive tinyint, received_at timestamp, temperature_f float").write.parquet(str(tmp_path / "assessments.parquet"))
    df = quality.p6_table(spark, str(tmp_path))
    df.write.parquet(str(tmp_path / "out"))
    (row,) = (r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect())
    us = lambda day: int((D(2020, 1, day) - D(1970, 1, 1)).total_seconds()) * 1_000_000
    want = {"q01_False_no": (3, us(3), 197.5), "__": (1, us(4), 97.0), "q29_True_yes": (1, us(5), None), "_Q01_False_no": (1, us(6), 100.0), " __": (1, us(7), None)}
    for name, values in want.items():
        assert tuple(row[f"{name}__{part}"] for part in ("n", "last_us", "total")) == values
    assert len(row) == 1 + 3 * (336 + 4) and not any("q30" in c for c in row)
    assert sum(v for c, v in row.items() if c.endswith("__n")) == 7
    assert row["q02_False_no__n"] == 0 and row["q02_False_no__total"] is None
    with pytest.raises(ValueError):
        X.types_of(spark.range(3), F.col("id").cast("string"), ["0"], limit=1)
    assert X.types_of(spark.range(3), F.col("id").cast("string"), ["0"]) == ["0", "1", "2"]
