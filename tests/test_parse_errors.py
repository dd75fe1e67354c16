import random

import pytest

from cohortloom.operators import parse_errors as P

FIELDS = "record_id bigint, file_name string, raw_text string"


def split(s):
    """The cells of a record by a state machine, None where quotes are wrong."""
    cells, i, n = [], 0, len(s)
    while True:
        while cells and i < n and s[i] == " ":
            i += 1
        cell = ""
        if i < n and s[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + s[i], i + 1
            if i < n and s[i] != ",":
                return None
        else:
            while i < n and s[i] != ",":
                if s[i] == '"':
                    return None
                cell, i = cell + s[i], i + 1
        cells.append(cell)
        if i >= n:
            return cells
        i += 1


def test_split_equals_state_machine(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('ab", \n') for _ in range(rng.randrange(14))) for _ in range(1500)] + ["", '"', '""', '""""', '"""', 'a,""', ' "a"', '"a" ,b', '"a", "b"', 'a\\"b', '"a,b\nc",d', ",", ", ,", "a\x01\x02b,c", "\x01,\x01\x03,\x02\x01", 'x,"\x01\x02"', "a\0\0b,\0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from pyspark.sql import functions as F

    got = {r.i: r.c for r in df.select("i", F.when(P.well_quoted(F.col("t")), P.cells_of(F.col("t"))).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split(t), repr(t)


def test_reasons_and_fields(spark, as_rows):
    data = [
        (1, "users.csv", "a,b,c,21,True,170,1990"), (2, "users.csv", 'a,b,c,2"1,True,170,1990'), (3, "users.csv", "a,b,c,21,True,170"), (4, "users.csv", "a,b,c,x,True,170,19.5"),
        (5, "users.csv", 'a,"b, c",c, +21 ,True,170,""'), (6, "assessments.csv", "a,b,c,,,,,1e400"), (7, "assessments.csv", "a,b,c,,,,, 9.8e1 "), (8, "assessments.csv", "a,b,c,,,,,nan"),
        (9, "users.csv", None), (10, "other.csv", "a"), (11, "users.csv", ""), (12, None, "a,b"), (13, "users.csv", "a,b,c,2147483648,True,170,-2147483648"), (14, "assessments.csv", "a,b,c,,,,,.5"),
        (15, "assessments.csv", "a,b,c,,,,,٣"),
    ]
    got = as_rows(P.parse_errors(spark.createDataFrame(data, FIELDS)))
    assert got == [
        (2, "quoting", ""), (3, "column_count", ""), (4, "bad_value", "bmi"), (4, "bad_value", "year_of_birth"), (6, "bad_value", "temperature_f"), (8, "bad_value", "temperature_f"),
        (9, "column_count", ""), (10, "column_count", ""), (11, "column_count", ""), (12, "column_count", ""), (13, "bad_value", "bmi"), (15, "bad_value", "temperature_f"),
    ]


def test_clean_rows_are_typed(spark):
    df = spark.createDataFrame([(1, "users.csv", 'u1, "Ann, B", C, 21, True, , 1990'), (2, "users.csv", "u2,b"), (3, "users.csv", "u3,a,b, ,,,-5")], FIELDS)
    got = {r.record_id: r for r in P.clean_rows(df, P.USERS_CSV, P.parse_errors(df)).collect()}
    assert set(got) == {1, 3}
    assert (got[1].FirstName, got[1].bmi, got[1].year_of_birth) == ("Ann, B", 21, 1990) and got[3].bmi is None and got[3].year_of_birth == -5


def test_long_empty_and_clashing(spark):
    wide = spark.createDataFrame([(1, "users.csv", '"' + '""' * 50_000 + "a," * 50_000 + '",b,c,1,True,1,1', 7)], "record_id bigint, file_name string, raw_text string, RECORD_ID int")
    assert P.parse_errors(wide).collect() == []
    assert P.parse_errors(spark.createDataFrame([], FIELDS)).collect() == []
    with pytest.raises(ValueError):
        P.parse_errors(wide.drop("raw_text"))


def test_report(spark, as_rows):
    df = spark.createDataFrame([(4, "users.csv", "a,b,c,x,True,170,19.5")] * 2, FIELDS)
    assert [(r.reason, r.fields) for r in P.error_report(P.parse_errors(df)).collect()] == [("bad_value", ["bmi", "year_of_birth"])]


def test_heights_of_all_records_equal_state_machine(spark, tmp_path):
    import re

    from cohortloom.plans import relational

    rng = random.Random(8)
    cells = ["", "170", '"171"', " 172", '" 173 "', '"1,7"', '"a""b"', "x", "17.5", "9999999999", "-4", '1"7']
    texts = [",".join(rng.choice(cells) for _ in range(rng.choice([6, 7, 7, 7, 7, 8]))) for _ in range(600)] + ["", None, 'a,"b, c",c,21,"True","170",1990']
    data = [(i, "users.csv", t) for i, t in enumerate(texts)] + [(9999, "assessments.csv", "a,b,c,d,e,170,f")]
    spark.createDataFrame(data, FIELDS).write.parquet(str(tmp_path / "raw_records.parquet"))

    def height(text):
        row = split(text) if text is not None else None
        if row is None or len(row) != 7 or not re.fullmatch("[+-]?[0-9]+", row[5].strip(" ")):
            return None
        return int(row[5]) if abs(int(row[5])) < 2**31 else None

    got = {r.record_id: r.height for r in relational.QUERIES["parse_numbers_all"](spark, str(tmp_path)).collect()}
    assert got == {i: height(t) for i, t in enumerate(texts)}
