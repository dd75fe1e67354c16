import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import parse_errors as P
from cohortloom.sources.csv import Field, breaks_lines, encoding_of, guess_encoding, read_csv, read_records, to_csv, to_pandas
from cohortloom.sources.dataset import Dataset, Session
from cohortloom.sources.importing import _lists, _pairs, import_with_schema, main
from cohortloom.sources.schema import load_schema

#: River gauges: (row, station, stage in cm, flow, ice, seen at, built on, river, code, state)
GAUGES = """row, station, stage_cm, flow, ice, seen_at, built, river, code, state
11, Aldbrück, 312, 7.25, yes, 2018-09-03 14:20:05, 1931-04-30, Ill, AB7, open
12, "Lower Mill, weir", , -0.5, , 2018-09-04 02:00:00.250000+00:00, 1958-12-01, Nidda, LMW12, shut
13, "Ferry
landing", 9, dry, no, 2018-09-05 23:59:59UTC, 2001-06-15, Oos, FL,
14, Köhl, 70000, , N, , , , , under repair
"""

SCHEMA = {
    "cohortloom": {"version": "1.1.0"},
    "schema": {"gauges": {"primary_keys": ["row"], "fields": {
        "row": {"field_type": "numeric", "value_type": "int64", "validation_mode": "strict"}, "station": {"field_type": "string"},
        "stage_cm": {"field_type": "numeric", "value_type": "int32", "invalid_value": "max", "flag_field_name": "_measured"}, "flow": {"field_type": "numeric", "value_type": "float64", "validation_mode": "relaxed", "invalid_value": -99.5, "create_flag_field": False},
        "ice": {"field_type": "numeric", "value_type": "bool", "validation_mode": "relaxed"}, "seen_at": {"field_type": "datetime", "create_day_field": True, "create_flag_field": True}, "built": {"field_type": "date", "optional": True},
        "river": {"field_type": "categorical", "categorical": {"value_type": "int16", "strings_to_values": {"": 0, "Ill": 300, "Nidda": 7}}}, "code": {"field_type": "fixed_string", "length": 3},
        "state": {"field_type": "categorical", "categorical": {"value_type": "int8", "strings_to_values": {"": 0, "open": 1, "shut": 2}, "out_of_range": "freetext"}},
    }}},
}


@pytest.fixture
def path(tmp_path):
    (tmp_path / "gauges.csv").write_text(GAUGES)
    return str(tmp_path / "gauges.csv")


def test_typed_import(spark, path):
    df = read_csv(spark, path, load_schema(SCHEMA)["gauges"], timestamp=datetime(2018, 10, 1))
    rows = df.orderBy("row").collect()
    assert [r.station for r in rows] == ["Aldbrück", "Lower Mill, weir", "Ferry\nlanding", "Köhl"]
    assert [(r.stage_cm, r.stage_cm_measured) for r in rows] == [(312, True), (2**31 - 1, False), (9, True), (70000, True)]
    assert [r.flow for r in rows] == [7.25, -0.5, -99.5, -99.5] and "flow_valid" not in df.columns
    assert [(r.ice, r.ice_valid) for r in rows] == [(True, True), (False, False), (False, True), (False, True)]
    assert [r.seen_at_day for r in rows] == ["2018-09-03", "2018-09-04", "2018-09-05", ""] and [r.seen_at_set for r in rows] == [r.built_set for r in rows] == [True, True, True, False]
    assert [r.seen_at.hour for r in rows] == [14, 2, 23, 0] and rows[1].seen_at.microsecond == 250000 and rows[0].built == datetime(1931, 4, 30)
    assert [r.river for r in rows] == [300, 7, 0, 0] and df.schema["river"].dataType.typeName() == "short"
    assert [r.code for r in rows] == ["AB7", "LMW", "FL", ""]
    assert [(r.state, r.state_freetext) for r in rows] == [(1, ""), (2, ""), (0, ""), (-1, "under repair")]
    assert rows[0].j_valid_to.year == 3000 and rows[0].j_valid_from == datetime(2018, 10, 1)


def test_schema_forms():
    field = lambda **x: load_schema({"any": {"version": "1.0.0"}, "schema": {"t": {"fields": {"f": x}}}})["t"]["f"]
    assert field(field_type="numeric", value_type="float32").flag_suffix == "_valid" and field(field_type="numeric", value_type="float32", flag_field_name="_ok").flag_suffix == "_ok"
    assert not field(field_type="date").flag and field(field_type="date", optional=True).flag and field(field_type="datetime", create_flag_field=True).flag
    assert field(field_type="categorical", categorical={"value_type": "int32", "strings_to_values": {"a": 70000}}).nformat == "int32"
    for bad in (dict(), dict(field_type="color"), dict(field_type="numeric"), dict(field_type="fixed_string"), dict(field_type="categorical"), dict(field_type="categorical", categorical={"value_type": "int8"}), dict(field_type="categorical", categorical={"strings_to_values": {}}), dict(field_type="numeric", value_type="int7"), dict(field_type="numeric", value_type="bool", invalid_value="min")):
        with pytest.raises(ValueError):
            field(**bad)
    for bad in ({"schema": {}}, {"any": {"version": "9"}, "schema": {}}, {"any": {"version": "1.0.0"}}):
        with pytest.raises(ValueError):
            load_schema(bad)


def test_errors(spark, path):
    with pytest.raises(Exception, match="column flow"):
        read_csv(spark, path, {"flow": Field("numeric", "float64")}).collect()
    with pytest.raises(ValueError):
        read_csv(spark, path, {"j_valid_to": Field("string")})
    with pytest.raises(ValueError):
        read_csv(spark, path, {}, include=["nope"])
    with pytest.raises(ValueError):
        Field("decimal")
    assert read_csv(spark, path, {}, include=["row"], journal=False).columns == ["row"]


def test_encodings_and_splits(spark, path, tmp_path):
    assert breaks_lines(spark, path)
    lines = "row,station\n" + "".join(f'{k},"Köhl, {k}"\n' for k in range(5))
    for name, encoding in (("plain", "utf-8"), ("marked", "utf-8-sig"), ("wide", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(lines.encode(encoding))
        got = read_csv(spark, str(tmp_path / f"{name}.csv"), {}, journal=False)
        assert got.columns == ["row", "station"] and sorted(r.station for r in got.collect()) == [f"Köhl, {k}" for k in range(5)]
    assert encoding_of(spark, str(tmp_path / "wide.csv")) == "UTF-16" and not breaks_lines(spark, str(tmp_path / "plain.csv"))
    assert guess_encoding(b"\xef\xbb\xbfa") == "UTF-8" and guess_encoding(b"\xff\xfea") == "UTF-16" and guess_encoding(b"a") == "UTF-8" and guess_encoding(struct.pack("<I", 0xFEFF)) == "UTF-32"


def test_bad_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "u.csv").write_text('row,stage,flow\n1,20,1.5\n2,"high",2\n3,4\n4,5,"x\n5,7,1e2\n')
    layout = P.Layout("u.csv", (("row", "string"), ("stage", "int"), ("flow", "float")))
    records = read_records(spark, str(tmp_path / "u.csv"), "u.csv")
    errors = P.parse_errors(records, (layout,))
    assert sorted((r.reason, r.field) for r in errors.collect()) == [("bad_value", "stage"), ("column_count", ""), ("quoting", "")]
    assert sorted((r["row"], r.stage, r.flow) for r in P.clean_rows(records, layout, errors).collect()) == [("1", 20, 1.5), ("5", 7, 100.0)]


def test_import_with_lines_set_apart(spark, tmp_path):
    fields = {"row": {"field_type": "numeric", "value_type": "int32", "validation_mode": "strict"}, "stage": {"field_type": "numeric", "value_type": "int32"}, "flow": {"field_type": "numeric", "value_type": "float64", "validation_mode": "relaxed"}}
    (tmp_path / "s.json").write_text(json.dumps({"any": {"version": "1.0.0"}, "schema": {"g": {"fields": fields}}}))
    (tmp_path / "g.csv").write_text('row, stage, flow, note\n1, 20, 1.5, "a, b"\n2, high, 2, x\n3, 4\n4, 5, wet, ""\n')
    out = import_with_schema(spark, str(tmp_path / "ds"), str(tmp_path / "s.json"), {"g": str(tmp_path / "g.csv")}, overwrite=True, set_apart=True)
    assert sorted((r["row"], r.stage, r.stage_valid, r.flow, r.flow_valid, r.note) for r in out["g"].collect()) == [(1, 20, True, 1.5, True, "a, b"), (4, 5, True, 0.0, False, "")]
    assert sorted((r.reason, r.field) for r in out["g_errors"].collect()) == [("bad_value", "stage"), ("column_count", "")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, "")], "id int, s string")
    to_csv(df, str(tmp_path / "out"), row_filter=F.col("id") < 3, single_file=True)
    back = read_csv(spark, str(tmp_path / "out"), {"id": Field("numeric", "int32"), "s": Field("string")}, journal=False)
    assert sorted((r.id, r.s) for r in back.collect()) == [(1, 'a "q", b\nc'), (2, "")]
    assert to_pandas(df, F.col("id") == 1, ["id"]).id.tolist() == [1]


def test_schema_import_and_dataset(spark, tmp_path, path):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    folder, only = str(tmp_path / "ds"), {"gauges": ["row", "river"]}
    out = import_with_schema(spark, folder, str(tmp_path / "s.json"), {"gauges": path}, overwrite=True, include=only)
    assert out.keys() == ["gauges"] and sorted(r.river for r in out["gauges"].collect()) == [0, 0, 7, 300]
    assert out["gauges"].schema["river"].metadata["strings_to_values"] == {"": 0, "Ill": 300, "Nidda": 7}
    import_with_schema(spark, folder, str(tmp_path / "s.json"), {"gauges": path}, include=only)
    assert Dataset(spark, folder)["gauges"].count() == 8
    with pytest.raises(ValueError):
        import_with_schema(spark, folder, str(tmp_path / "s.json"), {"nobody": path})
    with Session(spark) as s:
        a, b = s.open_dataset(folder, "r+", "a"), s.open_dataset(str(tmp_path / "other"), "w", "b")
        a.copy("gauges", b, "copy")
        b.rename("copy", "moved")
        assert "moved" in b and len(b) == 1 and s.list_datasets() == ["a", "b"]
        like = b.create_like("blank", a["gauges"])
        assert like.columns == a["gauges"].columns and like.collect() == [] and like.schema["river"].metadata == a["gauges"].schema["river"].metadata
        assert b.require("blank", a["gauges"]).count() == 0
        with pytest.raises(Exception):
            b.create_like("blank", a["gauges"])
        b.drop("moved")
        assert b.keys() == ["blank"]
        with pytest.raises(ValueError):
            s.open_dataset(folder, "r", "a")
    with pytest.raises(PermissionError):
        Dataset(spark, folder).drop("gauges")
    assert _pairs("a:x.csv, b:y.csv") == {"a": "x.csv", "b": "y.csv"} and _lists("a:(p, q), b:(r)") == {"a": ["p", "q"], "b": ["r"]}


def test_command_line(spark, tmp_path, path):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    main(["import", "-s", str(tmp_path / "s.json"), "-i", f"gauges:{path}", "-ds", str(tmp_path / "cli"), "-w", "-ts", "2018-10-01T00:00:00", "-x", "gauges:(flow)"])
    got = Dataset(spark, str(tmp_path / "cli"))["gauges"]
    assert got.count() == 4 and "flow" not in got.columns and got.first().j_valid_from == datetime(2018, 10, 1)


def test_stream(spark, tmp_path):
    from cohortloom.streaming.windows import period_counts, read_stream

    df = spark.createDataFrame([("a", datetime(2020, 1, 1, h)) for h in (1, 2, 23)] + [("a", datetime(2020, 1, 2))], "k string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = period_counts(read_stream(spark, str(tmp_path / "in"), df.schema), "at", ["k"]).writeStream.outputMode("complete").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["count"] for r in spark.table("periods").collect()) == [1, 3]
