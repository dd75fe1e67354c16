"""Delimited files in, by a declared schema, and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.functions import text as X
from cohortloom.functions.common import need
from cohortloom.operators.frame import encode_categories, encode_leaky
from cohortloom.operators.journal import FROM, OPEN_END, TO
from cohortloom.operators.parse_errors import Layout, clean_rows, parse_errors
from cohortloom.types import NUMERIC, Kind, bounds

MODES = ("strict", "allow_empty", "relaxed")


@dataclass(frozen=True)
class Field:
    """How one column of a file is read.

    kind: string, fixed_string, numeric, categorical, datetime or date. Numeric fields take a validation mode (strict:
    empty or unreadable text raises; allow_empty: unreadable raises; relaxed: neither does), an invalid value (a
    number, 'min' or 'max') and get a flag column `<name><flag_suffix>` unless strict or flag is False. Categorical
    fields take labels, and with `out_of_range` put unknown labels as text into `<name>_<out_of_range>`. Datetime and
    date fields get `<name>_set` only with flag=True, and with day `<name>_day`. The format is int32 for numbers and
    int8 for categories unless given.
    """

    kind: str
    nformat: str = ""
    strlen: int = 0
    labels: Mapping[str, int] = field(default_factory=dict)
    out_of_range: str | None = None
    validation_mode: str = "allow_empty"
    invalid_value: float | str = 0
    flag: bool | None = None
    flag_suffix: str = "_valid"
    day: bool = False
    strict_labels: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("string", "fixed_string", "numeric", "categorical", "datetime", "date"):
            raise ValueError(f"unknown field type {self.kind!r}")
        if not self.nformat:
            object.__setattr__(self, "nformat", "int8" if self.kind == "categorical" else "int32")
        if self.flag is None:
            object.__setattr__(self, "flag", self.kind == "numeric")
        if self.kind in ("numeric", "categorical") and (self.nformat not in NUMERIC or self.validation_mode not in MODES):
            raise ValueError(f"unknown format {self.nformat!r} or validation mode {self.validation_mode!r}")
        if self.kind == "numeric" and self.nformat == "bool" and isinstance(self.invalid_value, str) and self.invalid_value.strip() in ("min", "max"):
            raise ValueError("a bool has no least or greatest value to stand for invalid ones")


def _raise(name: str, c: Column, spark_type: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"column {name}: not a {spark_type}: '"), F.coalesce(c, F.lit("")), F.lit("'"))).cast(spark_type)


def typed(name: str, f: Field) -> list[Column]:
    """The typed columns of one text column."""
    raw = F.coalesce(F.col(name), F.lit(""))
    if f.kind == "string":
        return [raw.alias(name, metadata=Kind("string").metadata())]
    if f.kind == "fixed_string":
        return [X.cut_bytes(raw, f.strlen).alias(name, metadata=Kind("fixed_string", strlen=f.strlen).metadata())]
    if f.kind == "categorical":
        kind = Kind("categorical", f.nformat, 0, dict(f.labels))
        if f.out_of_range:
            code, other = encode_leaky(raw, f.labels, f.nformat)
            return [code.alias(name, metadata=kind.metadata()), other.alias(f"{name}_{f.out_of_range}")]
        return [encode_categories(raw, f.labels, f.strict_labels, f.nformat).alias(name, metadata=kind.metadata())]
    if f.kind == "numeric":
        spark_type = NUMERIC[f.nformat].simpleString()
        value = X.parse_bool(raw) if f.nformat == "bool" else X.parse_number(raw, spark_type)
        low, high = bounds(f.nformat) if f.nformat != "bool" else (0, 1)
        invalid = {"min": low, "max": high}.get(f.invalid_value, f.invalid_value) if isinstance(f.invalid_value, str) else f.invalid_value
        fill = F.lit(invalid).cast(spark_type)
        empty = F.trim(raw) == ""
        bad = _raise(name, raw, spark_type)
        if f.validation_mode == "strict":
            got = F.coalesce(value, bad)
        elif f.validation_mode == "allow_empty":
            got = F.when(empty, fill).otherwise(F.coalesce(value, bad))
        else:
            got = F.coalesce(value, fill)
        out = [got.alias(name, metadata=Kind("numeric", f.nformat).metadata())]
        if f.validation_mode != "strict" and f.flag:
            out.append(value.isNotNull().alias(name + f.flag_suffix))
        return out
    empty = raw == ""
    value = X.parse_timestamp_text(raw) if f.kind == "datetime" else F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))
    got = F.when(empty, F.timestamp_seconds(F.lit(0))).otherwise(F.coalesce(value, _raise(name, raw, "timestamp")))
    out = [got.alias(name, metadata=Kind("timestamp").metadata())]
    if f.flag:
        out.append((~empty).alias(f"{name}_set"))
    if f.day:
        out.append((F.substring(raw, 1, 10) if f.kind == "datetime" else raw).alias(f"{name}_day"))
    return out


def guess_encoding(head: bytes) -> str:
    """The encoding that the first bytes of a file tell."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe\x00\x00", "UTF-32"), (b"\x00\x00\xfe\xff", "UTF-32"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
        if head.startswith(mark):
            return name
    return "UTF-8"


def encoding_of(spark: SparkSession, path: str) -> str:
    """guess_encoding of a file, or of the first file of a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(where) or []
    files = [x.getPath() for f in found for x in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]) if not x.isDirectory() and not x.getPath().getName().startswith(("_", "."))]
    if not files:
        return "UTF-8"
    stream = fs.open(sorted(files, key=lambda p: p.toString())[0])
    try:
        head = [stream.read() for _ in range(4)]
    finally:
        stream.close()
    return guess_encoding(bytes(x for x in head if x >= 0))


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether some cell of a file holds a line break: then some line of it has an odd number of quotes. One pass over the text, in splits."""
    return not spark.read.text(path).filter(F.length("value") % 2 != F.length(F.replace("value", F.lit('"'), F.lit(""))) % 2).limit(1).isEmpty()


def read_text_columns(spark: SparkSession, path: str, encoding: str | None = None, line_breaks: bool | None = None) -> DataFrame:
    """All columns of a delimited file as text: quotes doubled, line breaks inside quotes, blanks after commas skipped.

    Where nothing is said, the encoding is guessed from the first bytes, and the file looked through for cells with
    line breaks: only with such cells can't it be split among tasks. Malformed rows fail the read; read_records takes
    them apart instead.
    """
    encoding = encoding or encoding_of(spark, path)
    if line_breaks is None:
        line_breaks = encoding != "UTF-8" or breaks_lines(spark, path)
    df = spark.read.csv(path, header=True, multiLine=line_breaks, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False, inferSchema=False, mode="FAILFAST", encoding=encoding, nullValue="\u0000", emptyValue="")
    return df.toDF(*[c.strip() for c in df.columns])


def read_records(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """(record_id, file_name, raw_text): the lines of a file as records that aren't read yet, for operators.parse_errors.

    The line that names the columns is left out, wherever it occurs; ids are unique, in order of the file, not dense. A
    cell with a line break makes two records of bad quoting.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    kept = lines.filter(F.col("value") != head[0].value) if head else lines
    return kept.select(F.monotonically_increasing_id().alias("record_id"), F.lit(file_name).alias("file_name"), F.col("value").alias("raw_text"))


def read_csv(spark: SparkSession, path: str, schema: Mapping[str, Field], include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, timestamp: datetime | None = None, journal: bool = True, encoding: str | None = None, line_breaks: bool | None = None) -> DataFrame:
    """A file typed by a schema. Columns the schema doesn't know come as text; with journal, rows get their validity times."""
    _unreserved(schema)
    return typed_columns(read_text_columns(spark, path, encoding, line_breaks), schema, include, exclude, timestamp, journal)


def _unreserved(schema: Mapping[str, Field]) -> None:
    clash = {FROM, TO} & set(schema)
    if clash:
        raise ValueError(f"{sorted(clash)} are reserved names")


def typed_columns(df: DataFrame, schema: Mapping[str, Field], include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, timestamp: datetime | None = None, journal: bool = True) -> DataFrame:
    """Text columns typed by a schema, as read_csv has it."""
    for names in (include, exclude):
        need(df, names or ())
    columns = [c for c in df.columns if (include is None or c in include) and c not in (exclude or ())]
    out = [x for c in columns for x in typed(c, schema.get(c, Field("string")))]
    if journal:
        at = (timestamp or datetime.now(timezone.utc)).timestamp()
        out += [F.timestamp_micros(F.lit(int(at * 1_000_000))).alias(FROM), F.to_timestamp(F.lit(OPEN_END + "Z")).alias(TO)]
    return df.select(*out)


def read_csv_set_apart(spark: SparkSession, path: str, schema: Mapping[str, Field], file_name: str, **more) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the readable rows of a file, typed as read_csv has it, and the others with the reason, as parse_errors has it.

    Errors are those of quotes and of the number of cells, and int32, float32 and float64 fields that aren't relaxed and
    hold text that is no such number. Other fields raise as in read_csv. Splits as large as any: a line is a record.
    """
    _unreserved(schema)
    head = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"').removeprefix("\ufeff") for c in head[0].value.split(",")] if head else []
    kinds = {"int32": "int", "float32": "float", "float64": "float"}
    kind = lambda f: kinds.get(f.nformat, "string") if f is not None and f.kind == "numeric" and f.validation_mode != "relaxed" else "string"
    records = read_records(spark, path, file_name)
    errors = parse_errors(records, (Layout(file_name, tuple((c, kind(schema.get(c))) for c in names)),))
    # Columns go by place until they are typed, as one may be named like the record's own.
    plain = clean_rows(records, Layout(file_name, tuple((f"_cell{k}", "string") for k in range(len(names)))), errors)
    return typed_columns(plain.drop("record_id").toDF(*names), schema, **more), errors


def to_csv(df: DataFrame, path: str, row_filter: Column | None = None, column_filter: Sequence[str] | None = None, single_file: bool = False) -> None:
    """Writes a folder of delimited files with headers; one file only where it is asked for."""
    out = df if row_filter is None else df.filter(row_filter)
    if column_filter is not None:
        need(df, column_filter)
        out = out.select(*column_filter)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def to_pandas(df: DataFrame, row_filter: Column | None = None, column_filter: Sequence[str] | None = None):
    """The rows on the driver; filter first, as all of them are collected."""
    out = df if row_filter is None else df.filter(row_filter)
    return (out.select(*column_filter) if column_filter is not None else out).toPandas()
