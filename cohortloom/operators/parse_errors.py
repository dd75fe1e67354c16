"""Delimited records: split into cells, check them against rules, part the readable from the unreadable.

The split needs no state machine. Cutting a record at its quote marks leaves pieces that lie, by turns, outside and
inside quotes. The record is well quoted exactly if the number of quotes is even, the first piece is empty or ends
where a cell begins, the last is empty or begins with a comma, and each outside piece between two quoted ones is empty
(a doubled quote) or runs from a comma to the start of a cell. Commas in outside pieces part the cells. All of it is
linear in the length of the record, and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.functions.common import bound, exact, fresh

# What a number of each type looks like once blanks around it are gone.
INTEGER_TEXT = r"^[+-]?[0-9]+\z"
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
BLANKS = r"^[\s ]+|[\s ]+$"

#: Stands for a comma that parts cells. A text's own ESCAPE is written as ESCAPED within, so that it never holds PARTING.
ESCAPE = "\x01"
PARTING, ESCAPED = ESCAPE + "\x02", ESCAPE + "\x03"


@dataclass(frozen=True)
class Layout:
    """The columns of one kind of file, in order, with types: string, int or float."""

    file_name: str
    columns: tuple[tuple[str, str], ...]


USERS_CSV = Layout("users.csv", (("id", "string"), ("FirstName", "string"), ("LastName", "string"), ("bmi", "int"), ("has_diabetes", "string"), ("height_cm", "string"), ("year_of_birth", "int")))
ASSESSMENTS_CSV = Layout("assessments.csv", (("id", "string"), ("date", "string"), ("user_id", "string"), ("abdominal_pain", "string"), ("brain_fog", "string"), ("loss_of_smell", "string"), ("tested_covid_positive", "string"), ("temperature_f", "float")))


def rule_table(spark: SparkSession, layouts: tuple[Layout, ...]) -> DataFrame:
    """One row for each column of each layout: (rule_file, rule_pos, field, type). Its size is that of the layouts."""
    rows = [(x.file_name, k, name, kind) for x in layouts for k, (name, kind) in enumerate(x.columns)]
    return spark.createDataFrame(rows, "rule_file string, rule_pos int, field string, type string")


def _pieces(text: Column) -> Column:
    return F.split(text, '"', -1)


def _outside(k: Column) -> Column:
    return k % 2 == 0


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def well_quoted(text: Column) -> Column:
    """Whether each quote of a record opens, closes or is doubled as the format has it."""

    def judged(p: Column, last: Column) -> Column:
        def good(x: Column, k: Column) -> Column:
            opens = x.rlike(r", *\z")
            closes = (x == "") | x.startswith(",")
            first = (k == 0) & F.when(last == 0, F.lit(True)).otherwise((x == "") | opens)
            final = (k == last) & closes
            doubled = (x == "") & (k > 0) & (k < last)
            between = (k > 0) & (k < last) & closes & opens & (x != "")
            return ~_outside(k) | first | ((k > 0) & final) | doubled | between

        return (last % 2 == 0) & F.forall(F.transform(p, good), lambda ok: ok)

    return _once(_pieces(text), lambda p: _once(F.size(p) - 1, lambda last: judged(p, last)))


def cells_of(text: Column) -> Column:
    """The cells of a well quoted record, quotes undone, blanks after commas gone. An empty record is one empty cell."""

    def joined(p: Column, last: Column) -> Column:
        def put(x: Column, k: Column) -> Column:
            doubled = (x == "") & (k > 0) & (k < last)
            return F.when(~_outside(k), x).when(doubled, F.lit('"')).otherwise(F.regexp_replace(x, ", *", PARTING))

        return F.array_join(F.transform(p, put), "")

    escaped = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED))
    cells = F.split(_once(_pieces(escaped), lambda p: _once(F.size(p) - 1, lambda last: joined(p, last))), PARTING, -1)
    return F.when(text.contains(ESCAPE), F.transform(cells, lambda c: F.replace(c, F.lit(ESCAPED), F.lit(ESCAPE)))).otherwise(cells)


def _bad(value: Column, kind: Column) -> Column:
    v = F.regexp_replace(value, BLANKS, "")
    whole, as_int = v.rlike(INTEGER_TEXT), v.try_cast("int")
    as_double = v.try_cast("double")
    int_ok = whole & as_int.isNotNull()
    float_ok = v.rlike(DECIMAL_TEXT) & as_double.isNotNull() & (F.abs(as_double) < F.lit(float("inf")))
    ok = F.when(kind == "int", int_ok).when(kind == "float", float_ok).otherwise(F.lit(True))
    return (v != "") & ~F.coalesce(ok, F.lit(False))


def parse_errors(records: DataFrame, layouts: tuple[Layout, ...] = (USERS_CSV, ASSESSMENTS_CSV), key: str = "record_id", file: str = "file_name", text: str = "raw_text") -> DataFrame:
    """(key, reason, field): a row for each unreadable record, or for each bad field of a record that splits well.

    Cells are exploded into row, column and value and joined with the rule table (a handful of rows, so its broadcast
    is bounded). Reasons, of which the first that applies counts: quoting, column_count, bad_value. Defined results: a
    null text, or a file without a layout, is `column_count`; an empty text is one empty cell; a null key stays null;
    a repeated record gives its rows again; an empty table gives none. Other columns of the input aren't read, so
    their names can't clash.
    """
    records = exact(records, (key, file, text))
    spark = records.sparkSession
    width = F.coalesce(*[F.when(F.col("_file") == x.file_name, F.lit(len(x.columns))) for x in layouts], F.lit(-1))
    base = records.select(F.col(key).alias("_key"), F.col(file).alias("_file"), F.col(text).alias("_text"))
    quoted = F.coalesce(well_quoted(F.col("_text")), F.lit(True))
    split = bound(base, "_cells", F.when(F.col("_text").isNotNull() & quoted, cells_of(F.col("_text"))))
    split = split.withColumn("_reason", F.when(F.col("_text").isNull(), "column_count").when(F.col("_cells").isNull(), "quoting").when(F.size("_cells") != width, "column_count"))
    # A record that doesn't split is one cell at place -1, so that one pass reports both kinds of row.
    cells = split.select("_key", "_file", "_reason", F.posexplode(F.when(F.col("_reason").isNull(), F.col("_cells")).otherwise(F.array(F.lit("")))).alias("_pos", "_value"))
    rules = F.broadcast(rule_table(spark, layouts).filter("type <> 'string'"))
    on = (F.col("_file") == F.col("rule_file")) & (F.col("_pos") == F.col("rule_pos")) & F.col("_reason").isNull()
    judged = cells.join(rules, on, "left").filter(F.col("_reason").isNotNull() | F.col("type").isNotNull())
    judged = judged.withColumn("_reason", F.coalesce("_reason", F.when(_bad(F.col("_value"), F.col("type")), "bad_value")))
    return judged.filter(F.col("_reason").isNotNull()).select(F.col("_key").alias(key), F.col("_reason").alias("reason"), F.coalesce("field", F.lit("")).alias("field"))


def error_report(errors: DataFrame, key: str = "record_id") -> DataFrame:
    """One row for each unreadable record: its reason and the sorted list of its bad fields."""
    return errors.groupBy(key).agg(F.min("reason").alias("reason"), F.array_sort(F.collect_set(F.nullif(F.col("field"), F.lit("")))).alias("fields"))


def clean_rows(records: DataFrame, layout: Layout, errors: DataFrame, key: str = "record_id", file: str = "file_name", text: str = "raw_text") -> DataFrame:
    """The readable records of one layout, typed: the records without an error row (anti-join), blanks in a number as null."""
    records = exact(records, (key, file, text))
    own = records.filter(F.col(file) == layout.file_name).filter(F.col(text).isNotNull())
    bad = errors.select(F.col(key).alias("_bad_key")).distinct()
    good = own.join(bad, own[key].eqNullSafe(bad["_bad_key"]), "left_anti")
    good = bound(good, "_cells", cells_of(F.col(text)))
    out = [F.col(key)]
    for k, (name, kind) in enumerate(layout.columns):
        cell = F.col("_cells")[k]
        value = cell if kind == "string" else F.regexp_replace(cell, BLANKS, "").try_cast(kind)
        out.append(value.alias(fresh([key], name)))
    return good.select(*out)
