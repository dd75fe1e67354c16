"""Reading typed values out of text, and writing text for delimited files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a number looks like, and what counts as true and false.
INTEGER, DECIMAL = r"^[+-]?[0-9]+\z", r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"
TRUE, FALSE = ("1", "y", "t", "on", "yes", "true"), ("0", "n", "f", "off", "no", "false")


def parse_bool(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False)


def parse_number(c: Column, spark_type: str) -> Column:
    """Null where the text is empty or no number of the type."""
    v = F.trim(c)
    return F.when(v.rlike(INTEGER if spark_type in ("tinyint", "smallint", "int", "bigint", "decimal(20,0)") else DECIMAL), v.try_cast(spark_type))


def parse_timestamp_text(c: Column) -> Column:
    """By length: seconds or fractions, with or without a zone text, which is ignored: times are UTC. Else null."""
    n = F.length(c)
    fraction = F.when(n >= 25, F.rtrim(F.regexp_extract(c, r"^.{19}(\.[0-9]{1,6})", 1))).otherwise(F.lit(""))
    head = F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" "))
    known = n.isin(19, 25, 26, 27, 32) | c.endswith("UTC")
    return F.when(known, F.concat(head, fraction, F.lit("Z")).try_cast("timestamp"))


def string_to_datetime(c: Column) -> Column:
    """The three writings with a space: fraction and offset, offset, or neither; offsets are honoured."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")])


def timestamp_to_day(c: Column) -> Column:
    """YYYY-MM-DD of a timestamp text; '' stays ''."""
    return F.when(c == "", F.lit("")).otherwise(F.substring(c, 1, 10))


def datetime_to_seconds(c: Column) -> Column:
    """A timestamp text cut to whole seconds."""
    return F.substring(c, 1, 19)


def cut_bytes(c: Column, n: int) -> Column:
    """The first n bytes of a text in UTF-8; a sign that would be cut in two is dropped."""
    whole = F.octet_length(c) <= n
    ascii_only = F.length(c) == F.octet_length(c)
    chars = F.filter(F.sequence(F.lit(n), F.lit(0), F.lit(-1)), lambda k: F.octet_length(F.substring(c, F.lit(1), k)) <= n)[0]
    return F.when(whole, c).when(ascii_only, F.substring(c, 1, n)).otherwise(F.substring(c, F.lit(1), chars))


def csv_quote(c: Column) -> Column:
    """A cell for a delimited list: quoted if it holds a comma or a quote, quotes doubled."""
    return F.when(c.contains(",") | c.contains('"'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def longest_run(c: Column, sign: str) -> Column:
    """Length of the longest sequence of one sign."""
    runs = F.regexp_extract_all(c, F.lit("((?:" + "\\Q" + sign + "\\E)+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def map_categories(first: dict[str, int], second: dict[str, int]) -> dict[int, int]:
    """Code to code between two category maps with the same labels."""
    return {code: second[label] for label, code in first.items()}
