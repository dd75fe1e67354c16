"""Column kinds: how declared field types map to Spark types, and what stands for a missing value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

# Numeric formats and the Spark type that holds each. Unsigned formats take the next wider type.
NUMERIC = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(),
}
#: Bits of the integer formats; floats count as integers of their width where a bound is asked for.
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "float32": 32, "float64": 64}


@dataclass(frozen=True)
class Kind:
    """numeric (nformat), categorical (nformat, labels), fixed_string (strlen), string, or timestamp."""

    name: str
    nformat: str = ""
    strlen: int = 0
    labels: dict[str, int] = field(default_factory=dict)

    @property
    def spark(self) -> T.DataType:
        if self.name in ("numeric", "categorical"):
            return NUMERIC[self.nformat or "int8"]
        return T.TimestampType() if self.name == "timestamp" else T.StringType()

    def metadata(self) -> dict:
        """What is kept with the column, through Parquet and back."""
        out: dict = {"kind": self.name}
        if self.nformat:
            out["nformat"] = self.nformat
        if self.strlen:
            out["strlen"] = self.strlen
        if self.labels:
            out["strings_to_values"] = dict(self.labels)
        return out

    @classmethod
    def of(cls, f: T.StructField) -> Kind:
        """The kind of a stored column; columns without metadata are read by their Spark type."""
        m = f.metadata or {}
        if "kind" in m:
            return cls(m["kind"], m.get("nformat", ""), int(m.get("strlen", 0)), {k: int(v) for k, v in m.get("strings_to_values", {}).items()})
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return cls("timestamp")
        for name, t in NUMERIC.items():
            if f.dataType == t:
                return cls("numeric", name)
        return cls("string")


def bounds(nformat: str) -> tuple[int, int]:
    """Least and greatest value of a format."""
    bits = BITS[nformat]
    return (0, 2**bits - 1) if nformat.startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def zero_of(t: T.DataType) -> Column:
    """The value that fills a column where a join has no row."""
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        return F.lit("1970-01-01").cast(t)
    return F.lit(0).cast(t)
