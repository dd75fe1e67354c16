"""Elementwise arithmetic and logic with array semantics: floor division, divisor-signed remainder, inf and NaN, wrap-around."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortloom.types import BITS, NUMERIC


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def true_divide(a: Column, b: Column) -> Column:
    """a / b as double; by zero gives inf, -inf or NaN."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def floor_divide(a: Column, b: Column, whole: bool = True) -> Column:
    """Rounded towards minus infinity: of whole numbers exactly, as bigint, by zero null; of floats (whole=False) as double, by zero inf or NaN."""
    if not whole:
        x, y = a.cast("double"), b.cast("double")
        rest = x % F.nullif(y, F.lit(0.0))
        q = (x - rest) / F.nullif(y, F.lit(0.0)) - F.when((rest != 0) & ((rest < 0) != (y < 0)), 1.0).otherwise(0.0)
        near = F.when(F.abs(q) < 2.0**53, F.floor(q + 0.5).cast("double")).otherwise(q)  # q is whole but for its own rounding
        return F.when(y == 0, true_divide(x, y)).when(F.abs(x) == float("inf"), F.lit(float("nan"))).otherwise(near)
    b = F.nullif(b, F.lit(0))
    q, rest = F.call_function("div", a, b), a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), q - 1).otherwise(q)


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; by zero gives null."""
    rest = a % F.nullif(b, F.lit(0))
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def divmod_(a: Column, b: Column, whole: bool = True) -> Column:
    return F.struct(floor_divide(a, b, whole).alias("quotient"), modulo(a, b).alias("remainder"))


def both(a: Column, b: Column, boolean: bool = False) -> Column:
    return a & b if boolean else a.bitwiseAND(b)


def either(a: Column, b: Column, boolean: bool = False) -> Column:
    return a | b if boolean else a.bitwiseOR(b)


def exclusive(a: Column, b: Column, boolean: bool = False) -> Column:
    return a != b if boolean else a.bitwiseXOR(b)


def invert(a: Column, boolean: bool = False) -> Column:
    return ~a if boolean else F.bitwise_not(a)


def logical_not(a: Column) -> Column:
    return a == 0


def wrap(a: Column, nformat: str) -> Column:
    """A whole number taken modulo the range of an integer format, as an unchecked cast does."""
    if nformat in ("float32", "float64", "bool"):
        return a.cast(NUMERIC[nformat]) if nformat != "bool" else a != 0
    bits = BITS[nformat]
    size = F.lit(str(2**bits)).cast("decimal(38,0)")
    low = F.lit(str(0 if nformat.startswith("u") else -(2 ** (bits - 1)))).cast("decimal(38,0)")
    return (F.pmod(a.cast("decimal(38,0)") - low, size) + low).cast(NUMERIC[nformat])
