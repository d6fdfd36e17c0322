"""Arithmetic on element columns; a complex number is a struct of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType


def pair(re: Column, im: Column, dtype: DType) -> Column:
    part = dtype.spark["re"].dataType
    return F.struct(re.cast(part).alias("re"), im.cast(part).alias("im"))


def constant(value, dtype: DType) -> Column:
    if dtype.kind == "complex":
        value = value if isinstance(value, complex) else complex(value["re"], value["im"]) if isinstance(value, dict) else complex(value)
        return pair(F.lit(value.real), F.lit(value.imag), dtype)
    return F.lit(value).cast(dtype.spark)


def add(a: Column, b: Column, dtype: DType) -> Column:
    if dtype.kind == "complex":
        return pair(a["re"] + b["re"], a["im"] + b["im"], dtype)
    return (a + b).cast(dtype.spark)


def mul(a: Column, b: Column, dtype: DType) -> Column:
    if dtype.kind == "complex":
        return pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"], dtype)
    return (a * b).cast(dtype.spark)


def square(a: Column) -> Column:
    return a["re"].cast("double") * a["re"] + a["im"].cast("double") * a["im"]


def div(a: Column, b: Column, dtype: DType) -> Column:
    """a / b; integers truncate toward zero; a zero divisor is an error."""
    if dtype.kind == "complex":
        n = F.when(square(b) != 0, square(b)).otherwise(F.raise_error(F.lit("division by zero element")).cast("double"))
        return pair((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n, dtype)
    safe = F.when(b != 0, b).otherwise(F.raise_error(F.lit("division by zero element")).cast(dtype.spark))
    if dtype.kind == "int":
        return F.call_function("div", a, safe).cast(dtype.spark)
    return (a / safe).cast(dtype.spark)


def modulus(a: Column, dtype: DType) -> Column:
    """abs; for complex numbers the modulus, as a plain number."""
    return F.hypot(a["re"], a["im"]) if dtype.kind == "complex" else F.abs(a)


def absolute(a: Column, dtype: DType) -> Column:
    return pair(modulus(a, dtype), F.lit(0), dtype) if dtype.kind == "complex" else F.abs(a)


def greater(a: Column, b: Column, dtype: DType) -> Column:
    return F.when(square(a) >= square(b), a).otherwise(b) if dtype.kind == "complex" else F.greatest(a, b)


def lesser(a: Column, b: Column, dtype: DType) -> Column:
    return F.when(square(a) <= square(b), a).otherwise(b) if dtype.kind == "complex" else F.least(a, b)


def middle(a: Column, b: Column, c: Column, dtype: DType) -> Column:
    """The middle of three values."""
    if dtype.kind == "complex":
        rank = F.array_sort(F.array(*(F.struct(square(x).alias("m"), F.lit(k).alias("k"), x.alias("x")) for k, x in enumerate((a, b, c)))))
        return F.element_at(rank, 2)["x"]
    return F.element_at(F.array_sort(F.array(a, b, c)), 2)


def wide_sum(v: Column, dtype: DType) -> Column:
    """The sum of a column, in the widest type of its kind."""
    if dtype.kind == "complex":
        return F.struct(F.sum(v["re"].cast("double")).alias("re"), F.sum(v["im"].cast("double")).alias("im"))
    return F.sum(v.cast("double" if dtype.kind == "real" else "long"))


def narrowed(v: Column, dtype: DType) -> Column:
    return pair(v["re"], v["im"], dtype) if dtype.kind == "complex" else v.cast(dtype.spark)


def nonzero(v: Column, dtype: DType) -> Column:
    return (v["re"] != 0) | (v["im"] != 0) if dtype.kind == "complex" else v != 0


def hashed_bits(said: Column, first: int = 1, digits: int = 13) -> Column:
    """4 * digits bits of md5 of a text: a hash that other SQL engines have too. At most 15 digits fit a long."""
    return F.conv(F.substring(F.md5(said.cast("binary")), first, digits), 16, 10).cast("long")
