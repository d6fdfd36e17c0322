"""Element types: Spark types, the operator families that accept them, and the finite infinities of the step operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class DType:
    name: str
    spark: T.DataType
    kind: str  # int, real or complex
    infinity: float | int

    @property
    def zero(self):
        return {"re": 0.0, "im": 0.0} if self.kind == "complex" else 0.0 if self.kind == "real" else 0


def _pair(part: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("re", part), T.StructField("im", part)])


INT = DType("int", T.IntegerType(), "int", (1 << 30) - 1)
LONG = DType("long", T.LongType(), "int", (1 << 62) - 1)
LONGLONG = DType("longlong", T.LongType(), "int", (1 << 62) - 1)
FLOAT = DType("float", T.FloatType(), "real", 1e37)
DOUBLE = DType("double", T.DoubleType(), "real", 1e307)
CFLOAT = DType("cfloat", _pair(T.FloatType()), "complex", 1e37)
CDOUBLE = DType("cdouble", _pair(T.DoubleType()), "complex", 1e307)
DTYPES = {d.name: d for d in (INT, LONG, LONGLONG, FLOAT, DOUBLE, CFLOAT, CDOUBLE)}
ALL = frozenset(DTYPES)
#: Which element types an operator family takes.
FAMILIES = {
    "matmul": {"float", "double", "cfloat", "cdouble"},
    "accumulate": ALL - {"longlong"},
    "ticket": {"int", "long", "longlong"},
    "norm": ALL - {"longlong"},
    "solve": {"double"},
    "step": {"int", "long", "float", "double"},
    "random": {"int", "long", "longlong", "float", "double"},
    "any": ALL,
}
#: Names that other languages use for the same types.
ALIASES = {"integer": "long", "real": "float", "double precision": "double", "complex": "cfloat", "double complex": "cdouble", "int32": "int", "int64": "long", "float32": "float", "float64": "double", "complex64": "cfloat", "complex128": "cdouble"}


def as_dtype(name: str | DType) -> DType:
    if isinstance(name, DType):
        return name
    try:
        return DTYPES[ALIASES.get(name.lower(), name.lower())]
    except KeyError:
        raise ValueError(f"unknown element type {name!r}") from None


def require(dtype: DType, family: str) -> None:
    if dtype.name not in FAMILIES[family]:
        raise ValueError(f"{family} takes {', '.join(sorted(FAMILIES[family]))}, not {dtype.name}")
