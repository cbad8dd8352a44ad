"""Value types and their arithmetic as column expressions.

Four types: ``s`` float, ``d`` double, ``c`` and ``z`` complex in single and double precision,
as struct<re, im>. Work is done in double precision; ``DType.store`` rounds to the type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DType:
    code: str

    @property
    def is_complex(self) -> bool:
        return self.code in "cz"

    @property
    def real(self) -> T.DataType:
        return T.FloatType() if self.code in "sc" else T.DoubleType()

    @property
    def spark(self) -> T.DataType:
        return T.StructType([T.StructField("re", self.real), T.StructField("im", self.real)]) if self.is_complex else self.real

    @property
    def ddl(self) -> str:
        return self.spark.simpleString()

    # --- literals -----------------------------------------------------------------------
    def lit(self, x) -> Column:
        """A Python scalar as a working value."""
        if self.is_complex:
            z = complex(x)
            return F.struct(F.lit(z.real).alias("re"), F.lit(z.imag).alias("im"))
        if isinstance(x, complex):
            if x.imag:
                raise TypeError("a complex scalar for a real matrix")
            x = x.real
        return F.lit(float(x))

    @property
    def zero(self) -> Column:
        return self.lit(0.0)

    def store(self, v: Column) -> Column:
        """A working value as it is kept."""
        if self.is_complex:
            return F.struct(v["re"].cast(self.real).alias("re"), v["im"].cast(self.real).alias("im"))
        return v.cast(self.real)

    def work(self, v: Column) -> Column:
        if self.is_complex:
            return F.struct(v["re"].cast("double").alias("re"), v["im"].cast("double").alias("im"))
        return v.cast("double")

    # --- arithmetic -----------------------------------------------------------------------
    def _pair(self, re: Column, im: Column) -> Column:
        return F.struct(re.alias("re"), im.alias("im"))

    def add(self, a: Column, b: Column) -> Column:
        return self._pair(a["re"] + b["re"], a["im"] + b["im"]) if self.is_complex else a + b

    def sub(self, a: Column, b: Column) -> Column:
        return self._pair(a["re"] - b["re"], a["im"] - b["im"]) if self.is_complex else a - b

    def mul(self, a: Column, b: Column) -> Column:
        return self._pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"]) if self.is_complex else a * b

    def div(self, a: Column, b: Column) -> Column:
        """IEEE quotients; by zero too, where plain division would be null."""
        if self.is_complex:
            d = b["re"] * b["re"] + b["im"] * b["im"]
            return self._pair((a["re"] * b["re"] + a["im"] * b["im"]) / d, (a["im"] * b["re"] - a["re"] * b["im"]) / d)
        return a / b

    def conj(self, a: Column) -> Column:
        return self._pair(a["re"], -a["im"]) if self.is_complex else a

    def neg(self, a: Column) -> Column:
        return self._pair(-a["re"], -a["im"]) if self.is_complex else -a

    def abs(self, a: Column) -> Column:
        return F.hypot(a["re"].cast("double"), a["im"].cast("double")) if self.is_complex else F.abs(a.cast("double"))

    def nonzero(self, a: Column) -> Column:
        """IEEE a != 0: NaN is not zero."""
        return (a["re"] != 0) | (a["im"] != 0) if self.is_complex else a != 0

    def equals(self, a: Column, x: float) -> Column:
        return (a["re"] == x) & (a["im"] == 0) if self.is_complex else a == x

    def parts(self, a: Column) -> list[Column]:
        return [a["re"].cast("double"), a["im"].cast("double")] if self.is_complex else [a.cast("double")]

    # --- aggregates -------------------------------------------------------------------------
    def sum(self, a: Column) -> Column:
        return self._pair(F.sum(a["re"]), F.sum(a["im"])) if self.is_complex else F.sum(a)

    def coalesce(self, a: Column, otherwise: Column) -> Column:
        if self.is_complex:
            return self._pair(F.coalesce(a["re"], otherwise["re"]), F.coalesce(a["im"], otherwise["im"]))
        return F.coalesce(a, otherwise)

    def fold(self, ordered: Column, value: Callable[[Column], Column]) -> Column:
        """The sum of an array's values from left to right."""
        start = self._pair(F.lit(0.0), F.lit(0.0)) if self.is_complex else F.lit(0.0)
        return F.aggregate(ordered, start, lambda s, e: self.add(s, value(e)))


DTYPES = {c: DType(c) for c in "sdcz"}


def dtype(code: str | DType) -> DType:
    if isinstance(code, DType):
        return code
    if code not in DTYPES:
        raise ValueError(f"unknown value type {code!r}: one of s, d, c, z")
    return DTYPES[code]
