"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Inner product; vectors of different lengths are an error rather than a null."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(
        F.size(x) == F.size(y), F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
    ).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(x: Column) -> Column:
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used; a lambda's body would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(x: Column) -> Column:
    """Unit length; a zero vector stays."""
    both = F.struct(x.alias("v"), norm(x).alias("n"))
    return let(both, lambda s: F.transform(s["v"], lambda v: v.cast("double") / s["n"]))


def truncate(x: Column, dim: int) -> Column:
    """The first ``dim`` components at unit length; asking for more than there are is an error."""
    return F.when(F.size(x) >= dim, let(F.slice(x, 1, dim), normalize)).otherwise(
        F.raise_error(F.lit(f"cannot truncate to {dim} dimensions")).cast("array<double>")
    )


def half(x: Column) -> Column:
    """Every component at half precision: eleven significant bits, and no finer than 2^-24. Meant for components up to 1."""

    def rounded(v: Column) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
        return F.when(v == 0, v).otherwise(F.rint(v / step) * step)

    return F.transform(x, rounded)
