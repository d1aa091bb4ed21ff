"""Vector expressions, on arrays of floats; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Null if either is null or holds a null; of unequal lengths too."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def mean_pooled(states: Column, mask: Column) -> Column:
    """The mean of the vectors (array of arrays) whose mask is not 0; zeros if none is."""
    kept = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    width = F.size(F.element_at(states, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: F.when(F.size(kept) > 0, x / F.size(kept)).otherwise(F.lit(0.0)))
