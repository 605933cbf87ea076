"""Binary32 arithmetic as columns: order and rounding are part of the result, so nothing here may widen to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_TOLERANCE, PACKAGE_TOLERANCE = 1e-5, 1e-6
_INF = float("inf")


def f32(value: float = 0.0) -> Column:
    return F.lit(value).cast("float")


def dot(a: Column, b: Column) -> Column:
    """Left fold of products, each product and each sum rounded to binary32. Lengths must agree; callers check them."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), f32(), lambda acc, x: acc + x)


def norm2(v: Column) -> Column:
    """The squared length by the same fold."""
    return F.aggregate(v, f32(), lambda acc, x: acc + x * x)


def finite(v: Column) -> Column:
    """Whether no component is null, NaN or infinite; an empty array is finite, a null one not."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < f32(_INF)), F.lit(False))), F.lit(False))


def passes_query_gate(v: Column) -> Column:
    """Finite, and the binary32 squared length within 1e-5 of 1."""
    return finite(v) & (F.abs(norm2(v).cast("double") - 1.0) <= QUERY_TOLERANCE)


def total(values: Column) -> Column:
    """Compensated (Neumaier) sum in double: the sum's rounding errors are gathered and added at the end."""

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - s) + x).otherwise((x - s) + acc["s"])
        return F.struct(s.alias("s"), (acc["c"] + lost).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    return F.aggregate(F.transform(values, lambda x: x.cast("double")), zero, add, lambda acc: acc["s"] + acc["c"])


def length(v: Column) -> Column:
    """Euclidean length in double with the compensated sum."""
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def passes_package_gate(v: Column) -> Column:
    """Finite, and the double length within 1e-6 of 1."""
    return finite(v) & (F.abs(length(v) - 1.0) <= PACKAGE_TOLERANCE)


def normalised(v: Column) -> Column:
    """The vector divided by its double length; null where that is zero or not finite."""
    n = length(v)
    return F.when(finite(v) & (n > 0) & (n < _INF), F.transform(v, lambda x: x.cast("double") / n))


def mean_of(windows: Column) -> Column:
    """Mean of each component over windows (array of struct index, v), summed in the order of index; null if lengths differ."""
    ordered = F.transform(F.array_sort(windows), lambda w: w["v"])
    size, n = F.size(ordered[0]), F.size(ordered)
    same = F.forall(ordered, lambda w: F.size(w) == size)
    places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: total(F.transform(ordered, lambda w: F.get(w, i))) / n)
    return F.when(same & (size > 0), places)
