"""Vector expressions: everything stays in built-in functions, in doubles or in emulated half precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least normal half-precision number, the smallest divisor of a normalisation.
TINY = 2.0**-14
#: Greatest finite half-precision number.
LARGEST = 65504.0
_SPLIT = 2.0**42 + 1.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _there(total: Column) -> Column:
    """A sum over two vectors, which is null where a component of either is."""
    return F.coalesce(total, F.raise_error(F.lit("vectors are missing, unequal in length or hold nulls")).cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero, as a scaled double is rounded in SQL engines; round() of Spark goes by decimal digits instead."""
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in doubles, from the first dimension on. Vectors that are missing, unequal in length
    or hold nulls are errors."""
    return _there(_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalize(v: Column) -> Column:
    """Unit length; vectors shorter than TINY are divided by TINY."""
    norm = F.greatest(F.sqrt(squared_norm(v)), F.lit(TINY))
    return F.transform(v, lambda x: x.cast("double") / norm)


def half(x: Column) -> Column:
    """x rounded to half precision (11 significant bits, subnormals in steps of 2^-24) as a double; infinite past its range."""
    wide = x * F.lit(_SPLIT)
    return F.when(F.abs(x) >= LARGEST + 16.0, F.signum(x) * float("inf")).when(F.abs(x) >= TINY, wide - (wide - x)).otherwise(F.rint(x * F.lit(2.0**24)) / F.lit(2.0**24))


def half_vector(v: Column) -> Column:
    return F.transform(v, lambda x: half(x.cast("double")))


def half_distance(a: Column, b: Column) -> Column:
    """Squared distance of half-precision vectors as |a|^2 + |b|^2 - 2ab, every operation rounded to half precision,
    sums within norms and products taken wide."""
    a, b = half_vector(a), half_vector(b)
    both = half(half(squared_norm(a)) + half(squared_norm(b)))
    d = half(both - F.lit(2.0) * half(_there(dot(a, b))))
    return F.when(d < 0, F.lit(0.0)).otherwise(d)


def finite(v: Column) -> Column:
    """Whether a vector is there and has neither nulls nor non-finite numbers; others can't be compared."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
