"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside a lambda, an expression is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def argmax(v: Column) -> Column:
    """Place of the greatest element, the first of equals, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def shifted_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))


def soft_cross_entropy(student: Column, teacher: Column) -> Column:
    """Cross entropy of softmax(teacher) with softmax(student), without either softmax: stable for large values."""
    dot = lambda w: total(F.zip_with(w, student, lambda a, b: a * b)) / F.greatest(total(w), F.lit(FLOOR))
    spread = F.greatest(total(shifted_exp(student)), F.lit(FLOOR))
    return F.array_max(student) + F.ln(spread) - let(shifted_exp(teacher), dot)


def log_softmax(v: Column) -> Column:
    return let(F.array_max(v) + F.ln(total(shifted_exp(v))), lambda log_sum: F.transform(v, lambda x: x - log_sum))


def softmax(v: Column) -> Column:
    return let(shifted_exp(v), lambda w: let(total(w), lambda whole: F.transform(w, lambda x: x / whole)))


def soft_cross_entropy_plain(student: Column, teacher: Column) -> Column:
    """The same by way of log-softmax: a check on the other."""
    return -total(F.zip_with(softmax(teacher), log_softmax(student), lambda a, b: a * b))


def soft_cross_entropy_gradient(student: Column, teacher: Column) -> Column:
    return F.zip_with(softmax(student), softmax(teacher), lambda a, b: a - b)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    mean_square = total(F.transform(v, lambda x: x * x)) / F.size(v)
    return let(F.sqrt(mean_square + F.lit(eps)), lambda scale: F.transform(v, lambda x: x / scale))


def padded(v: Column, length: Column, value: int) -> Column:
    """Padded at the end up to length; longer ones stay."""
    return F.concat(v, F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(0), length - F.size(v)).cast("int")))


def places_of(v: Column) -> Column:
    """Places, from 0, of elements that aren't zero."""
    at = F.transform(v, lambda x, i: F.when(x != 0, i.cast("long")))
    return F.filter(at, lambda i: i.isNotNull())


def taken(v: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(v, i.cast("int")))


def bucket_for(need: Column, buckets: list[int]) -> Column:
    """The least bucket that holds need, else need itself."""
    fits = [F.when(need <= b, F.lit(b)) for b in sorted(set(buckets))]
    return F.coalesce(*fits, need)
