"""Arithmetic on vector columns: structs of doubles x, y, z.

A column that a formula uses several times is bound to a name first, as else
nested formulas would grow by powers.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(f, *values: Column) -> Column:
    """``f`` of values that are each computed once."""
    if not values:
        return f()
    head, *rest = values
    return F.transform(F.array(head), lambda h: let(lambda *t: f(h, *t), *rest))[0]


def bound(f):
    return functools.wraps(f)(lambda *args: let(f, *args))


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def each(f, *vs: Column) -> Column:
    return vec(*[f(*[v[k] for v in vs]) for k in "xyz"])


# These use each argument three times and are for columns and bound names.


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return each(lambda p, q: p + q, a, b)


def subtract(a: Column, b: Column) -> Column:
    return each(lambda p, q: p - q, a, b)


def scale(a: Column, s: Column) -> Column:
    return each(lambda p: p * s, a)


# These bind their arguments and may be nested.


@bound
def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


@bound
def tangent(v: Column, p: Column) -> Column:
    """``v`` without its part along ``p``."""
    return let(lambda s: each(lambda a, b: a - b * s, v, p), dot(v, p) / F.greatest(dot(p, p), F.lit(1e-24)))


@bound
def normalized(v: Column) -> Column:
    """Of length one; zero stays zero."""
    return let(lambda n: scale(v, F.when(n > 1e-12, 1 / n).otherwise(F.lit(0.0))), norm(v))


@bound
def transport(v: Column, a: Column, b: Column) -> Column:
    """``v`` at ``a`` moved to ``b`` along the great circle: a rotation about their normal, or a projection if they are parallel."""
    def turned(axis: Column, sine: Column, cosine: Column) -> Column:
        def rotated(k: Column) -> Column:
            return let(lambda side, along: each(lambda p, q, r: p * cosine + q * sine + r * along * (1 - cosine), v, side, k), cross(k, v), dot(k, v))
        return let(rotated, scale(axis, 1 / F.greatest(sine, F.lit(1e-12))))

    def go(p: Column, q: Column) -> Column:
        return let(lambda axis: let(lambda sine, cosine: F.when(sine > 1e-12, turned(axis, sine, cosine)).otherwise(tangent(v, q)), norm(axis), dot(p, q)), cross(p, q))

    return let(go, normalized(a), normalized(b))


@bound
def angle(a: Column, b: Column) -> Column:
    """Great-circle distance of two directions."""
    return let(lambda p, q: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, q)))), normalized(a), normalized(b))


@bound
def edge_tangent(p: Column, q: Column) -> Column:
    """The direction at ``p`` towards ``q``."""
    return normalized(tangent(subtract(q, p), p))
