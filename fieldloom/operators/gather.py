"""Neighbour operators, as expressions over one gathered list of neighbours.

``gathered`` puts each cell's neighbours with the columns that operators
need into one array in neighbour order: one join by ``dst`` and one grouping by
``src`` serve all operators of a level. The array is as long as the cell's
degree, which a mesh bounds. Sums run in neighbour order and so don't depend
on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import vectors as V
from fieldloom.operators.keyed import unit_draw

NEAR = "__near"


def gathered(fields: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """``fields`` with the array ``__near`` of (ord, id, columns...) added."""
    other = fields.select(F.col("cell_id").alias("dst"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    item = F.struct("ord", F.col("dst").alias("id"), *[f"c{i}" for i in range(len(columns))])
    near = edges.join(other, "dst").groupBy("src").agg(F.array_sort(F.collect_list(item)).alias(NEAR))
    return fields.join(near, F.col("cell_id") == F.col("src"), "left").drop("src").withColumn(NEAR, F.coalesce(NEAR, F.array().cast(near.schema[NEAR].dataType)))


class Near:
    """A cell's gathered neighbours, by column name."""

    def __init__(self, columns: list[str]) -> None:
        self.of = {c: f"c{i}" for i, c in enumerate(columns)}
        self.list = F.col(NEAR)
        self.count = F.size(NEAR)

    def sum(self, f, keep=None) -> Column:
        items = F.filter(self.list, keep) if keep else self.list
        return F.aggregate(items, F.lit(0.0), lambda acc, n: acc + f(n))

    def get(self, n: Column, c: str) -> Column:
        return n[self.of[c]]

    def at(self, n: Column) -> Column:
        return V.vec(self.get(n, "x"), self.get(n, "y"), self.get(n, "z"))


def here() -> Column:
    return V.vec(F.col("x"), F.col("y"), F.col("z"))


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(F.lit(0.0))


def neighbor_sample(near: Near, field: str) -> Column:
    """Mean of the neighbours; 0 without any."""
    return _mean(near.sum(lambda n: near.get(n, field)), near.count)


def laplacian(near: Near, field: str) -> Column:
    return neighbor_sample(near, field) - F.col(f"`{field}`")


def gradient(near: Near, field: str) -> Column:
    """Sum of offsets times differences over squared lengths, made tangent, over the number of neighbours."""
    def term(acc, n):
        def add(d, rise):
            d2 = V.dot(d, d)
            by = F.when(d2 > 1e-24, rise / F.greatest(d2, F.lit(1e-24))).otherwise(F.lit(0.0))
            return V.let(lambda s: V.each(lambda g, c: g + c * s, acc, d), by)
        return V.let(add, V.let(lambda p: V.subtract(p, here()), near.at(n)), near.get(n, field) - F.col(f"`{field}`"))

    zero = V.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    g = V.tangent(F.aggregate(near.list, zero, term), here())
    return V.let(lambda t: V.scale(t, F.when(near.count > 0, 1.0 / F.greatest(near.count, F.lit(1))).otherwise(F.lit(0.0))), g)


def divergence(near: Near, field: str) -> Column:
    """The gradient's stencil on vectors, each neighbour's transported here."""
    def f(n):
        def along(p, moved):
            return V.let(lambda d: F.when(V.dot(d, d) > 1e-24, V.dot(d, V.subtract(moved, F.col(f"`{field}`"))) / F.greatest(V.dot(d, d), F.lit(1e-24))).otherwise(F.lit(0.0)), V.subtract(p, here()))
        return V.let(along, near.at(n), V.transport(near.get(n, field), near.at(n), here()))

    return _mean(near.sum(f), near.count)


def boundary_strength(near: Near, labels: str) -> Column:
    """Share of neighbours with another label."""
    return _mean(near.sum(lambda n: F.when(near.get(n, labels) != F.col(f"`{labels}`"), 1.0).otherwise(0.0)), near.count)


def _across(near: Near, labels: str, value) -> Column:
    """Mean over edges to other labels, weighted by their length; by ascending neighbour, whatever the list's order."""
    ordered = F.array_sort(F.transform(F.filter(near.list, lambda n: near.get(n, labels) != F.col(f"`{labels}`")), lambda n: F.struct(n["id"].alias("id"), n.alias("n"))))
    terms = F.transform(ordered, lambda s: F.struct(V.angle(near.at(s["n"]), here()).alias("length"), value(s["n"]).alias("value")))
    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("total"))
    add = lambda acc, t: F.struct((acc["top"] + t["value"] * t["length"]).alias("top"), (acc["total"] + t["length"]).alias("total"))
    return F.aggregate(terms, zero, add, lambda acc: F.when(acc["total"] > 0, acc["top"] / F.greatest(acc["total"], F.lit(1e-300))).otherwise(F.lit(0.0)))


def boundary_signed_difference(near: Near, labels: str, values: str, scale: float = 1.0) -> Column:
    """What neighbours of other labels have more than the cell, times ``scale``, weighted by edge length."""
    return _across(near, labels, lambda n: (near.get(n, values) - F.col(f"`{values}`")) * F.lit(float(scale)))


def _relative(near: Near, velocity: str, n: Column) -> Column:
    return V.let(lambda moved: V.subtract(F.col(f"`{velocity}`"), moved), V.transport(near.get(n, velocity), near.at(n), here()))


def boundary_normal(near: Near, labels: str, velocity: str) -> Column:
    """Speed at which the cell approaches neighbours of other labels."""
    return _across(near, labels, lambda n: V.let(V.dot, _relative(near, velocity, n), V.edge_tangent(here(), near.at(n))))


def boundary_tangential(near: Near, labels: str, velocity: str) -> Column:
    """Speed along the boundary relative to neighbours of other labels."""
    return _across(near, labels, lambda n: V.let(V.dot, _relative(near, velocity, n), V.normalized(V.cross(here(), V.edge_tangent(here(), near.at(n))))))


def flow_direction(near: Near, potential: str) -> Column:
    """The lowest neighbour below the cell, the first in order among equals; the cell itself if none is below."""
    p = F.col(f"`{potential}`")
    below = F.filter(near.list, lambda n: ~F.isnan(near.get(n, potential)) & ~F.isnan(p) & (near.get(n, potential) < p))
    best = F.array_min(F.transform(below, lambda n: F.struct(near.get(n, potential).alias("p"), n["ord"].alias("o"), n["id"].alias("id"))))
    return F.coalesce(best["id"], F.col("cell_id"))


def advect(near: Near, field: str, velocity: str) -> Column:
    """The cell's value mixed with that of the neighbour upstream, by the speed up to 1; ties to smaller ids."""
    v = F.col(f"`{velocity}`")
    own = F.col(f"`{field}`")
    w = F.least(F.lit(1.0), V.norm(v))

    def mixed(back):
        item = lambda n: F.struct((-V.let(lambda t: V.dot(t, back), V.edge_tangent(here(), near.at(n)))).alias("a"), n["id"].alias("id"), near.get(n, field).alias("v"))
        source = F.array_min(F.transform(near.list, item))
        return F.when((w > 0) & (near.count > 0), (1 - w) * own + w * source["v"]).otherwise(own)

    return V.let(mixed, V.let(lambda u: V.scale(u, F.lit(-1.0)), V.normalized(v)))


def region_vector(seed: int, node: str, labels: str, magnitude: float) -> Column:
    """One ambient direction per label, made tangent at the cell, of length ``magnitude``; axes X, Y, Z where that vanishes."""
    label = F.col(f"`{labels}`")
    ambient = V.vec(*[2 * unit_draw(seed, node, label, f".{k}") - 1 for k in "xyz"])
    axes = [V.vec(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)]
    def choose(vs):
        if len(vs) == 1:
            return V.let(lambda t: V.scale(t, F.lit(float(magnitude)) / F.greatest(V.norm(t), F.lit(1e-300))), V.tangent(vs[0], here()))
        return V.let(lambda t: F.when(V.norm(t) > 1e-12, V.scale(t, F.lit(float(magnitude)) / F.greatest(V.norm(t), F.lit(1e-300)))).otherwise(choose(vs[1:])), V.tangent(vs[0], here()))

    return choose([ambient, *axes])


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < math.inf)
