"""Operators over all cells within a great-circle distance.

Pairs meet through a grid of cubes as wide as the radius's chord: a cell goes to
its own cube and its partner to the 27 around, then the exact test decides. So
no cell is compared with all others unless the radius spans the sphere. Where
sums over the ball are wanted, no pair becomes a row: blocks of a cube's cells
meet blocks of their partners as arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import vectors as V
from fieldloom.operators.keyed import rank_hash
from fieldloom.plans.storage import saved
from fieldloom.sources.mesh import unit

#: Cells of a cube, and of their partners, that meet in one task, and rows of them that are compared at once.
BLOCK, STRIP = 2048, 128


def _side(radius: float) -> float:
    """The chord of the radius, a bit more for rounding."""
    return max(2 * math.sin(min(radius, math.pi) / 2), 1e-9) * (1 + 1e-9)


def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(k).alias("dk")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))


def _weighed(radius: float):
    """For the asking cells (role 0) of a block, sums over its partners (role 1) in the ball."""
    least = math.cos(min(radius, math.pi)) - 1e-9

    def sums(g: pa.Table) -> pa.Table:
        role, ids, value, area = (g[c].to_numpy() for c in ("role", "cell_id", "value", "area"))
        p = np.stack([g[c].to_numpy() for c in "xyz"], axis=1)
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        s, w = np.zeros(len(a)), np.zeros(len(a))
        for lo in range(0, len(a), STRIP):
            some = a[lo : lo + STRIP]
            dots = p[some] @ p[b].T
            # the dot product tells the far ones; the exact test is made on the angle
            i, j = np.nonzero(dots >= least)
            d = np.arccos(np.clip(dots[i, j], -1.0, 1.0))
            j = b[j]
            d[ids[some[i]] == ids[j]] = 0.0
            near = np.where(d <= radius, (1 - np.minimum(d * d / (radius * radius), 1.0)) ** 2 * area[j], 0.0)
            s[lo : lo + STRIP] = np.bincount(i, near * value[j], len(some))
            w[lo : lo + STRIP] = np.bincount(i, near, len(some))
        return pa.table({"cell_id": ids[a], "s": s, "w": w})

    return sums


def _ball_sums(placed: DataFrame, radius: float) -> DataFrame:
    """``(cell_id, s, w)`` of cells with unit positions, ``value`` and ``area``: weighted sums of values, and of weights, over the ball."""
    cube = lambda c: F.floor(F.col(c) / _side(radius)).cast("long")
    at = placed.select("cell_id", "x", "y", "z", "value", "area", cube("x").alias("i"), cube("y").alias("j"), cube("z").alias("k")).where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL")
    at = saved(at, "placed")
    moved = lambda t, *rest: t.withColumn("o", _around()).select(*rest, *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "ijk"])
    own = at.groupBy("i", "j", "k").agg(F.count("*").alias("n"))
    sizes = own.join(moved(own.withColumnRenamed("n", "m"), "m").groupBy("i", "j", "k").agg(F.sum("m").alias("m")), ["i", "j", "k"])
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    slot = lambda n: F.pmod(F.xxhash64("cell_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = saved(sizes.select("i", "j", "k", parts("n").alias("n"), parts("m").alias("m")), "cubes")
    cols = ["i", "j", "k", "cell_id", "x", "y", "z", "value", "area"]
    asking = at.join(sizes, ["i", "j", "k"]).select(F.lit(0).alias("role"), *cols, slot("n").alias("asked"), spread("m").alias("block"))
    partners = moved(at, *cols[3:]).join(sizes, ["i", "j", "k"]).select(F.lit(1).alias("role"), *cols, spread("n").alias("asked"), slot("m").alias("block"))
    met = asking.unionByName(partners).groupBy("i", "j", "k", "asked", "block").applyInArrow(_weighed(radius), "cell_id long, s double, w double")
    return met.groupBy("cell_id").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def ball_pairs(cells: DataFrame, radius: float, right: DataFrame | None = None) -> DataFrame:
    """``(a, b, d)`` with d <= radius over unit positions; ``right`` may hold columns that ride along with b."""
    side = _side(radius)
    u = cells.select("cell_id", *unit())
    r = u if right is None else u.join(right, "cell_id")
    cube = lambda c: F.floor(F.col(c) / side).cast("long")
    a = u.select(F.col("cell_id").alias("a"), F.struct("x", "y", "z").alias("p"), cube("x").alias("i"), cube("y").alias("j"), cube("z").alias("k"))
    rest = [c for c in r.columns if c not in ("cell_id", "x", "y", "z")]
    b = r.select(F.col("cell_id").alias("b"), F.struct("x", "y", "z").alias("q"), *rest, _around().alias("o"), "x", "y", "z")
    b = b.select("b", "q", *rest, (cube("x") + F.col("o.di")).alias("i"), (cube("y") + F.col("o.dj")).alias("j"), (cube("z") + F.col("o.dk")).alias("k"))
    d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("p"), F.col("q")))))
    pairs = a.join(b, ["i", "j", "k"]).select("a", "b", *rest, F.when(F.col("a") == F.col("b"), 0.0).otherwise(d).alias("d"))
    return pairs.where(F.col("d") <= radius)


def neighborhood_count(cells: DataFrame, radius: float) -> DataFrame:
    """One row ``n``: ordered pairs closer than the radius, a cell with itself included; at radius 0, the cells."""
    if radius == 0:
        return cells.agg(F.count("*").alias("n"))
    return ball_pairs(cells, radius).where(F.col("d") < radius).agg(F.count("*").alias("n"))


def smooth_radius(cells: DataFrame, areas: DataFrame, values: DataFrame, radius: float) -> DataFrame:
    """``(cell_id, value)``: the mean over the ball, weighted by ``(1 - d2 / r2) ** 2`` and area, with the global mean kept."""
    if not (math.isfinite(radius) and radius >= 0):
        raise ValueError("radius must be finite and nonnegative")
    v = F.col("value")
    if values.where(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)).limit(1).count():
        raise ValueError("the field must be finite")
    if radius == 0:
        return values
    placed = cells.select("cell_id", *unit()).join(values.select("cell_id", F.col("value").cast("double")), "cell_id").join(areas.select("cell_id", F.col("area").cast("double")), "cell_id")
    out = _ball_sums(placed, radius).select("cell_id", (F.col("s") / F.col("w")).alias("smooth"))
    # written once: the shift and the result read it
    out = saved(out.join(values, "cell_id").join(areas, "cell_id"), "smooth")
    shift = out.agg((F.sum((F.col("value") - F.col("smooth")) * F.col("area")) / F.sum("area")).alias("shift")).first()["shift"]
    return out.select("cell_id", (F.col("smooth") + F.lit(shift)).alias("value"))


def area_mean_std(values: DataFrame, areas: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of ``value``, weighted by area, in two passes."""
    v = values.join(areas, "cell_id")
    mean = v.agg(F.sum(F.col("value") * F.col("area")) / F.sum("area")).first()[0]
    var = v.agg(F.sum(F.pow(F.col("value") - F.lit(mean), F.lit(2.0)) * F.col("area")) / F.sum("area")).first()[0]
    return mean, math.sqrt(max(var, 0.0))


def standardized(values: DataFrame, areas: DataFrame, amplitude: float, mean: float) -> DataFrame:
    """Values brought to an area-weighted mean and deviation; constant ones become the mean."""
    m, s = area_mean_std(values, areas)
    if s <= 1e-12:
        return values.select("cell_id", F.lit(float(mean)).alias("value"))
    return values.select("cell_id", (F.lit(float(mean)) + F.lit(float(amplitude)) * (F.col("value") - F.lit(m)) / F.lit(s)).alias("value"))


def voronoi_labels(cells: DataFrame, seed: int, node: str, count: int) -> DataFrame:
    """``(cell_id, value)``: the nearest of ``count`` cells chosen by hash, equal ones to the lower label.

    The seeds are as many as the program says, whatever the number of cells;
    they go to every cell as one array.
    """
    u = cells.select("cell_id", *unit())
    chosen = u.orderBy(rank_hash(seed, node, F.col("cell_id")), "cell_id").limit(count)
    chosen = chosen.withColumn("label", F.row_number().over(Window.orderBy(rank_hash(seed, node, F.col("cell_id")), "cell_id")) - 1)
    seeds = chosen.agg(F.sort_array(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), "x", "y", "z"))).alias("seeds")).withColumn("one", F.lit(1))
    all_cells = u.withColumn("one", F.lit(1)).join(F.broadcast(seeds), "one")
    best = F.array_max(F.transform("seeds", lambda s: F.struct((F.col("x") * s["x"] + F.col("y") * s["y"] + F.col("z") * s["z"]).alias("d"), (-s["label"]).alias("l"))))
    return all_cells.select("cell_id", (-best["l"]).cast("long").alias("value"))
