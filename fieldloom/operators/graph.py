"""Fix-points over adjacency, as loops of joins whose state is written each few rounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldloom.operators.components import connected_components as components
from fieldloom.plans.storage import release, saved

#: Linear rounds that one plan holds before its state is written.
FUSED = 6
#: Hops that one plan walks, and tables of distances that stay apart.
HOPS, PARTS = 4, 8


class FieldError(ValueError):
    """An operator's input breaks its contract."""


def diffuse(values: DataFrame, edges: DataFrame, rate: float, iterations: int) -> DataFrame:
    """``iterations`` times the value moves by ``rate`` towards its neighbours' mean; ``values`` is (cell_id, value).

    A round is linear, so it is one weighted edge table with a loop at each
    cell: each round reads its state once and plans stay linear in size.
    """
    if not 0 <= rate <= 1:
        raise FieldError("rate must lie in [0, 1]")
    if iterations < 0 or iterations != int(iterations):
        raise FieldError("iterations must be a nonnegative integer")
    if iterations == 0:
        return values
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    weighted = edges.join(degree, "src").select("src", "dst", (F.lit(float(rate)) / F.col("n")).alias("w"))
    own = values.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0 - rate).alias("w"))
    weighted = saved(weighted.unionByName(own), "weights")
    state = values
    # a cell's few terms are summed in neighbour order, so that bits don't depend on partitions
    terms = F.array_sort(F.collect_list(F.struct("dst", (F.col("w") * F.col("value")).alias("t"))))
    moved = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x["t"]).alias("value")
    for i in range(int(iterations)):
        state = weighted.join(state.select(F.col("cell_id").alias("dst"), "value"), "dst").groupBy("src").agg(moved).select(F.col("src").alias("cell_id"), "value")
        if (i + 1) % FUSED == 0 and i + 1 < iterations:
            state = saved(state, "diffuse")
    return state


def distance_to_mask(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops to the nearest true cell of ``(cell_id, value)``; 0 where none is reached.

    A plan walks ``HOPS`` hops from the last frontier, and one job writes what it
    reaches for the first time. A shortest path to a new cell leaves through the
    frontier, so the shortest of the walks is its distance; walks that turn
    back end at cells that were seen and are dropped.
    """
    seen = saved(mask.where("value").select("cell_id", F.lit(0).alias("hops")), "seen")
    step, frontier, hops, parts = edges.select("src", "dst"), seen, 0, [seen]
    while True:
        at, walks = frontier.select("cell_id"), []
        for i in range(1, HOPS + 1):
            at = step.join(at, F.col("src") == F.col("cell_id")).select(F.col("dst").alias("cell_id")).distinct()
            walks.append(at.withColumn("hops", F.lit(hops + i)))
        reached = reduce(DataFrame.unionByName, walks).groupBy("cell_id").agg(F.min("hops").alias("hops"))
        found = Observation()
        new = saved(reached.join(seen.select("cell_id"), "cell_id", "left_anti").observe(found, F.max("hops").alias("last")), "frontier")
        hops += HOPS
        parts.append(new)
        if found.get.get("last") != hops:
            break
        frontier = new.where(F.col("hops") == hops)
        if len(parts) > PARTS:
            whole = saved(reduce(DataFrame.unionByName, parts), "seen")
            release(*parts)
            parts, frontier = [whole], whole.where(F.col("hops") == hops)
        seen = reduce(DataFrame.unionByName, parts)
    return mask.select("cell_id").join(reduce(DataFrame.unionByName, parts), "cell_id", "left").select("cell_id", F.coalesce("hops", F.lit(0)).cast("double").alias("value"))


def accumulate(values: DataFrame, receivers: DataFrame) -> DataFrame:
    """Each cell's value and all upstream of it along ``receivers`` (cell_id, value); a cell that receives itself is a sink.

    Pointers double each round, so rounds are logarithmic in the longest path.
    """
    n = values.count()
    if receivers.join(values.select(F.col("cell_id").alias("value")), "value", "left_anti").limit(1).count():
        raise FieldError("a receiver does not exist")

    def written(flow: DataFrame) -> tuple[DataFrame, int]:
        """The table, and how many still send, counted while it is written."""
        seen = Observation()
        out = saved(flow.observe(seen, F.count("to").alias("sending")), "flow")
        return out, seen.get.get("sending") or 0

    state, sending = written(values.join(receivers.select("cell_id", F.nullif(F.col("value"), F.col("cell_id")).alias("to")), "cell_id").select("cell_id", "value", "to"))
    for _ in range(max(1, math.ceil(math.log2(max(n, 2)))) + 1):
        if not sending:
            return state.select("cell_id", "value")
        sent = state.where("to IS NOT NULL").groupBy(F.col("to").alias("cell_id")).agg(F.sum("value").alias("more"))
        further = state.where("to IS NOT NULL").select(F.col("cell_id").alias("mid"), F.col("to").alias("next"))
        nxt = state.join(sent, "cell_id", "left").join(further, F.col("to") == F.col("mid"), "left")
        old, (state, sending) = state, written(nxt.select("cell_id", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"), F.col("next").alias("to")))
        release(old)
    raise FieldError("receivers form a cycle")


def component_roots(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cell_id, root)`` of the true cells: the smallest cell of their component."""
    on = mask.where("value").select("cell_id")
    inside = edges.join(on.select(F.col("cell_id").alias("src")), "src", "left_semi").join(on.select(F.col("cell_id").alias("dst")), "dst", "left_semi")
    linked = components(inside.select("src", "dst"))
    return saved(on.join(linked, F.col("cell_id") == F.col("node"), "left").select("cell_id", F.coalesce("component", "cell_id").alias("root")), "roots")


def connected_components(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """True cells numbered by component from 1, components in order of their smallest cell; false cells 0."""
    root = component_roots(mask, edges)
    # a component's root is a cell of it, and the only one that is its own root
    number = dense_numbers(root.where("cell_id = root").select("root"), "root")
    named = root.join(number, "root").select("cell_id", F.col("number").alias("value"))
    return mask.select("cell_id").join(named, "cell_id", "left").select("cell_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def dense_numbers(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys numbered from 1 in order: ranges are numbered apart and offset by the sizes of those before."""
    parts = saved(keys.repartitionByRange(key).select(key, F.spark_partition_id().alias("part")), "ranges")
    size = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    base = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return parts.join(base, "part").select(key, (F.col("base") + inner).alias("number"))


def component_summaries(labels: DataFrame, edges: DataFrame, lengths: DataFrame, areas: DataFrame) -> DataFrame:
    """``(label, cell_count, area, perimeter)`` of ``(cell_id, value)``, background 0 included.

    An edge between unlike labels counts for both sides but not for the
    background. ``lengths`` is (src, dst, length).
    """
    cells = labels.join(areas, "cell_id").groupBy(F.col("value").alias("label")).agg(F.count("*").alias("cell_count"), F.sum("area").alias("area"))
    side = lambda c, n: labels.select(F.col("cell_id").alias(c), F.col("value").alias(n))
    cut = lengths.where("src < dst").join(side("src", "l"), "src").join(side("dst", "r"), "dst").where("l <> r")
    per = cut.select("length", F.explode(F.array("l", "r")).alias("label")).where("label <> 0").groupBy("label").agg(F.sum("length").alias("perimeter"))
    out = cells.join(per, "label", "full").select("label", F.coalesce("cell_count", F.lit(0)).alias("cell_count"), F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("perimeter", F.lit(0.0)).alias("perimeter"))
    ground = out.sparkSession.createDataFrame([(0, 0, 0.0, 0.0)], "label long, cell_count long, area double, perimeter double")
    return out.unionByName(ground).groupBy("label").agg(F.sum("cell_count").alias("cell_count"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


def measure_broadcast(labels: DataFrame, summaries: DataFrame, measure: str) -> DataFrame:
    """Each cell's component's ``area``, ``perimeter`` or ``cell_count``; 0 for the background."""
    if measure not in ("area", "perimeter", "cell_count"):
        raise FieldError(f"no measure {measure}")
    m = summaries.where("label <> 0").select(F.col("label").alias("value"), F.col(measure).cast("double").alias("m"))
    return labels.join(m, "value", "left").select("cell_id", F.coalesce("m", F.lit(0.0)).alias("value"))


def network_threshold(values: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Undirected edges whose ends both reach the threshold, with the lower value: (edge_idx, src, dst, value)."""
    v = values.where(~F.isnan("value") & (F.col("value") >= threshold))
    e = edges.where("src < dst").join(v.select(F.col("cell_id").alias("src"), F.col("value").alias("a")), "src").join(v.select(F.col("cell_id").alias("dst"), F.col("value").alias("b")), "dst")
    e = saved(e.select("src", "dst", F.least("a", "b").alias("value"), F.struct("src", "dst").alias("key")).distinct(), "network")
    number = dense_numbers(e.select("key").distinct(), "key")
    return e.join(number, "key").select((F.col("number") - 1).alias("edge_idx"), "src", "dst", "value")


def iterate_until(state: DataFrame, step: Callable[[DataFrame], DataFrame], tolerance: float, cap: int, norm: str = "max") -> tuple[DataFrame, dict]:
    """Repeat ``step`` on (cell_id, value) until the change is at most ``tolerance``, at most ``cap`` times."""
    delta, rounds = math.inf, 0
    state = saved(state, "state")
    while rounds < cap and delta > tolerance:
        nxt = saved(step(state), "state")
        diff = nxt.join(state.select("cell_id", F.col("value").alias("old")), "cell_id").select((F.col("value") - F.col("old")).alias("d"))
        delta = diff.agg(F.max(F.abs("d")) if norm == "max" else F.sqrt(F.avg(F.col("d") * F.col("d")))).first()[0] or 0.0
        state, rounds = nxt, rounds + 1
    return state, {"converged": delta <= tolerance, "iterations": rounds, "final_delta": delta}
