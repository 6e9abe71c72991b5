"""Queries over the given tables, one or more for each operator, and their SQL.

Meshes: a chain or ring over ``events`` by ``event_id``, the same chain at
Fibonacci points of the sphere, and icospheres. The SQL goes another way than
the operators: windows for neighbours, islands for components, recursion for
flow.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import graph, radius
from fieldloom.plans import compare as C
from fieldloom.plans.compiler import compile_document
from fieldloom.plans.execute import Results, World, advance, execute
from fieldloom.plans.storage import shared_dir
from fieldloom.plans.validate import MASKED, compile_spec, edge_lengths, evaluate
from fieldloom.sources.mesh import SNAPSHOT_CELLS, Mesh, base_icosahedron, chain, icosphere, read_snapshot, read_tables, ring, spiral, write_snapshot, write_tables
from fieldloom.streaming.steps import EVENTS, events_of, follow, perturb, regions

SEED = 42


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("long").alias("cell_id"), F.col("value").cast("double").alias("value"), "event_type")


def _r(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


_BINDINGS = {
    "value": ("scalar_field", lambda: F.col("value")),
    "mask": ("bool_field", lambda: F.col("value") >= 50),
    "wet": ("bool_field", lambda: F.col("value") >= 20),
    "labels": ("category_field", lambda: (F.floor(F.col("value") / 10) % 4).cast("long")),
    "coarse": ("scalar_field", lambda: F.floor(F.col("value") / 10).cast("double")),
    "velocity": ("vector_field", lambda: F.struct((F.sin("value") * 0.5).alias("x"), F.lit(0.25).alias("y"), (F.cos("value") * 0.5).alias("z"))),
}


def program(spark: SparkSession, sf: str, nodes: str, mesh: Callable[[DataFrame], Mesh] = chain) -> Results:
    """Run nodes over the events, with the inputs that they name bound."""
    e = _events(spark, sf)
    used = {k: v for k, v in _BINDINGS.items() if f"$input.{k}" in nodes}
    head = "inputs: {" + ", ".join(f"{k}: {t}" for k, (t, _) in used.items()) + "}\n"
    c = compile_document(head + "programs: {generate: {nodes: {" + nodes + "}}}")
    m = mesh(e.select("cell_id"))
    given = {k: e.select("cell_id", f().alias("value")) for k, (_, f) in used.items()}
    return execute(c.program, World(m, m.cells.select("cell_id"), c.parameters, seed=SEED), given)


def _spiral(ids: DataFrame) -> Mesh:
    return spiral(ids, ids.count())


def _scalar(nodes: str, mesh=chain, rounded: bool = True) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = F.col("`out.value`")
        return program(spark, sf, nodes, mesh).fields.select("cell_id", (_r(v) if rounded else v).alias("value"))
    return run


def _vector(nodes: str, mesh=_spiral) -> Callable:
    return lambda spark, sf: program(spark, sf, nodes, mesh).fields.select("cell_id", *[_r(F.col("`out.value`")[k]).alias(k) for k in "xyz"])


def _mask(spark: SparkSession, sf: str, at: float) -> tuple[DataFrame, Mesh]:
    e = _events(spark, sf)
    return e.select("cell_id", (F.col("value") >= at).alias("value")), chain(e.select("cell_id"))


def ring_pipeline(spark: SparkSession, sf: str, passes: int = 10) -> DataFrame:
    """tanh of values, ten ring passes (2c + l + r) / 4, then the mean and the number above a half."""
    e = _events(spark, sf)
    m = ring(e.select("cell_id"), e.count())
    v = e.select("cell_id", F.tanh(F.col("value") / 100).alias("value"))
    v = graph.diffuse(v, m.edges, 0.5, passes)
    return v.agg(_r(F.avg("value")).alias("mean"), F.count_if(F.col("value") > 0.5).alias("above"))


def _summaries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    mask, m = _mask(spark, sf, 50)
    labels = graph.connected_components(mask, m.edges)
    line = m.edges.select("src", "dst", F.lit(1.0).alias("length"))
    areas = labels.select("cell_id", F.lit(1.0).alias("area"))
    return labels, graph.component_summaries(labels, m.edges, line, areas)


def component_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    labels, s = _summaries(spark, sf)
    out = [graph.measure_broadcast(labels, s, k).withColumnRenamed("value", k) for k in ("cell_count", "perimeter")]
    return out[0].join(out[1], "cell_id").select("cell_id", "cell_count", "perimeter")


def _accumulate(spark: SparkSession, sf: str) -> DataFrame:
    r = program(spark, sf, "to: {op: flow_direction, args: {potential: $input.value}}, out: {op: accumulate, args: {receivers: $node.to.value, values: $input.value}}")
    return r.fields.select("cell_id", _r(F.col("`out.value`")).alias("value"))


SCORE = """
metrics:
  mean: {op: mean, field: value}
  variance: {op: variance, field: value}
  q25: {op: quantile, field: value, q: 0.25}
  q90: {op: quantile, field: value, q: 0.9}
  above: {op: fraction_above, field: value, threshold: 50}
  below: {op: fraction_below, field: value, threshold: 20}
  correlation: {op: correlation, a: value, b: square}
  components: {op: component_count, field: mask}
  largest: {op: largest_component_fraction, field: mask}
constraints:
  positive: {expr: metrics.mean > 0}
objectives:
  share: {expr: metrics.above, weight: 2}
  compact: {expr: 1.0 - metrics.largest}
"""


def score(spark: SparkSession, sf: str) -> DataFrame:
    """All scalar metrics, component metrics and the score, as one row."""
    e = _events(spark, sf)
    m = chain(e.select("cell_id"))
    fields = e.select("cell_id", "value", (F.col("value") * F.col("value")).alias("square"), (F.col("value") >= 50).alias("mask"))
    v = evaluate(compile_spec(SCORE), fields, m)
    row = {**v.metrics, "score": v.score}
    return spark.createDataFrame([tuple(float(x) for x in row.values())], ", ".join(f"`{k}` double" for k in row)).select(*[_r(F.col(k)).alias(k) for k in row])


def _perturbed(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    m = chain(e.select("cell_id"))
    w = World(m, e.select("cell_id", "value"), seed=SEED)
    events = events_of(spark, [C.Intervention("warm", "value", "field_scale", 2.0, 100, 3), C.Intervention("lift", "value", "field_add", 10.0, 102, 2)])
    return perturb(w, events).fields


def perturb_hops(spark: SparkSession, sf: str) -> DataFrame:
    return _perturbed(spark, sf).select("cell_id", _r(F.col("value")).alias("value"))


def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    before = _events(spark, sf).select("cell_id", "value", (F.col("value") * 3).alias("effect"))
    after = _perturbed(spark, sf).select("cell_id", "value", (F.col("value") * 3).alias("effect"))
    out = C.compare(before, after, "value", "effect")
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])


def step(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    m = chain(e.select("cell_id"))
    c = compile_document("programs: {step: {nodes: {a: {op: laplacian, args: {field: $state.h}}, b: {op: pointwise, inputs: {h: $state.h, a: $node.a.value}, expr: h + 0.25 * a}}, updates: {h: $node.b.value}}}")
    w = World(m, e.select("cell_id", F.col("value").alias("h")))
    for _ in range(2):
        w = advance(c.program, w)
    return w.fields.select("cell_id", _r(F.col("h"), 9).alias("value"))


def icosphere_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, degrees and area of icospheres of levels 0 to 3."""
    out = None
    for level in range(4):
        m = icosphere(spark, level).calibrated()
        degree = m.edges.groupBy("src").count()
        one = degree.agg(F.count("*").alias("cells"), F.count_if(F.col("count") == 5).alias("fives"), F.count_if(F.col("count") == 6).alias("sixes")).withColumn("level", F.lit(level).cast("long"))
        one = one.join(m.areas.agg(_r(F.sum("area")).alias("area")).withColumn("level", F.lit(level).cast("long")), "level")
        out = one if out is None else out.unionByName(one)
    return out.select("level", "cells", "fives", "sixes", "area")


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = [F.col("embedding")[i].cast("double") for i in range(3)]
    cells = e.select(F.col("vec_id").cast("long").alias("cell_id"), *[x.alias(k) for x, k in zip(d, "xyz", strict=True)], F.col("label").cast("long").alias("label"))
    return cells.select("cell_id", "x", "y", "z"), cells.select("cell_id", "label")


def smooth_radius(spark: SparkSession, sf: str) -> DataFrame:
    cells, labels = _points(spark, sf)
    areas = cells.select("cell_id", F.lit(1.0).alias("area"))
    out = radius.smooth_radius(cells, areas, labels.select("cell_id", F.col("label").cast("double").alias("value")), 0.3)
    return out.select("cell_id", _r(F.col("value")).alias("value"))


def correlated_noise(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = _points(spark, sf)
    areas = cells.select("cell_id", F.lit(1.0).alias("area"))
    mesh = Mesh(cells, spark.createDataFrame([], "src long, dst long, ord int"), None, areas)
    c = compile_document("programs: {generate: {nodes: {rough: {op: correlated_noise, args: {radius: 0.3, amplitude: 2, mean: 3}}}}}")
    out = execute(c.program, World(mesh, cells.select("cell_id"), seed=SEED)).fields
    return out.select("cell_id", _r(F.col("`rough.value`")).alias("value"))


def voronoi(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = _points(spark, sf)
    return radius.voronoi_labels(cells, SEED, "plates", 12)


def neighborhood_count(spark: SparkSession, sf: str) -> DataFrame:
    return radius.neighborhood_count(_points(spark, sf)[0], 0.4)


def spherical_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All mask metrics of the southern half of an icosphere of level 3."""
    m = icosphere(spark, 3).calibrated()
    mask = m.cells.select("cell_id", (F.col("y") < 0).alias("south"))
    ops = ("area", "area_fraction", "perimeter", "largest_component_area_fraction", "largest_component_perimeter", "component_area_mean", "component_area_variance", "perimeter_area_ratio", "component_count", "largest_component_fraction")
    v = evaluate(compile_spec("metrics: {" + ", ".join(f"{o}: {{op: {o}, field: south}}" for o in ops) + "}"), mask, m)
    return spark.createDataFrame([(k, float(x)) for k, x in v.metrics.items()], "metric string, value double").select("metric", _r(F.col("value")).alias("value"))


def mask_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All mask metrics of values from 50 on, over Fibonacci points with equal areas."""
    e = _events(spark, sf)
    fields = e.select("cell_id", (F.col("value") >= 50).alias("high"))
    v = evaluate(compile_spec("metrics: {" + ", ".join(f"{o}: {{op: {o}, field: high}}" for o in MASKED) + "}"), fields, _spiral(e.select("cell_id")))
    return spark.createDataFrame([(k, float(x)) for k, x in v.metrics.items()], "metric string, value double").select("metric", _r(F.col("value")).alias("value"))


def network_density(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    m = chain(e.select("cell_id"))
    fields = e.select("cell_id", "value")
    links = {"links": graph.network_threshold(fields, m.edges, 50.0)}
    v = evaluate(compile_spec("metrics: {density: {op: network_density, network: links}}"), fields, m, links)
    return spark.createDataFrame([(v.metrics["density"],)], "density double").select(_r(F.col("density")).alias("density"))


#: Each expression function over ``x``, and the same in SQL over ``value``.
_CALLS = {
    "abs": ("abs(x - 50.0)", "abs(value - 50)"), "sqrt": ("sqrt(x)", "sqrt(value)"), "exp": ("exp(x * -0.01)", "exp(value * -0.01::DOUBLE)"), "log": ("log(x + 1.0)", "ln(value + 1)"),
    "sin": ("sin(x)", "sin(value)"), "cos": ("cos(x)", "cos(value)"), "tan": ("tan(clamp(x * 0.001, 0, 1))", "tan(least(value * 0.001::DOUBLE, 1))"),
    "asin": ("asin(clamp(x * 0.001, 0, 1))", "asin(least(value * 0.001::DOUBLE, 1))"), "acos": ("acos(clamp(x * 0.001, 0, 1))", "acos(least(value * 0.001::DOUBLE, 1))"), "atan": ("atan(x)", "atan(value)"),
    "tanh": ("tanh(x * 0.01)", "tanh(value * 0.01::DOUBLE)"), "floor": ("floor(x)", "floor(value)"), "ceil": ("ceil(x)", "ceil(value)"), "pow": ("pow(x, 1.5)", "pow(value, 1.5::DOUBLE)"),
    "atan2": ("atan2(x, 3.0)", "atan2(value, 3::DOUBLE)"), "min": ("min(x, 40.0)", "least(value, 40)"), "max": ("max(x, 40.0)", "greatest(value, 40)"), "clamp": ("clamp(x, 5, 90)", "least(greatest(value, 5), 90)"),
    "int": ("int(x) / 2", "floor(value)::BIGINT // 2"), "double": ("double(int(x)) / 2.0", "floor(value) / 2"),
    "choice": ("(x > 50.0 && x <= 90.0) || !(x >= 20.0) ? -x + x % 7.0 : (x - 1.0) / 4.0", "CASE WHEN value > 50 AND value <= 90 OR NOT value >= 20 THEN -value + value % 7::DOUBLE ELSE (value - 1) / 4 END"),
    "equal": ("floor(x) == 3.0 || floor(x) != 5.0 && x < 9.0 ? 1.0 : 2.0", "CASE WHEN floor(value) = 3 OR floor(value) <> 5 AND value < 9 THEN 1 ELSE 2 END"),
}


def expression_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Every function and operator of the expression language, one column for each."""
    nodes = ", ".join(f"f{i}: {{op: pointwise, inputs: {{x: $input.value}}, expr: '{own}'}}" for i, (own, _) in enumerate(_CALLS.values()))
    return program(spark, sf, nodes).fields.select("cell_id", *[_r(F.col(f"`f{i}.value`")).alias(f"r_{k}") for i, k in enumerate(_CALLS)])


def position_inputs(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    c = compile_document("inputs: {position_x: scalar_field, position_y: scalar_field, position_z: scalar_field}\nprograms: {generate: {nodes: {out: {op: pointwise, inputs: {x: $input.position_x, y: $input.position_y, z: $input.position_z}, expr: x + 2.0 * y - z}}}}")
    m = _spiral(e.select("cell_id"))
    return execute(c.program, World(m, m.cells.select("cell_id"))).fields.select("cell_id", _r(F.col("`out.value`")).alias("value"))


def component_area(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's component's area, where a cell's area is its value."""
    mask, m = _mask(spark, sf, 50)
    labels = graph.connected_components(mask, m.edges)
    areas = _events(spark, sf).select("cell_id", F.col("value").alias("area"))
    s = graph.component_summaries(labels, m.edges, m.edges.select("src", "dst", F.lit(1.0).alias("length")), areas)
    return graph.measure_broadcast(labels, s, "area").select("cell_id", _r(F.col("value")).alias("area"))


def iterate_until(spark: SparkSession, sf: str) -> DataFrame:
    """A loop that ends at its cap and one that converges: rounds, last change and mean."""
    e = _events(spark, sf).select("cell_id", "value")
    edges = chain(e.select("cell_id")).edges
    runs = {"cap": (lambda s: graph.diffuse(s, edges, 0.25, 1), 0.0, 3), "zero": (lambda s: s.select("cell_id", F.greatest(F.col("value") - 100, F.lit(0.0)).alias("value")), 0.0, 1000)}
    out = None
    for name, (move, tolerance, cap) in runs.items():
        state, info = graph.iterate_until(e, move, tolerance, cap)
        row = state.agg(F.lit(name).alias("loop"), F.lit(info["converged"]).alias("converged"), F.lit(info["iterations"]).cast("long").alias("iterations"), _r(F.lit(float(info["final_delta"]))).alias("final_delta"), _r(F.avg("value")).alias("mean"))
        out = row if out is None else out.unionByName(row)
    return out


def unchanged_outside(spark: SparkSession, sf: str) -> DataFrame:
    """Fields out of reach of a change of ``h``: ``k`` was touched at five cells, ``m`` nowhere."""
    e = _events(spark, sf)
    c = compile_document("programs: {step: {nodes: {a: {op: laplacian, args: {field: $state.h}}, b: {op: pointwise, inputs: {g: $state.g, a: $node.a.value}, expr: g + a}}, updates: {g: $node.b.value}}}")
    v = F.col("value")
    before = World(chain(e.select("cell_id")), e.select("cell_id", v.alias("h"), v.alias("g"), v.alias("k"), v.alias("m")))
    after = perturb(before, events_of(spark, [C.Intervention("lift", "h", "field_add", 10.0, 100, 2)]))
    other = advance(c.program, after).fields.withColumn("k", F.when(F.col("cell_id") < 5, F.col("k") + 1).otherwise(F.col("k")))
    return C.unchanged_outside(advance(c.program, before).fields, other, c.program, {"h"})


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of events over one field, each applied before a step; the stream is started anew for the second."""
    e = _events(spark, sf)
    w = World(chain(e.select("cell_id")), e.select("cell_id", F.col("value").alias("h")))
    c = compile_document("programs: {step: {nodes: {a: {op: laplacian, args: {field: $state.h}}, b: {op: pointwise, inputs: {h: $state.h, a: $node.a.value}, expr: h + 0.25 * a}}, updates: {h: $node.b.value}}}")
    base = f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}-stream"
    for i in (C.Intervention("warm", "h", "field_scale", 2.0, 100, 3), C.Intervention("lift", "h", "field_add", 10.0, 102, 2)):
        events_of(spark, [i]).write.mode("append").parquet(f"{base}/events")
        query, held = follow(spark.readStream.schema(EVENTS).parquet(f"{base}/events"), c.program, w, f"{base}/checkpoint")
        query.processAllAvailable()
        query.stop()
    return held["world"].fields.select("cell_id", _r(F.col("h"), 9).alias("value"))


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Values, positions and numbers of neighbours read back from a JSON snapshot, or from tables where it would be too large."""
    e = _events(spark, sf).select("cell_id", "value")
    m = chain(e.select("cell_id"))
    path = f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}-state"
    if e.count() <= SNAPSHOT_CELLS:
        write_snapshot(f"{path}.json", m, e, step=3, seed=SEED)
        back = read_snapshot(spark, f"{path}.json")
        m, e = back["mesh"], back["fields"]
    write_tables(path, m, e)
    m, e = read_tables(spark, path, triangles=False)
    degree = m.edges.groupBy(F.col("src").alias("cell_id")).agg(F.count("*").alias("neighbors"))
    return e.join(m.cells, "cell_id").join(degree, "cell_id").select("cell_id", _r(F.col("value")).alias("value"), _r(F.col("x")).alias("x"), "neighbors")


def recipe(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe used twice, the second time on the first's result."""
    e = _events(spark, sf)
    text = """
inputs: {value: scalar_field}
parameters: {gain: {default: 0.5}}
recipes:
  relax:
    inputs: {f: scalar_field}
    parameters: {k: {default: 1.0}}
    nodes:
      lap: {op: laplacian, args: {field: $input.f}}
      sum: {op: pointwise, inputs: {f: $input.f, l: $node.lap.value}, params: {k: $param.k}, expr: f + k * l}
    outputs: {out: $node.sum.value}
programs:
  generate:
    nodes:
      first: {use: relax, inputs: {f: $input.value}, params: {k: $param.gain}}
      second: {use: relax, inputs: {f: $node.first.out}, params: {k: 0.25}}
    updates: {relaxed: $node.second.out}
"""
    c = compile_document(text)
    m = chain(e.select("cell_id"))
    w = advance(c.program, World(m, e.select("cell_id"), c.parameters), {"value": e.select("cell_id", "value")})
    return w.fields.select("cell_id", _r(F.col("relaxed"), 9).alias("value"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Constant, keyed noise, an expression and one relaxation, over the events' chain."""
    nodes = "base: {op: constant, args: {value: 1.0}}, rough: {op: noise, args: {scale: 0.5}}, sum: {op: pointwise, inputs: {b: $node.base.value, r: $node.rough.value, v: $input.value}, expr: b + r + v * 0.01}, out: {op: diffuse, args: {field: $node.sum.value, rate: 0.2, iterations: 1}}"
    return program(spark, sf, nodes).fields.select("cell_id", _r(F.col("`out.value`")).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    one = lambda op, port="field", value="value", **config: f"out: {{op: {op}, args: {{{port}: $input.{value}" + "".join(f", {k}: {v}" for k, v in config.items()) + "}}"
    mean_row = lambda op: lambda s, sf: s.createDataFrame([(program(s, sf, f"out: {{op: reduce, args: {{values: $input.value, operation: {op}}}}}").scalars["out"],)], "value double").select(_r(F.col("value")).alias("value"))
    return {
        "flagship": flagship,
        "constant": _scalar("out: {op: constant, args: {value: 2.5}}"),
        "noise_keyed": _scalar("out: {op: noise, args: {scale: 2}}"),
        "pointwise": _scalar("out: {op: pointwise, inputs: {x: $input.value}, expr: 'x > 100.0 ? x / 3.0 : clamp(x * 2.0 + 1.0, 5, 90)'}"),
        "threshold": _scalar(one("threshold", threshold=50), rounded=False),
        "vector_expr": _vector("out: {op: vector_expr, inputs: {v: $input.value}, expr: ['v', '1.0', 'v * 0.5']}"),
        "vector_dot": _scalar("out: {op: vector_dot, args: {a: $input.velocity, b: $input.velocity}}"),
        "vector_magnitude": _scalar(one("vector_magnitude", value="velocity")),
        "vector_add": _vector("out: {op: vector_add, args: {a: $input.velocity, b: $input.velocity}}"),
        "vector_subtract": _vector("d: {op: scalar_vector_multiply, args: {scalar: $input.coarse, vector: $input.velocity}}, out: {op: vector_subtract, args: {a: $node.d.value, b: $input.velocity}}"),
        "scalar_vector_multiply": _vector("out: {op: scalar_vector_multiply, args: {scalar: $input.value, vector: $input.velocity}}"),
        "region_scalar": _scalar(one("region_scalar", "labels", "labels", scale=2, offset=1)),
        "region_vector": _vector(one("region_vector", "labels", "labels", magnitude=2)),
        "neighbor_sample": _scalar(one("neighbor_sample")),
        "laplacian": _scalar(one("laplacian")),
        "gradient": _vector(one("gradient")),
        "divergence": _scalar(one("divergence", value="velocity"), _spiral),
        "boundary_strength": _scalar(one("boundary_strength", "labels", "labels")),
        "boundary_signed_difference": _scalar("out: {op: boundary_signed_difference, args: {labels: $input.labels, values: $input.value, scale: 2}}", _spiral),
        "boundary_normal_component": _scalar("out: {op: boundary_normal_component, args: {labels: $input.labels, velocity: $input.velocity}}", _spiral),
        "boundary_tangential_component": _scalar("out: {op: boundary_tangential_component, args: {labels: $input.labels, velocity: $input.velocity}}", _spiral),
        "flow_direction": _scalar(one("flow_direction", "potential"), rounded=False),
        "flow_direction_ties": _scalar(one("flow_direction", "potential", "coarse"), rounded=False),
        "advect": _scalar("out: {op: advect, args: {field: $input.value, velocity: $input.velocity}}", _spiral),
        "diffuse": _scalar(one("diffuse", rate=0.2, iterations=3)),
        "ring_pipeline": ring_pipeline,
        "distance_to_mask": _scalar(one("distance_to_mask", "mask", "mask")),
        "connected_components": lambda s, sf: graph.connected_components(*(lambda m: (m[0], m[1].edges))(_mask(s, sf, 20))),
        "component_summaries": lambda s, sf: _summaries(s, sf)[1].select("label", "cell_count", _r(F.col("area")).alias("area"), _r(F.col("perimeter")).alias("perimeter")),
        "component_broadcast": component_broadcast,
        "accumulate": _accumulate,
        "network_threshold": lambda s, sf: program(s, sf, one("network_threshold", threshold=50)).networks["out"].select("edge_idx", "src", "dst", _r(F.col("value")).alias("value")),
        "reduce_mean": mean_row("mean"), "reduce_sum": mean_row("sum"), "reduce_min": mean_row("min"), "reduce_max": mean_row("max"),
        "smooth_radius": smooth_radius, "correlated_noise": correlated_noise, "voronoi_labels": voronoi, "neighborhood_count": neighborhood_count,
        "score": score, "spherical_metrics": spherical_metrics, "icosphere": icosphere_summary, "recipe": recipe,
        "mask_metrics": mask_metrics, "network_density": network_density, "expression_functions": expression_functions, "position_inputs": position_inputs, "component_area": component_area,
        "iterate_until": iterate_until, "unchanged_outside": unchanged_outside, "event_stream": event_stream, "round_trip": round_trip,
        "perturb_hops": perturb_hops, "paired_delta": paired_delta, "step": step,
        "hop_regions": lambda s, sf: regions(events_of(s, [C.Intervention("a", "value", "field_add", 1.0, 500, 4)]), _mask(s, sf, 0)[1].edges).select("event_id", "cell_id"),
        "edge_lengths": lambda s, sf: edge_lengths(_spiral(_events(s, sf).select("cell_id"))).select("src", "dst", _r(F.col("length")).alias("length")),
    }


PI = repr(math.pi)
_E = "e AS (SELECT event_id::BIGINT AS cell_id, value::DOUBLE AS value FROM events)"
_N = _E + ", n AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM e WINDOW w AS (ORDER BY cell_id))"
_L = "CAST(floor(value / 10)::BIGINT % 4 AS BIGINT)"
_U = lambda ident, salt, node: f"(('0x' || substr(sha256('{SEED}|{len(node)}|{node}{salt}|' || {ident}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
#: Fibonacci points with neighbours before (p) and after (q), values and velocities.
_S = f"""
e AS (SELECT event_id::BIGINT AS cell_id, value::DOUBLE AS value, sin(value) * 0.5::DOUBLE AS vx, 0.25::DOUBLE AS vy, cos(value) * 0.5::DOUBLE AS vz, {_L} AS lab FROM events),
u AS (SELECT *, (2 * cell_id + 1)::DOUBLE / (SELECT count(*) FROM events)::DOUBLE AS u, {PI}::DOUBLE * {1 + math.sqrt(5)!r}::DOUBLE * (cell_id + 0.5::DOUBLE) AS th FROM e),
p AS (SELECT cell_id, value, vx, vy, vz, lab, sqrt(u * (2 - u)) * cos(th) AS x, 1 - u AS y, sqrt(u * (2 - u)) * sin(th) AS z FROM u),
d AS (SELECT a.*, b.cell_id AS nid, b.value AS nv, b.vx AS nvx, b.vy AS nvy, b.vz AS nvz, b.lab AS nlab, b.x AS nx, b.y AS ny, b.z AS nz,
      b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, a.x * b.x + a.y * b.y + a.z * b.z))) AS len
      FROM p a JOIN p b ON b.cell_id = a.cell_id - 1 OR b.cell_id = a.cell_id + 1)"""
#: Neighbours' velocities transported here (mx, my, mz) and edge tangents (tx, ty, tz).
_T = _S + """,
x1 AS (SELECT *, ny * z - nz * y AS ax, nz * x - nx * z AS ay, nx * y - ny * x AS az, nx * x + ny * y + nz * z AS c FROM d),
x2 AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS s FROM x1),
x3 AS (SELECT *, ax / s AS kx, ay / s AS ky, az / s AS kz FROM x2),
x4 AS (SELECT *, kx * nvx + ky * nvy + kz * nvz AS kv, dx - x * (dx * x + dy * y + dz * z) AS ux, dy - y * (dx * x + dy * y + dz * z) AS uy, dz - z * (dx * x + dy * y + dz * z) AS uz FROM x3),
t AS (SELECT *, nvx * c + (ky * nvz - kz * nvy) * s + kx * kv * (1 - c) AS mx, nvy * c + (kz * nvx - kx * nvz) * s + ky * kv * (1 - c) AS my, nvz * c + (kx * nvy - ky * nvx) * s + kz * kv * (1 - c) AS mz,
      ux / sqrt(ux * ux + uy * uy + uz * uz) AS tx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS ty, uz / sqrt(ux * ux + uy * uy + uz * uz) AS tz FROM x4)"""


def _round(e: str, name: str = "value", digits: int = 6) -> str:
    return f"round(({e})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def _islands(at: float) -> str:
    return f"""m AS (SELECT event_id::BIGINT AS cell_id, value >= {at} AS ok FROM events),
g AS (SELECT *, cell_id - row_number() OVER (PARTITION BY ok ORDER BY cell_id) AS grp FROM m),
c AS (SELECT cell_id, CASE WHEN ok THEN dense_rank() OVER (PARTITION BY ok ORDER BY grp) ELSE 0 END::BIGINT AS label FROM g)"""


def _vectors(x: str, y: str, z: str) -> str:
    return ", ".join(_round(e, k) for e, k in ((x, "x"), (y, "y"), (z, "z")))


def _ball(value: str, r: float) -> str:
    return f"""i AS (SELECT vec_id::BIGINT AS cell_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
s AS (SELECT cell_id, {value} AS v, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM i),
b AS (SELECT a.cell_id, a.v AS own, b.v, CASE WHEN a.cell_id = b.cell_id THEN 0 ELSE acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, a.x * b.x + a.y * b.y + a.z * b.z))) END AS d FROM s a, s b),
o AS (SELECT cell_id, any_value(own) AS own, sum(pow(1 - d * d / {r * r!r}::DOUBLE, 2) * v) / sum(pow(1 - d * d / {r * r!r}::DOUBLE, 2)) AS v FROM b WHERE d <= {r!r}::DOUBLE GROUP BY cell_id),
f AS (SELECT cell_id, v + (SELECT avg(own) - avg(v) FROM o) AS v FROM o)"""


def _passes(n: int, rate: float, ring_: bool) -> str:
    """Nested relaxations by windows; on a ring the ends see each other."""
    out = []
    for k in range(n):
        edge = ", first_value(v) OVER (ORDER BY cell_id) AS f, last_value(v) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z" if ring_ else ""
        left, right = ("coalesce(l, z)", "coalesce(r, f)") if ring_ else ("l", "r")
        mean = f"({left} + {right}) / 2" if ring_ else "CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l + r) / 2 END"
        out.append(f"w{k} AS (SELECT cell_id, v, lag(v) OVER (ORDER BY cell_id) AS l, lead(v) OVER (ORDER BY cell_id) AS r{edge} FROM s{k}), s{k + 1} AS (SELECT cell_id, {1 - rate!r}::DOUBLE * v + {rate!r}::DOUBLE * ({mean}) AS v FROM w{k})")
    return ", ".join(out)


def _mask_row(cells: str, perimeters: str) -> str:
    """All mask metrics, one row each, from ``k(label, n, area)`` and ``q(label, per)``."""
    one = {
        "component_count": "count(*)", "largest_component_fraction": "max(n) / sum(n)", "area": "sum(area)", "area_fraction": f"sum(area) / (4 * {PI}::DOUBLE)", "perimeter": "sum(per)",
        "largest_component_area_fraction": "max(area) / sum(area)", "largest_component_perimeter": "first(per ORDER BY n DESC, label DESC)", "component_area_mean": "avg(area)",
        "component_area_variance": "var_pop(area)", "perimeter_area_ratio": "sum(per) / sqrt(sum(area))",
    }
    return f"k AS ({cells}), q AS ({perimeters}), j AS (SELECT k.*, coalesce(per, 0)::DOUBLE AS per FROM k LEFT JOIN q USING (label)) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_round(f)} FROM j" for m, f in one.items())


def _southern_half(level: int) -> str:
    """Mask metrics of an icosphere's cells with y < 0, from lattice points and triangles of the twenty faces."""
    vertices, faces = base_icosahedron()
    n = 1 << level
    v = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(vertices))
    f = ", ".join(str(t) for t in faces)
    corner = lambda i, j: f"list_sort(list_filter([(a, {n} - ({i}) - ({j})), (b, {i}), (c, {j})], lambda p: p[2] > 0))"
    return f"""WITH v(id, x, y, z) AS (VALUES {v}), f(a, b, c) AS (VALUES {f}),
g AS (SELECT a, b, c, i, j FROM f, range({n + 1}) r(i), range({n + 1}) s(j) WHERE i + j <= {n}),
t AS (SELECT {corner('i', 'j')} AS ka, {corner('i + 1', 'j')} AS kb, {corner('i', 'j + 1')} AS kc FROM g WHERE i + j < {n}
  UNION ALL SELECT {corner('i + 1', 'j')}, {corner('i + 1', 'j + 1')}, {corner('i', 'j + 1')} FROM g WHERE i + j < {n - 1}),
l AS (SELECT DISTINCT {corner('i', 'j')} AS key FROM g),
o AS (SELECT key, sum(p[2] * v.x ORDER BY p[1]) AS x, sum(p[2] * v.y ORDER BY p[1]) AS y, sum(p[2] * v.z ORDER BY p[1]) AS z FROM (SELECT key, unnest(key) AS p FROM l) JOIN v ON v.id = p[1] GROUP BY key),
u AS (SELECT key, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z, y < 0 AS low FROM o),
w AS (SELECT ka, kb, kc, 2 * atan2(abs(a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x)),
  1 + a.x * b.x + a.y * b.y + a.z * b.z + b.x * c.x + b.y * c.y + b.z * c.z + c.x * a.x + c.y * a.y + c.z * a.z) AS e
  FROM t JOIN u a ON a.key = ka JOIN u b ON b.key = kb JOIN u c ON c.key = kc),
r AS (SELECT key, sum(e) / 3 AS area FROM (SELECT unnest([ka, kb, kc]) AS key, e FROM w) GROUP BY key),
d AS (SELECT DISTINCT least(p, q) AS p, greatest(p, q) AS q FROM (SELECT ka AS p, kb AS q FROM t UNION ALL SELECT kb, kc FROM t UNION ALL SELECT kc, ka FROM t)),
""" + _mask_row("SELECT 1 AS label, count(*) AS n, sum(area) AS area FROM r JOIN u USING (key) WHERE low", "SELECT 1 AS label, sum(acos(least(1.0::DOUBLE, a.x * b.x + a.y * b.y + a.z * b.z))) AS per FROM d JOIN u a ON a.key = p JOIN u b ON b.key = q WHERE a.low AND NOT b.low")


_MEAN = "CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l + r) / 2 END"


def oracle_sql() -> dict[str, str]:
    weighted = lambda e: f"WITH {_T} SELECT p.cell_id, {_round(f'coalesce(q.v, 0)')} FROM p LEFT JOIN (SELECT cell_id, sum(({e}) * len) / sum(len) AS v FROM t WHERE lab <> nlab GROUP BY cell_id) q USING (cell_id)"
    rel = "(vx - mx) * {0} + (vy - my) * {1} + (vz - mz) * {2}"
    side = ("y * tz - z * ty", "z * tx - x * tz", "x * ty - y * tx")
    flow = lambda v: f"WITH {_E}, k AS (SELECT cell_id, {v} AS p FROM e), n AS (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM k WINDOW w AS (ORDER BY cell_id)), f AS (SELECT cell_id, CASE WHEN l < p AND (r IS NULL OR r >= p OR l <= r) THEN cell_id - 1 WHEN r < p THEN cell_id + 1 ELSE cell_id END AS value FROM n)"
    moved = f"m AS (SELECT cell_id, value, CASE WHEN cell_id BETWEEN 97 AND 103 THEN 2 * value ELSE value END + CASE WHEN cell_id BETWEEN 100 AND 104 THEN 10 ELSE 0 END AS after FROM e)"
    label_draw = _U(_L, "", "out")
    sphere = lambda k: _U(_L, f".{k}", "out")
    return {
        "flagship": f"WITH {_E}, s0 AS (SELECT cell_id, 1.0::DOUBLE + 0.5::DOUBLE * (2 * {_U('cell_id', '', 'rough')} - 1) + value * 0.01::DOUBLE AS v FROM e), {_passes(1, 0.2, False)} SELECT cell_id, {_round('v')} FROM s1",
        "constant": f"WITH {_E} SELECT cell_id, 2.5::DOUBLE AS value FROM e",
        "noise_keyed": f"WITH {_E} SELECT cell_id, {_round('2 * (2 * ' + _U('cell_id', '', 'out') + ' - 1)')} FROM e",
        "pointwise": f"WITH {_E} SELECT cell_id, {_round('CASE WHEN value > 100 THEN value / 3 ELSE least(greatest(value * 2 + 1, 5), 90) END')} FROM e",
        "threshold": f"WITH {_E} SELECT cell_id, value >= 50 AS value FROM e",
        "vector_expr": f"WITH {_S} SELECT cell_id, {_vectors('value - x * (value * x + y + value * 0.5 * z)', '1 - y * (value * x + y + value * 0.5 * z)', 'value * 0.5 - z * (value * x + y + value * 0.5 * z)')} FROM p",
        "vector_dot": f"WITH {_S} SELECT cell_id, {_round('vx * vx + vy * vy + vz * vz')} FROM p",
        "vector_magnitude": f"WITH {_S} SELECT cell_id, {_round('sqrt(vx * vx + vy * vy + vz * vz)')} FROM p",
        "vector_add": f"WITH {_S} SELECT cell_id, {_vectors('2 * vx', '2 * vy', '2 * vz')} FROM p",
        "vector_subtract": f"WITH {_S} SELECT cell_id, {_vectors('(floor(value / 10) - 1) * vx', '(floor(value / 10) - 1) * vy', '(floor(value / 10) - 1) * vz')} FROM p",
        "scalar_vector_multiply": f"WITH {_S} SELECT cell_id, {_vectors('value * vx', 'value * vy', 'value * vz')} FROM p",
        "region_scalar": f"WITH {_E} SELECT cell_id, {_round(f'CASE WHEN {_L} = 0 THEN 1 ELSE 1 + 2 * (2 * {label_draw} - 1) END')} FROM e",
        "region_vector": f"WITH {_S}, a AS (SELECT cell_id, x, y, z, 2 * {sphere('x')} - 1 AS ax, 2 * {sphere('y')} - 1 AS ay, 2 * {sphere('z')} - 1 AS az FROM p), b AS (SELECT cell_id, ax - x * k AS tx, ay - y * k AS ty, az - z * k AS tz FROM (SELECT *, ax * x + ay * y + az * z AS k FROM a)) SELECT cell_id, {_vectors(*[f'2 * t{k} / sqrt(tx * tx + ty * ty + tz * tz)' for k in 'xyz'])} FROM b",
        "neighbor_sample": f"WITH {_N} SELECT cell_id, {_round(_MEAN)} FROM n",
        "laplacian": f"WITH {_N} SELECT cell_id, {_round(_MEAN + ' - value')} FROM n",
        "gradient": f"WITH {_S}, g AS (SELECT cell_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, count(*) AS n, sum(dx * (nv - value) / (dx * dx + dy * dy + dz * dz)) AS gx, sum(dy * (nv - value) / (dx * dx + dy * dy + dz * dz)) AS gy, sum(dz * (nv - value) / (dx * dx + dy * dy + dz * dz)) AS gz FROM d GROUP BY cell_id) SELECT cell_id, {_vectors(*[f'(g{k} - {k} * (gx * x + gy * y + gz * z)) / n' for k in 'xyz'])} FROM g",
        "divergence": f"WITH {_T} SELECT cell_id, {_round('avg((dx * (mx - vx) + dy * (my - vy) + dz * (mz - vz)) / (dx * dx + dy * dy + dz * dz))')} FROM t GROUP BY cell_id",
        "boundary_strength": f"WITH {_E}, k AS (SELECT cell_id, {_L} AS b FROM e), n AS (SELECT *, lag(b) OVER w AS l, lead(b) OVER w AS r FROM k WINDOW w AS (ORDER BY cell_id)) SELECT cell_id, {_round('(coalesce((l <> b)::INT, 0) + coalesce((r <> b)::INT, 0))::DOUBLE / ((l IS NOT NULL)::INT + (r IS NOT NULL)::INT)')} FROM n",
        "boundary_signed_difference": f"WITH {_S} SELECT p.cell_id, {_round('coalesce(q.v, 0)')} FROM p LEFT JOIN (SELECT cell_id, sum(2 * (nv - value) * len) / sum(len) AS v FROM d WHERE lab <> nlab GROUP BY cell_id) q USING (cell_id)",
        "boundary_normal_component": weighted(rel.format("tx", "ty", "tz")),
        "boundary_tangential_component": weighted("(" + rel.format(*[f"({s})" for s in side]) + f") / sqrt(pow({side[0]}, 2) + pow({side[1]}, 2) + pow({side[2]}, 2))"),
        "flow_direction": flow("value") + " SELECT cell_id, value FROM f",
        "flow_direction_ties": flow("floor(value / 10)") + " SELECT cell_id, value FROM f",
        "advect": f"WITH {_T}, a AS (SELECT cell_id, any_value(value) AS value, any_value(least(1.0::DOUBLE, sqrt(vx * vx + vy * vy + vz * vz))) AS w, first(nv ORDER BY -(tx * -vx + ty * -vy + tz * -vz), nid) AS src FROM t GROUP BY cell_id) SELECT cell_id, {_round('(1 - w) * value + w * src')} FROM a",
        "diffuse": f"WITH {_E}, s0 AS (SELECT cell_id, value AS v FROM e), {_passes(3, 0.2, False)} SELECT cell_id, {_round('v')} FROM s3",
        "ring_pipeline": f"WITH {_E}, s0 AS (SELECT cell_id, tanh(value / 100) AS v FROM e), {_passes(10, 0.5, True)} SELECT {_round('avg(v)', 'mean')}, count(*) FILTER (WHERE v > 0.5) AS above FROM s10",
        "distance_to_mask": f"WITH {_E}, d AS (SELECT cell_id, cell_id - max(CASE WHEN value >= 50 THEN cell_id END) OVER (ORDER BY cell_id) AS a, min(CASE WHEN value >= 50 THEN cell_id END) OVER (ORDER BY cell_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - cell_id AS b FROM e) SELECT cell_id, coalesce(least(a, b), 0)::DOUBLE AS value FROM d",
        "connected_components": f"WITH {_islands(20)} SELECT cell_id, label AS value FROM c",
        "component_summaries": f"WITH {_islands(50)}, n AS (SELECT *, lag(label) OVER w AS l, lead(label) OVER w AS r FROM c WINDOW w AS (ORDER BY cell_id)) SELECT label, count(*) AS cell_count, count(*)::DOUBLE AS area, CASE WHEN label = 0 THEN 0 ELSE sum((coalesce(l, label) <> label)::INT + (coalesce(r, label) <> label)::INT) END::DOUBLE AS perimeter FROM n GROUP BY label",
        "component_broadcast": f"WITH {_islands(50)}, n AS (SELECT *, lag(label) OVER w AS l, lead(label) OVER w AS r FROM c WINDOW w AS (ORDER BY cell_id)) SELECT cell_id, CASE WHEN label = 0 THEN 0 ELSE count(*) OVER k END::DOUBLE AS cell_count, CASE WHEN label = 0 THEN 0 ELSE sum((coalesce(l, label) <> label)::INT + (coalesce(r, label) <> label)::INT) OVER k END::DOUBLE AS perimeter FROM n WINDOW k AS (PARTITION BY label)",
        "accumulate": flow("value").replace("WITH ", "WITH RECURSIVE ", 1) + f", t AS (SELECT cell_id AS origin, cell_id AS spot FROM f UNION ALL SELECT t.origin, f.value FROM t JOIN f ON f.cell_id = t.spot WHERE f.value <> t.spot) SELECT spot AS cell_id, {_round('sum(e.value)')} FROM t JOIN e ON e.cell_id = t.origin GROUP BY spot",
        "network_threshold": f"WITH {_N}, k AS (SELECT cell_id AS src, cell_id + 1 AS dst, least(value, r) AS v FROM n WHERE value >= 50 AND r >= 50) SELECT row_number() OVER (ORDER BY src) - 1 AS edge_idx, src, dst, {_round('v')} FROM k",
        **{f"reduce_{n}": f"SELECT {_round(f'{f}(value)')} FROM events" for n, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"))},
        "smooth_radius": f"WITH {_ball('label::DOUBLE', 0.3)} SELECT cell_id, {_round('v')} FROM f",
        "correlated_noise": f"WITH {_ball('2 * ' + _U('cell_id', '', 'rough') + ' - 1', 0.3)} SELECT cell_id, {_round('3 + 2 * (v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f)')} FROM f",
        "voronoi_labels": f"WITH {_ball('0', 0.3)}, k AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}|6|plates|' || cell_id), cell_id) - 1 AS label FROM s) SELECT s.cell_id, first(k.label ORDER BY s.x * k.x + s.y * k.y + s.z * k.z DESC, k.label) AS value FROM s, k WHERE k.label < 12 GROUP BY s.cell_id",
        "neighborhood_count": f"WITH {_ball('0', 0.3)} SELECT count(*) AS n FROM b WHERE d < 0.4::DOUBLE",
        "score": f"WITH {_E}, {_islands(50)}, z AS (SELECT label, count(*) AS n FROM c WHERE label > 0 GROUP BY label), k AS (SELECT avg((value > 50)::INT::DOUBLE) AS above, avg(value) AS mean FROM e), j AS (SELECT max(n)::DOUBLE / sum(n) AS largest, count(*)::DOUBLE AS components FROM z) SELECT {_round('mean', 'mean')}, {_round('(SELECT var_pop(value) FROM e)', 'variance')}, {_round('(SELECT quantile_cont(value, 0.25) FROM e)', 'q25')}, {_round('(SELECT quantile_cont(value, 0.9) FROM e)', 'q90')}, {_round('above', 'above')}, {_round('(SELECT avg((value < 20)::INT::DOUBLE) FROM e)', 'below')}, {_round('(SELECT corr(value, value * value) FROM e)', 'correlation')}, components, {_round('largest', 'largest')}, {_round('(2 * above + 1 - largest) / 3', 'score')} FROM k, j",
        "spherical_metrics": _southern_half(3),
        "mask_metrics": f"WITH {_S}, {_islands(50)}, " + _mask_row(f"SELECT label, count(*) AS n, count(*) * 4 * {PI}::DOUBLE / (SELECT count(*) FROM c) AS area FROM c WHERE label > 0 GROUP BY label", "SELECT i.label, sum(d.len) AS per FROM d JOIN c i ON i.cell_id = d.cell_id JOIN c x ON x.cell_id = d.nid WHERE i.label > 0 AND x.label = 0 AND d.cell_id < d.nid GROUP BY i.label"),
        "network_density": f"WITH {_N} SELECT {_round('count(*) FILTER (WHERE value >= 50 AND r >= 50)::DOUBLE / count(*)', 'density')} FROM n",
        "expression_functions": f"WITH {_E} SELECT cell_id, " + ", ".join(_round(sql, f"r_{k}") for k, (_, sql) in _CALLS.items()) + " FROM e",
        "position_inputs": f"WITH {_S} SELECT cell_id, {_round('x + 2 * y - z')} FROM p",
        "component_area": f"WITH {_E}, {_islands(50)} SELECT cell_id, {_round('CASE WHEN label = 0 THEN 0 ELSE sum(value) OVER (PARTITION BY label) END', 'area')} FROM c JOIN e USING (cell_id)",
        "iterate_until": f"WITH {_E}, s0 AS (SELECT cell_id, value AS v FROM e), {_passes(3, 0.25, False)} SELECT 'cap' AS loop, false AS converged, 3::BIGINT AS iterations, {_round('max(abs(s3.v - s2.v))', 'final_delta')}, {_round('avg(s3.v)', 'mean')} FROM s3 JOIN s2 USING (cell_id) UNION ALL SELECT 'zero', true, ceil(max(value) / 100)::BIGINT + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM e",
        "unchanged_outside": "SELECT 'k' AS field, count(*) FILTER (WHERE event_id < 5) AS changed_cells FROM events UNION ALL SELECT 'm', 0",
        "event_stream": f"WITH {_E}, s0 AS (SELECT cell_id, CASE WHEN cell_id BETWEEN 97 AND 103 THEN 2 * value ELSE value END AS v FROM e), {_passes(1, 0.25, False)}, q0 AS (SELECT cell_id, CASE WHEN cell_id BETWEEN 100 AND 104 THEN v + 10 ELSE v END AS v FROM s1), {_passes(1, 0.25, False).replace('s0', 'q0').replace('s1', 'q1').replace('w0', 'x0')} SELECT cell_id, {_round('v', digits=9)} FROM q1",
        "round_trip": f"WITH {_N} SELECT cell_id, {_round('value')}, {_round('cell_id', 'x')}, (l IS NOT NULL)::BIGINT + (r IS NOT NULL)::BIGINT AS neighbors FROM n",
        "icosphere": f"SELECT level, (10 * power(4, level) + 2)::BIGINT AS cells, 12::BIGINT AS fives, (10 * power(4, level) - 10)::BIGINT AS sixes, {_round(f'4 * {PI}', 'area')} FROM (SELECT unnest([0, 1, 2, 3])::BIGINT AS level)",
        "recipe": f"WITH {_E}, s0 AS (SELECT cell_id, value AS v FROM e), {_passes(1, 0.5, False)}, {_passes(1, 0.25, False).replace('s0', 'q0').replace('s1', 'q1').replace('w0', 'x0').replace('q0', 's1')} SELECT cell_id, {_round('v', digits=9)} FROM q1",
        "perturb_hops": f"WITH {_E}, {moved} SELECT cell_id, {_round('after')} FROM m",
        "paired_delta": f"WITH {_E}, {moved}, d AS (SELECT after - value AS c, 3 * after - 3 * value AS d FROM m) SELECT {_round('avg(d)', 'delta')}, {_round('avg(abs(d))', 'mean_absolute_delta')}, {_round('sqrt(avg(d * d))', 'rms_delta')}, {_round('corr(c, d)', 'correlation_delta')}, 1.0::DOUBLE AS sign_agreement, {_round('avg(d) FILTER (WHERE c <> 0)', 'masked_delta_mean')}, NULL::DOUBLE AS inside_outside_ratio FROM d",
        "step": f"WITH {_E}, s0 AS (SELECT cell_id, value AS v FROM e), {_passes(2, 0.25, False)} SELECT cell_id, {_round('v', digits=9)} FROM s2",
        "hop_regions": "SELECT 0::BIGINT AS event_id, event_id::BIGINT AS cell_id FROM events WHERE event_id BETWEEN 496 AND 504",
        "edge_lengths": f"WITH {_S} SELECT cell_id AS src, nid AS dst, {_round('len', 'length')} FROM d",
    }
