"""Run programs over a mesh: one wide frame of fields, keyed by cell.

Nodes are run level by level. Everything row-wise between two gathers becomes
one projection; all neighbour operators whose inputs are ready share one
gathered join. Fix-points and ball operators write their state and join back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import cel
from fieldloom.operators import gather as G
from fieldloom.operators import graph, keyed, radius
from fieldloom.operators import vectors as V
from fieldloom.operators.graph import FieldError
from fieldloom.plans.ir import Program, Ref, Step
from fieldloom.plans.registry import OPERATORS
from fieldloom.plans.storage import saved
from fieldloom.sources.mesh import Mesh


class RunError(ValueError):
    """A program can't run on this state; ``kind`` says why."""

    def __init__(self, kind: str, message: str) -> None:
        self.kind = kind
        super().__init__(f"{kind}: {message}")


@dataclass(frozen=True)
class World:
    mesh: Mesh
    fields: DataFrame  # cell_id and a column per field
    parameters: dict[str, float] = field(default_factory=dict)
    networks: dict[str, DataFrame] = field(default_factory=dict)
    step: int = 0
    seed: int = 0


@dataclass
class Results:
    """All nodes' values: ``fields`` has a column ``id.value`` per field node."""

    fields: DataFrame
    networks: dict[str, DataFrame]
    scalars: dict[str, float]


_KINDS = {"double": "scalar_field", "boolean": "bool_field"}
GATHERS = {"neighbor_sample", "laplacian", "gradient", "divergence", "boundary_strength", "boundary_signed_difference", "boundary_normal_component", "boundary_tangential_component", "flow_direction", "advect"}
LOOPS = {"diffuse", "distance_to_mask", "accumulate", "smooth_radius", "correlated_noise", "voronoi_labels", "network_threshold", "reduce"}
#: Operators that rely on symmetric adjacency without repeats.
MUTUAL = {"boundary_signed_difference", "network_threshold"}
#: Gathers that look at positions.
PLACED = {"gradient", "divergence", "boundary_signed_difference", "boundary_normal_component", "boundary_tangential_component", "advect"}


class _Run:
    def __init__(self, program: Program, world: World, inputs: Mapping[str, DataFrame | float]) -> None:
        self.world, self.mesh, self.inputs = world, world.mesh, dict(inputs)
        self.wide = world.mesh.cells.select("cell_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
        self.state: dict[str, str] = {}
        self.networks: dict[str, DataFrame] = {}
        self.scalars: dict[str, float] = {}
        self.calibrated: Mesh | None = None
        self._bring_in(program)

    def _bring_in(self, program: Program) -> None:
        """Join referenced fields once, and check them with one pass: a value for each cell, no nulls."""
        refs = [r for n in program.nodes for r in n.args.values()] + [*program.updates.values(), *program.outputs.values()]
        wanted = {r.name for r in refs if r.kind == "input"}
        for name in sorted(set(self.inputs) - wanted):
            raise RunError("UnknownInput", name)
        for name in sorted(wanted):
            if name in ("position_x", "position_y", "position_z") and name not in self.inputs:
                self.wide = self.wide.withColumn(f"input:{name}", F.col(name[-1]))
            elif name not in self.inputs:
                raise RunError("MissingInput", name)
            elif isinstance(self.inputs[name], DataFrame):
                own = self.inputs[name].select("cell_id", F.col("value").alias(f"input:{name}"))
                self.wide = self.wide.join(own, "cell_id", "left")
        state = sorted({r.name for r in refs if r.kind == "state"})
        for name in state:
            if name not in self.world.fields.columns:
                raise RunError("UnknownState", name)
        if state:
            self.wide = self.wide.join(self.world.fields.select("cell_id", *[F.col(f"`{n}`").alias(f"state:{n}") for n in state]), "cell_id", "left")
        new = [c for c in self.wide.columns if c.startswith(("input:", "state:"))]
        if any(not c.startswith("input:position_") for c in new):
            bad = self.wide.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in new]).first()
            for c in new:
                if bad[c]:
                    raise RunError("FieldLength", f"{c.partition(':')[2]} has no value at {bad[c]} cells")

    def column(self, ref: Ref) -> str:
        if ref.kind == "node":
            return f"{ref.name}.value"
        if ref.kind in ("input", "state"):
            return f"{ref.kind}:{ref.name}"
        raise RunError("InputType", f"{ref.kind} {ref.name} is not a field")

    def number(self, step: Step, name: str, default: float | None = None) -> float:
        ref = step.args.get(name)
        if ref is None:
            return default
        if ref.kind == "literal":
            value = ref.number
        elif ref.kind == "param":
            if ref.name not in self.world.parameters:
                raise RunError("MissingParameter", ref.name)
            value = self.world.parameters[ref.name]
        elif ref.kind == "input" and not isinstance(self.inputs[ref.name], DataFrame):
            value = float(self.inputs[ref.name])
        elif ref.kind == "node" and ref.name in self.scalars:
            value = self.scalars[ref.name]
        else:
            raise RunError("UnsupportedConfiguration", f"{step.id}.{name} must be a literal, parameter or scalar input")
        if not math.isfinite(value):
            raise RunError("UnsupportedConfiguration", f"{step.id}.{name} must be finite")
        return value

    def whole(self, step: Step, name: str, least: int) -> int:
        value = self.number(step, name)
        if value != int(value) or value < least:
            raise RunError("UnsupportedConfiguration", f"{step.id}.{name} must be an integer of at least {least}")
        return int(value)

    def areas(self) -> DataFrame:
        self.calibrated = self.calibrated or self.mesh.calibrated()
        return self.calibrated.areas

    # what each kind of node comes to

    def expression(self, step: Step) -> Column:
        scope, inner = {}, {}
        kinds = dict(self.wide.dtypes)
        for name, ref in step.args.items():
            if ref.kind in ("node", "input", "state") and f"{self.column(ref)}" in self.wide.columns:
                c = F.col(f"`{self.column(ref)}`")
                kind = kinds[self.column(ref)]
                if kind.startswith("struct"):
                    inner[name] = {k: cel.Typed("double", c[k]) for k in "xyz"}
                else:
                    scope[name] = cel.Typed("bool" if kind == "boolean" else "int" if kind in ("bigint", "int") else "double", c)
            else:
                scope[name] = cel.Typed("double", F.lit(self.number(step, name)))
        if len(step.cel) != (3 if step.op == "vector_expr" else 1):
            raise RunError("Expression", f"{step.id} takes {3 if step.op == 'vector_expr' else 1} expressions, has {len(step.cel)}")
        parts = []
        for text in step.cel:
            try:
                t = cel.compile(cel.parse(text), scope, inner)
            except cel.CelError as e:
                raise RunError("Expression", f"{step.id}: {e}") from e
            if t.type not in ("double", "int"):
                raise RunError("Expression", f"{step.id} gives {t.type}, not a number")
            parts.append(t.column.cast("double"))
        return V.tangent(V.vec(*parts), G.here()) if step.op == "vector_expr" else parts[0]

    def rowwise(self, step: Step) -> Column:
        op, c = step.op, {k: F.col(f"`{self.column(r)}`") for k, r in step.args.items() if k in OPERATORS[step.op].ports}
        seed = self.world.seed
        if op in ("pointwise", "vector_expr"):
            return self.expression(step)
        if op == "constant":
            return F.lit(self.number(step, "value"))
        if op == "noise":
            return keyed.noise(seed, step.id, F.col("cell_id"), self.number(step, "scale", 1.0))
        if op == "threshold":
            return ~F.isnan(c["field"]) & (c["field"] >= self.number(step, "threshold"))
        if op == "vector_dot":
            return V.dot(c["a"], c["b"])
        if op == "vector_magnitude":
            return V.norm(c["field"])
        if op == "vector_add":
            return V.add(c["a"], c["b"])
        if op == "vector_subtract":
            return V.subtract(c["a"], c["b"])
        if op == "scalar_vector_multiply":
            return V.scale(c["vector"], c["scalar"])
        if op == "region_scalar":
            return keyed.region_scalar(seed, step.id, c["labels"], self.number(step, "scale", 1.0), self.number(step, "offset", 0.0))
        if op == "region_vector":
            return G.region_vector(seed, step.id, self.column(step.args["labels"]), self.number(step, "magnitude"))
        raise RunError("NotImplemented", op)

    def near(self, step: Step, near: G.Near) -> Column:
        c = {k: self.column(r) for k, r in step.args.items() if k in OPERATORS[step.op].ports}
        simple = {"neighbor_sample": G.neighbor_sample, "laplacian": G.laplacian, "gradient": G.gradient, "divergence": G.divergence}
        if step.op in simple:
            return simple[step.op](near, c["field"])
        if step.op == "boundary_strength":
            return G.boundary_strength(near, c["labels"])
        if step.op == "boundary_signed_difference":
            return G.boundary_signed_difference(near, c["labels"], c["values"], self.number(step, "scale", 1.0))
        if step.op == "flow_direction":
            return G.flow_direction(near, c["potential"])
        if step.op == "advect":
            return G.advect(near, c["field"], c["velocity"])
        f = G.boundary_normal if step.op == "boundary_normal_component" else G.boundary_tangential
        return f(near, c["labels"], c["velocity"])

    def loop(self, step: Step) -> DataFrame | None:
        get = lambda k: self.wide.select("cell_id", F.col(f"`{self.column(step.args[k])}`").alias("value"))
        edges, cells = self.mesh.edges, self.mesh.cells
        if step.op == "diffuse":
            return graph.diffuse(get("field"), edges, self.number(step, "rate"), self.whole(step, "iterations", 0))
        if step.op == "distance_to_mask":
            return graph.distance_to_mask(get("mask"), edges)
        if step.op == "accumulate":
            return graph.accumulate(get("values"), get("receivers"))
        if step.op == "smooth_radius":
            return radius.smooth_radius(cells, self.areas(), get("field"), self.number(step, "radius"))
        if step.op == "correlated_noise":
            rough = cells.select("cell_id", keyed.noise(self.world.seed, step.id, F.col("cell_id")).alias("value"))
            smooth = saved(radius.smooth_radius(cells, self.areas(), rough, self.number(step, "radius")), "smooth")
            return radius.standardized(smooth, self.areas(), self.number(step, "amplitude", 1.0), self.number(step, "mean", 0.0))
        if step.op == "voronoi_labels":
            count, n = self.whole(step, "count", 1), cells.count()
            if count > n:
                raise RunError("UnsupportedConfiguration", f"{step.id}.count is above the {n} cells")
            return radius.voronoi_labels(cells, self.world.seed, step.id, count)
        if step.op == "network_threshold":
            self.networks[step.id] = graph.network_threshold(get("field"), edges, self.number(step, "threshold"))
            return None
        self.scalars[step.id] = reduce_field(get("values"), step.word)
        return None

    def run(self, nodes: list[Step]) -> None:
        if any(s.op in MUTUAL for s in nodes):
            self.mesh.check()
        todo = list(nodes)
        while todo:
            ready = lambda s: all(r.kind != "node" or f"{r.name}.value" in self.wide.columns or r.name in self.scalars or r.name in self.networks for r in s.args.values())
            row = [s for s in todo if s.op not in GATHERS | LOOPS and ready(s)]
            if row:
                self.wide = self.wide.withColumns({f"{s.id}.value": self.rowwise(s) for s in row})
                todo = [s for s in todo if s not in row]
                continue
            some = [s for s in todo if s.op in GATHERS and ready(s)]
            if some:
                columns = sorted({self.column(r) for s in some for k, r in s.args.items() if k in OPERATORS[s.op].ports})
                columns += list("xyz") if any(s.op in PLACED for s in some) else []
                near = G.Near(columns)
                # written once: the gathered join reads it twice
                self.wide = saved(self.wide, "level")
                both = G.gathered(self.wide, self.mesh.edges, columns)
                self.wide = both.withColumns({f"{s.id}.value": self.near(s, near) for s in some}).drop(G.NEAR)
                todo = [s for s in todo if s not in some]
                continue
            step = next(s for s in todo if ready(s))
            self.wide = saved(self.wide, "level")
            out = self.loop(step)
            if out is not None:
                self.wide = self.wide.join(out.select("cell_id", F.col("value").alias(f"{step.id}.value")), "cell_id", "left")
            todo.remove(step)


def reduce_field(values: DataFrame, operation: str) -> float:
    """Sum, mean, min or max of ``value``; NaN is left out of min and max."""
    v = F.col("value")
    table = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(F.when(~F.isnan(v), v)), "max": F.max(F.when(~F.isnan(v), v))}
    if operation not in table:
        raise RunError("UnsupportedConfiguration", f"reduce takes one of {', '.join(table)}")
    n, out = values.agg(F.count("*"), table[operation]).first()
    if not n:
        raise RunError("Reduction", "an empty field has no " + operation)
    return out


def execute(program: Program, world: World, inputs: Mapping[str, DataFrame | float] | None = None) -> Results:
    """All nodes' values; inputs are frames (cell_id, value) or numbers."""
    r = _Run(program, world, inputs or {})
    r.run(program.nodes)
    return Results(r.wide, r.networks, r.scalars)


def advance(program: Program, world: World, inputs: Mapping[str, DataFrame | float] | None = None) -> World:
    """The state after the program's updates: fields and networks replaced, one step on."""
    if not program.updates:
        raise RunError("NoUpdates", "a program must update at least one field")
    r = _Run(program, world, inputs or {})
    r.run(program.nodes)
    new, networks = {}, dict(world.networks)
    for name, ref in program.updates.items():
        if ref.kind == "node" and ref.name in r.networks:
            networks[name] = r.networks[ref.name]
        elif ref.kind in ("node", "input", "state") and r.column(ref) in r.wide.columns:
            new[name] = r.column(ref)
        else:
            raise RunError("UpdateType", f"{name} must be updated with a field")
    fresh = r.wide.select("cell_id", *[F.col(f"`{c}`").alias(n) for n, c in new.items()])
    kept = [c for c in world.fields.columns if c not in new]
    fields = world.fields.select(*kept).join(fresh, "cell_id") if len(kept) > 1 else fresh
    return replace(world, fields=saved(fields, "world"), networks=networks, step=world.step + 1)


__all__ = ["FieldError", "Results", "RunError", "World", "advance", "execute", "reduce_field"]
