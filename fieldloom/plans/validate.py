"""Metrics of fields, constraints and objectives over them, and a score."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import cel
from fieldloom.operators import graph
from fieldloom.operators import vectors as V
from fieldloom.plans.compiler import CompileError, load_yaml
from fieldloom.sources.mesh import Mesh


class ValidationError(ValueError):
    def __init__(self, kind: str, path: str, message: str) -> None:
        self.kind, self.path = kind, path
        super().__init__(f"{kind} at {path}: {message}" if path else f"{kind}: {message}")


SCALAR = {"mean": (), "variance": (), "quantile": ("q",), "fraction_above": ("threshold",), "fraction_below": ("threshold",)}
MASKED = ("component_count", "largest_component_fraction", "area", "area_fraction", "perimeter", "largest_component_area_fraction", "largest_component_perimeter", "component_area_mean", "component_area_variance", "perimeter_area_ratio")


@dataclass(frozen=True)
class Metric:
    op: str
    fields: tuple[str, ...]
    number: float = 0.0


@dataclass(frozen=True)
class Spec:
    metrics: dict[str, Metric]
    constraints: dict[str, cel.Node]
    objectives: dict[str, tuple[cel.Node, float]]


@dataclass(frozen=True)
class Verdict:
    valid: bool
    score: float
    metrics: dict[str, float]
    objectives: dict[str, float]
    constraints: dict[str, bool]


def compile_spec(text: str) -> Spec:
    try:
        doc = load_yaml(text)
    except CompileError as e:
        raise ValidationError("Yaml", "", e.message) from e
    metrics = {k: _metric(k, v) for k, v in sorted((doc.get("metrics") or {}).items())}

    def expression(kind: str, name: str, item: object) -> cel.Node:
        path = f"{kind}.{name}.expr"
        text = item.get("expr") if isinstance(item, dict) else None
        if not isinstance(text, (str, int, float)):
            raise ValidationError("Yaml", path, "expected an expression")
        try:
            node = cel.parse(str(text).lower() if isinstance(text, bool) else str(text))
        except cel.CelError as e:
            raise ValidationError("CelCompile", path, str(e)) from e
        for v in sorted(cel.names(node) - {"metrics"}):
            raise ValidationError("Spec", path, f"unknown variable '{v}'")
        for m in sorted(cel.members(node, "metrics") - set(metrics)):
            raise ValidationError("Spec", path, f"unknown metric '{m}'")
        return node

    constraints = {k: expression("constraints", k, v) for k, v in sorted((doc.get("constraints") or {}).items())}
    objectives = {}
    for k, v in sorted((doc.get("objectives") or {}).items()):
        w = v.get("weight", 1.0) if isinstance(v, dict) else 1.0
        if not isinstance(w, (int, float)) or isinstance(w, bool) or not math.isfinite(w) or w < 0:
            raise ValidationError("Spec", f"objectives.{k}.weight", "a weight is a number of at least 0")
        objectives[k] = (expression("objectives", k, v), float(w))
    return Spec(metrics, constraints, objectives)


def _metric(name: str, raw: object) -> Metric:
    path = f"metrics.{name}"
    if not isinstance(raw, dict) or not isinstance(raw.get("op"), str):
        raise ValidationError("Spec", path, "expected a mapping with a string op")
    op = raw["op"]

    def word(key: str) -> str:
        if not isinstance(raw.get(key), str):
            raise ValidationError("Spec", path, f"missing string {key}")
        return raw[key]

    def number(key: str) -> float:
        v = raw.get(key)
        if not isinstance(v, (int, float)) or isinstance(v, bool) or not math.isfinite(v):
            raise ValidationError("Spec", f"{path}.{key}", f"{key} takes a number other than NaN and infinity")
        return float(v)

    if op in SCALAR:
        m = Metric(op, (word("field"),), number(SCALAR[op][0]) if SCALAR[op] else 0.0)
        if op == "quantile" and not 0 <= m.number <= 1:
            raise ValidationError("Spec", f"{path}.q", "q must be in [0,1]")
        return m
    if op == "correlation":
        return Metric(op, (word("a"), word("b")))
    if op in MASKED:
        return Metric(op, (word("field"),))
    if op == "network_density":
        return Metric(op, (word("network"),))
    raise ValidationError("Spec", path, f"unsupported metric op '{op}'")


def scalar_metrics(fields: DataFrame, metrics: dict[str, Metric], cells: int | None = None) -> dict[str, float]:
    """All metrics of numeric fields from one aggregate."""
    q = lambda c: F.col(f"`{c}`")
    aggs, checked = [F.count("*").alias("n")], sorted({c for m in metrics.values() for c in m.fields})
    for c in checked:
        if c not in fields.columns:
            raise ValidationError("Metric", c, "no such field")
        aggs.append(F.count_if(q(c).isNull() | F.isnan(q(c)) | (F.abs(q(c)) == math.inf)).alias(f"bad {c}"))
    for name, m in metrics.items():
        v = q(m.fields[0])
        t = F.lit(m.number)
        one = {"mean": F.avg(v), "variance": F.var_pop(v), "quantile": F.percentile(v, m.number), "fraction_above": F.avg((v > t).cast("double")), "fraction_below": F.avg((v < t).cast("double"))}
        if m.op == "correlation":
            b = q(m.fields[1])
            spread = F.sqrt(F.var_pop(v) * F.var_pop(b))
            aggs.append(F.when(spread > 0, F.covar_pop(v, b) / spread).alias(f"m {name}"))
        else:
            aggs.append(one[m.op].alias(f"m {name}"))
    row = fields.agg(*aggs).first()
    if not row["n"] or cells is not None and row["n"] != cells:
        raise ValidationError("Metric", "", f"expected a value for each of {cells} cells")
    for c in checked:
        if row[f"bad {c}"]:
            raise ValidationError("Metric", c, "values must be finite")
    for name, m in metrics.items():
        if row[f"m {name}"] is None:
            raise ValidationError("Metric", name, "zero variance")
    return {name: float(row[f"m {name}"]) for name in metrics}


def edge_lengths(mesh: Mesh, edges: DataFrame | None = None) -> DataFrame:
    """``(src, dst, length)`` along great circles, of all edges or of those given, whose further columns stay."""
    e = mesh.edges.select("src", "dst") if edges is None else edges
    end = lambda c, n: mesh.cells.select(F.col("cell_id").alias(c), F.struct("x", "y", "z").alias(n))
    return e.join(end("src", "p"), "src").join(end("dst", "q"), "dst").select(*e.columns, V.angle(F.col("p"), F.col("q")).alias("length"))


def mask_metrics(mask: DataFrame, mesh: Mesh, edges: str = "lower") -> dict[str, float]:
    """All metrics of a mask ``(cell_id, value)``, from one table of its components.

    Of components whose areas agree to 12 digits, the one whose smallest cell
    has the highest id is the largest. ``edges``: "lower" counts a boundary edge for the true cell only if that
    has the smaller id; "all" counts each, as component summaries do.
    """
    mesh.check()
    mesh = mesh.calibrated()
    roots = graph.component_roots(mask, mesh.edges)
    cells = roots.join(mesh.areas, "cell_id").groupBy("root").agg(F.count("*").alias("cells"), F.sum("area").alias("area"))
    # only edges from true to false cells get a length
    cut = mesh.edges.select("src", "dst").where("src < dst") if edges == "lower" else mesh.edges.select("src", "dst")
    cut = cut.join(roots.withColumnRenamed("cell_id", "src"), "src").join(roots.select(F.col("cell_id").alias("dst")), "dst", "left_anti")
    per = edge_lengths(mesh, cut).groupBy("root").agg(F.sum("length").alias("perimeter"))
    c = cells.join(per, "root", "left").select("root", "cells", "area", F.coalesce("perimeter", F.lit(0.0)).alias("perimeter"))
    r = c.agg(F.count("*").alias("n"), F.sum("cells").alias("cells"), F.max("cells").alias("most"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.max("area").alias("largest"), F.max_by("perimeter", F.struct(F.round("area", 12), "root")).alias("around"), F.avg("area").alias("mean"), F.var_pop("area").alias("variance")).first()
    if not r["n"]:
        return dict.fromkeys(MASKED, 0.0)
    area, perimeter = r["area"], r["perimeter"]
    return {
        "component_count": float(r["n"]), "largest_component_fraction": r["most"] / r["cells"], "area": area, "area_fraction": area / (4 * math.pi), "perimeter": perimeter,
        "largest_component_area_fraction": r["largest"] / area if area else 0.0, "largest_component_perimeter": r["around"], "component_area_mean": r["mean"], "component_area_variance": r["variance"],
        "perimeter_area_ratio": perimeter / math.sqrt(area) if area else 0.0,
    }


def evaluate(spec: Spec, fields: DataFrame, mesh: Mesh, networks: dict[str, DataFrame] | None = None, edges: str = "lower") -> Verdict:
    """Metrics by name, then constraints and objectives over them, then the score."""
    n = mesh.cells.count()
    values = scalar_metrics(fields, own, n) if (own := {k: m for k, m in spec.metrics.items() if m.op in SCALAR or m.op == "correlation"}) else {}
    masks: dict[str, dict[str, float]] = {}
    for name, m in spec.metrics.items():
        if m.op in MASKED:
            f = m.fields[0]
            if f not in fields.columns:
                raise ValidationError("Metric", f, "no such field")
            if f not in masks:
                masks[f] = mask_metrics(fields.select("cell_id", F.col(f"`{f}`").alias("value")), mesh, edges)
            values[name] = masks[f][m.op]
        elif m.op == "network_density":
            values[name] = (networks or {})[m.fields[0]].count() / n
    for name, v in values.items():
        if not math.isfinite(v):
            raise ValidationError("Metric", name, "not finite")
    return judge(spec, values)


def judge(spec: Spec, values: dict[str, float]) -> Verdict:
    """Constraints, objectives and score of metric values that are known."""
    def run(kind: str, name: str, node: cel.Node) -> object:
        try:
            return cel.evaluate(node, {"metrics": values})
        except (cel.CelError, ArithmeticError, KeyError, TypeError, ValueError) as e:
            raise ValidationError("CelEvaluate", f"{kind}.{name}.expr", str(e)) from e

    constraints, objectives = {}, {}
    for name, node in spec.constraints.items():
        constraints[name] = run("constraints", name, node)
        if not isinstance(constraints[name], bool):
            raise ValidationError("CelEvaluate", f"constraints.{name}.expr", "expected bool")
    top = total = 0.0
    for name, (node, w) in spec.objectives.items():
        v = run("objectives", name, node)
        if isinstance(v, (bool, str)) or not math.isfinite(v):
            raise ValidationError("CelEvaluate", f"objectives.{name}.expr", "expected a finite number")
        objectives[name] = float(v)
        top, total = top + w * v, total + w
        if not (math.isfinite(w * v) and math.isfinite(top) and math.isfinite(total)):
            raise ValidationError("Score", f"objectives.{name}", "the weighted sum overflows")
    valid = all(constraints.values())
    return Verdict(valid, top / total if valid and total else 0.0, dict(sorted(values.items())), objectives, constraints)
