"""Paired runs: how an intervention changed what it should and nothing else."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.ir import Program

#: The seeds that comparisons are run on.
SEEDS = (1, 7, 17, 29, 43, 71)


@dataclass(frozen=True)
class RunId:
    """What makes two runs a pair."""

    spec: str
    program: str
    seed: int
    step: int = 0


@dataclass(frozen=True)
class Intervention:
    """A declared change of one field: what is done, where and how strongly."""

    name: str
    field: str
    kind: str  # field_scale or field_add
    amount: float
    center_cell: int
    radius_hops: int


@dataclass(frozen=True)
class Display:
    """How a viewer should show a field; it rides along as column metadata."""

    role: str = "generic"
    channel: str = "color"
    unit: str = ""
    vector_mode: str = "arrows"
    provenance: dict = field(default_factory=dict)

    def attach(self, fields: DataFrame, name: str) -> DataFrame:
        meta = {"role": self.role, "channel": self.channel, "unit": self.unit, "vector_mode": self.vector_mode, "provenance": self.provenance}
        return fields.withMetadata(name, fields.schema[name].metadata | meta)


def paired(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """``(cell_id, b0, a0, d0, ...)``: both runs' fields and their differences, joined by cell."""
    b = before.select("cell_id", *[F.col(f"`{f}`").cast("double").alias(f"b{i}") for i, f in enumerate(fields)])
    a = after.select("cell_id", *[F.col(f"`{f}`").cast("double").alias(f"a{i}") for i, f in enumerate(fields)])
    return b.join(a, "cell_id").withColumns({f"d{i}": F.col(f"a{i}") - F.col(f"b{i}") for i in range(len(fields))})


def compare(before: DataFrame, after: DataFrame, cause: str, effect: str, mask: DataFrame | None = None) -> DataFrame:
    """One row of comparison metrics of ``effect``, with ``cause`` for correlation and agreement of signs.

    ``mask`` is (cell_id, value); without one, the inside is where the cause
    changed. Ratios without a denominator are null.
    """
    p = paired(before, after, [cause, effect])
    inside = mask.select("cell_id", F.col("value").alias("inside")) if mask is not None else p.select("cell_id", (F.col("d0") != 0).alias("inside"))
    p = p.join(inside, "cell_id")
    d, c = F.col("d1"), F.col("d0")
    spread = F.sqrt(F.var_pop(c) * F.var_pop(d))
    within = lambda yes: F.avg(F.when(F.col("inside") == F.lit(yes), F.abs(d)))
    return p.agg(
        F.avg(d).alias("delta"),
        F.avg(F.abs(d)).alias("mean_absolute_delta"),
        F.sqrt(F.avg(d * d)).alias("rms_delta"),
        F.when(spread > 0, F.covar_pop(c, d) / spread).alias("correlation_delta"),
        F.avg(F.when((c != 0) & (d != 0), (F.signum(c) == F.signum(d)).cast("double"))).alias("sign_agreement"),
        F.avg(F.when(F.col("inside"), d)).alias("masked_delta_mean"),
        F.when(within(False) > 0, within(True) / within(False)).alias("inside_outside_ratio"),
    )


def downstream(program: Program, changed: set[str]) -> set[str]:
    """Updated fields that depend on a changed state field, through any number of nodes."""
    touched: set[str] = set()
    for n in program.nodes:
        if any(r.kind == "node" and r.name in touched or r.kind == "state" and r.name in changed for r in n.args.values()):
            touched.add(n.id)
    return {f for f, r in program.updates.items() if r.kind == "node" and r.name in touched or r.kind == "state" and r.name in changed}


def unchanged_outside(before: DataFrame, after: DataFrame, program: Program, changed: set[str]) -> DataFrame:
    """``(field, changed_cells)`` of the fields that the change must not reach; all counts should be 0."""
    rest = sorted(set(before.columns) & set(after.columns) - {"cell_id"} - downstream(program, changed) - changed)
    b = before.select("cell_id", *[F.col(f"`{f}`").alias(f"b{i}") for i, f in enumerate(rest)])
    a = after.select("cell_id", *[F.col(f"`{f}`").alias(f"a{i}") for i, f in enumerate(rest)])
    both = b.join(a, "cell_id", "full")
    counts = [F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f) for i, f in enumerate(rest)]
    wide = both.agg(*counts) if counts else before.sparkSession.createDataFrame([], "x int")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("changed_cells")) for f in rest])).alias("r")).select("r.*") if rest else before.sparkSession.createDataFrame([], "field string, changed_cells long")
