"""Generate a world from a document: ``python -m fieldloom.cli --spec FILE --output FILE``."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import SparkSession

from fieldloom.plans.compiler import CompileError, compile_document
from fieldloom.plans.execute import World, advance
from fieldloom.sources.mesh import icosphere, write_snapshot, write_tables


def overridden(defaults: dict[str, float], given: list[str]) -> dict[str, float]:
    """Defaults with NAME=VALUE items; the last of a name wins."""
    out = dict(defaults)
    for item in given:
        name, sep, value = item.partition("=")
        if not sep or name not in defaults:
            raise CompileError("UnknownParameter", f"parameters.{name}", "no such parameter with a default")
        try:
            out[name] = float(value)
        except ValueError:
            out[name] = math.nan
        if not math.isfinite(out[name]):
            raise CompileError("TypeMismatch", f"parameters.{name}", "expected a finite number")
    return out


def generate(spark: SparkSession, text: str, level: int = 2, seed: int = 42, params: list[str] | None = None) -> World:
    """The world after the program ``generate`` of the document has run over an icosphere."""
    c = compile_document(text, "generate")
    mesh = icosphere(spark, level)
    return advance(c.program, World(mesh, mesh.cells.select("cell_id"), overridden(c.parameters, params or []), seed=seed))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--spec", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--level", type=int, default=2)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--param", action="append", default=[])
    p.add_argument("--tables", action="store_true", help="write Parquet tables instead of one JSON document")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    with open(a.spec) as f:
        world = generate(spark, f.read(), a.level, a.seed, a.param)
    if a.tables:
        write_tables(a.output, world.mesh, world.fields)
    else:
        write_snapshot(a.output, world.mesh, world.fields, world.networks, world.parameters, 0, a.seed)


if __name__ == "__main__":
    main()
