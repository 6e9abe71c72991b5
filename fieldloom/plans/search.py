"""Parameter search: candidates are rows, scores come from validating each one's world."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from fieldloom.plans.compiler import load_yaml
from fieldloom.plans.execute import World, advance
from fieldloom.plans.ir import Program
from fieldloom.plans.validate import Spec, Verdict, evaluate


@dataclass(frozen=True)
class Dimension:
    low: float
    high: float
    sigma: float


def space(text: str) -> dict[str, Dimension]:
    """The searchable parameters of a document: those with ``search: {min, max, mutation_sigma}``."""
    out = {}
    for name, p in sorted((load_yaml(text).get("parameters") or {}).items()):
        s = (p or {}).get("search")
        if s:
            low, high = float(s["min"]), float(s["max"])
            if not (math.isfinite(low) and math.isfinite(high) and low <= high):
                raise ValueError(f"parameters.{name}.search must have finite min <= max")
            out[name] = Dimension(low, high, float(s.get("mutation_sigma", (high - low) / 10)))
    return out


def mutate(parameters: dict[str, float], dims: dict[str, Dimension], rng: random.Random) -> dict[str, float]:
    """Each searched parameter moved by its sigma, kept in its range."""
    moved = {k: min(max(rng.gauss(parameters.get(k, (d.low + d.high) / 2), d.sigma), d.low), d.high) for k, d in dims.items()}
    return parameters | moved


def optimize(program: Program, world: World, spec: Spec, dims: dict[str, Dimension], generations: int = 5, population: int = 4, seed: int = 0, inputs_of: Callable[[dict[str, float]], dict] | None = None) -> tuple[dict[str, float], Verdict, list[float]]:
    """A (1 + population) evolution; returns the best parameters, their verdict and the best score by generation."""
    rng = random.Random(seed)

    def judged(parameters: dict[str, float]) -> Verdict:
        w = World(world.mesh, world.fields, parameters, world.networks, world.step, world.seed)
        new = advance(program, w, inputs_of(parameters) if inputs_of else None)
        return evaluate(spec, new.fields, new.mesh, new.networks)

    best = dict(world.parameters)
    verdict = judged(best)
    history = [verdict.score]
    for _ in range(generations):
        for _ in range(population):
            candidate = mutate(best, dims, rng)
            v = judged(candidate)
            if (v.valid, v.score) > (verdict.valid, verdict.score):
                best, verdict = candidate, v
        history.append(verdict.score)
    return best, verdict, history
