"""Compiled programs: nodes in an order in which each comes after what it reads."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Ref:
    """Where a value comes from: input, param, node, state or literal."""

    kind: str
    name: str = ""
    output: str = ""
    number: float = 0.0


@dataclass(frozen=True)
class Step:
    id: str
    op: str
    args: dict[str, Ref]
    #: Expressions: one for pointwise, three for vector_expr.
    cel: list[str] = field(default_factory=list)
    #: A word of configuration, for reduce.
    word: str = ""


@dataclass(frozen=True)
class Program:
    nodes: list[Step]
    updates: dict[str, Ref]
    outputs: dict[str, Ref] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Program:
        raw = json.loads(text)
        refs = lambda d: {k: Ref(**v) for k, v in d.items()}
        return Program([Step(n["id"], n["op"], refs(n["args"]), n["cel"], n["word"]) for n in raw["nodes"]], refs(raw["updates"]), refs(raw["outputs"]))
