import pytest

from fieldloom.functions import cel
from fieldloom.plans.compiler import CompileError, compile_document
from fieldloom.plans.ir import Program
from fieldloom.plans.registry import OPERATORS

ONE = "programs: {generate: {nodes: {%s}}}"
INPUTS = "inputs: {s: scalar_field, v: vector_field, k: scalar}\n"


def category(text):
    with pytest.raises(CompileError) as e:
        compile_document(text)
    return e.value.category, e.value.path


@pytest.mark.parametrize(
    "text,want",
    [
        (ONE % "bad: {op: nothing}", ("UnknownOperator", "programs.generate.nodes.bad.op")),
        (ONE % "a: {op: laplacian, args: {field: $node.b.value}}", ("UnknownReference", "programs.generate.nodes.a.args.field")),
        (ONE % "a: {op: laplacian}", ("MissingArgument", "programs.generate.nodes.a.args.field")),
        (ONE % "a: {op: constant}", ("MissingArgument", "programs.generate.nodes.a.args.value")),
        (ONE % "a: {op: laplacian, args: {other: 1.0}}", ("UnknownArgument", "programs.generate.nodes.a.args.other")),
        (ONE % "a: {op: constant, args: {value: $param.p}}", ("UnknownParameter", "programs.generate.nodes.a.args.value")),
        (INPUTS + ONE % "a: {op: vector_dot, args: {a: $input.s, b: $input.v}}", ("TypeMismatch", "programs.generate.nodes.a.args.a")),
        (INPUTS + ONE % "a: {op: pointwise, inputs: {x: $input.k}, expr: x}", ("TypeMismatch", "programs.generate.nodes.a.inputs.x")),
        (INPUTS + ONE % "a: {op: pointwise, inputs: {x: $input.s}, params: {x: 1}, expr: x}", ("UnknownArgument", "programs.generate.nodes.a.params.x")),
        (INPUTS + ONE % "a: {op: pointwise, inputs: {x: $input.s}, expr: 'x +'}", ("InvalidCel", "programs.generate.nodes.a.expr")),
        (ONE % "a: {op: laplacian, args: {field: $node.b.value}}, b: {op: laplacian, args: {field: $node.a.value}}", ("DependencyCycle", "programs.generate.nodes")),
        ("recipes: {loop: {nodes: {again: {use: loop}}}}\n" + ONE % "entry: {use: loop}", ("RecipeRecursion", "programs.generate.nodes.entry.again.use")),
        ("recipes: {r: {inputs: {x: temperature}}}\n" + ONE % "a: {op: noise}", ("TypeMismatch", "recipes.r.inputs.x")),
        ("recipes: {one: {nodes: {child: {op: noise}}}}\n" + ONE % "d: {use: one}, d.child: {op: noise}", ("DuplicateNode", "programs.generate.nodes.d.child")),
        ("programs: [", ("MalformedYaml", "")),
        ("parameters: {p: {default: word}}\n" + ONE % "a: {op: noise}", ("TypeMismatch", "parameters.p.default")),
    ],
)
def test_errors(text, want):
    assert category(text) == want


def test_order_recipes_and_round_trip():
    text = INPUTS + """
recipes:
  twice:
    inputs: {f: scalar_field}
    parameters: {by: {default: 2.0}}
    nodes:
      inner: {op: laplacian, args: {field: $input.f}}
      outer: {use: scaled, inputs: {g: $node.inner.value}, params: {by: $param.by}}
    outputs: {out: $node.outer.out}
  scaled:
    inputs: {g: scalar_field}
    parameters: {by: {}}
    nodes: {m: {op: pointwise, inputs: {x: $input.g}, params: {k: $param.by}, expr: x * k}}
    outputs: {out: $node.m.value}
programs:
  generate:
    nodes:
      a: {use: twice, inputs: {f: $input.s}}
      b: {op: threshold, args: {field: $node.a.out, threshold: 0.5}}
      magnitude: {op: vector_magnitude, args: {field: $input.v}}
    updates: {mask: $node.b.value}
"""
    p = compile_document(text).program
    assert [n.id for n in p.nodes] == ["magnitude", "a.inner", "a.outer.m", "b"]
    assert p.nodes[2].args["x"].name == "a.inner" and p.nodes[2].args["k"].number == 2.0
    assert Program.from_json(p.to_json()) == p
    assert len(OPERATORS) == 30


@pytest.mark.parametrize("text,want", [("1 + 2 * 3", 7), ("(1.0 - 2) / 4", -0.25), ("7 / 2", 3), ("2 > 1 ? 5 : 6", 5), ("!(1 < 2) || true && 2.5 >= 2", True), ("clamp(5, 0, 2) + max(1, 3)", 5), ("-2 * -3", 6), ("'a' + 'b'", "ab"), ("1e3", 1000.0), ("metrics.m > 2", True)])
def test_expressions(text, want):
    assert cel.evaluate(cel.parse(text), {"metrics": {"m": 2.5}}) == want


@pytest.mark.parametrize("text", ["x +", "", "(1", "1 1", "a..b", "#", "f(1", "? 1"])
def test_bad_expressions(text):
    with pytest.raises(cel.CelError):
        cel.parse(text)
