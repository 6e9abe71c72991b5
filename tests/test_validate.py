import json
import math
import shutil

import pytest
from pyspark.sql import functions as F

from fieldloom import cli
from fieldloom.operators import graph
from fieldloom.plans import search
from fieldloom.plans.compare import Intervention, compare, downstream, unchanged_outside
from fieldloom.plans.compiler import CompileError, compile_document
from fieldloom.plans.execute import World, advance
from fieldloom.plans.validate import MASKED, ValidationError, compile_spec, evaluate, judge, mask_metrics
from fieldloom.sources.mesh import from_lists, icosphere, read_snapshot, read_tables, write_snapshot, write_tables
from fieldloom.streaming.steps import EVENTS, Worlds, events_of, follow, perturb


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(0, 1.0, 2.0, 8.0, True), (1, 2.0, 4.0, 6.0, True), (2, 3.0, 6.0, 4.0, False), (3, 4.0, 8.0, 2.0, True)]
    return spark.createDataFrame(rows, "cell_id long, left double, right double, negative double, mask boolean")


@pytest.fixture(scope="module")
def mesh(spark):
    return from_lists(spark, [(float(i), 0.0, 0.0) for i in range(4)], [[1], [0, 2], [1], []])


SPEC = """
metrics:
  mean: {op: mean, field: left}
  variance: {op: variance, field: left}
  q0: {op: quantile, field: left, q: 0}
  q5: {op: quantile, field: left, q: 0.5}
  q1: {op: quantile, field: left, q: 1}
  above: {op: fraction_above, field: left, threshold: 2}
  below: {op: fraction_below, field: left, threshold: 3}
  up: {op: correlation, a: left, b: right}
  down: {op: correlation, a: left, b: negative}
  components: {op: component_count, field: mask}
  largest: {op: largest_component_fraction, field: mask}
constraints: {positive: {expr: metrics.mean > 2}, always: {expr: 'true'}}
objectives: {a: {expr: metrics.above, weight: 2}, b: {expr: metrics.largest}}
"""


def test_metrics_and_score(fields, mesh):
    v = evaluate(compile_spec(SPEC), fields, mesh)
    want = {"mean": 2.5, "variance": 1.25, "q0": 1, "q5": 2.5, "q1": 4, "above": 0.5, "below": 0.5, "up": 1, "down": -1, "components": 2, "largest": 2 / 3}
    assert v.metrics == pytest.approx(want) and v.valid and v.score == pytest.approx((0.5 * 2 + 2 / 3) / 3)


def test_failed_constraint_scores_nothing():
    v = judge(compile_spec("metrics: {m: {op: mean, field: x}}\nconstraints: {c: {expr: metrics.m > 2}}\nobjectives: {o: {expr: '1'}}"), {"m": 1.0})
    assert not v.valid and v.score == 0 and v.objectives == {"o": 1.0}


@pytest.mark.parametrize(
    "text",
    ["metrics: {m: {op: other, field: x}}", "metrics: {m: {op: mean}}", "metrics: {m: {op: mean, field: y}}", "metrics: {m: {op: quantile, field: x, q: 2}}", "metrics: {m: 1}", "constraints: {c: {expr: other > 1}}", "constraints: {c: {expr: metrics.none > 1}}", "constraints: {c: {expr: 'metrics.m >'}}", "objectives: {o: {expr: '1', weight: -1}}", "metrics: ["],
)
def test_bad_specs(text):
    with pytest.raises(ValidationError):
        compile_spec(text)


def test_overflow_and_types():
    for text in ("objectives: {a: {expr: '1e308', weight: 1e308}}", "constraints: {c: {expr: '1'}}", "objectives: {o: {expr: 'true'}}"):
        with pytest.raises(ValidationError):
            judge(compile_spec(text), {})


def test_bad_values(spark, mesh, fields):
    with pytest.raises(ValidationError):
        evaluate(compile_spec("metrics: {m: {op: mean, field: x}}"), fields.withColumn("x", F.when(F.col("cell_id") == 0, math.nan).otherwise(1.0)), mesh)
    with pytest.raises(ValidationError):
        evaluate(compile_spec("metrics: {m: {op: correlation, a: left, b: x}}"), fields.withColumn("x", F.lit(1.0)), mesh)
    with pytest.raises(ValidationError):
        evaluate(compile_spec("metrics: {m: {op: mean, field: left}}"), fields.limit(2), mesh)


def test_spherical(spark):
    m = icosphere(spark, 2).calibrated()
    every = mask_metrics(m.cells.select("cell_id", F.lit(True).alias("value")), m)
    assert every["area"] == pytest.approx(4 * math.pi, abs=1e-10) and every["area_fraction"] == pytest.approx(1, abs=1e-12) and every["perimeter"] == 0
    assert mask_metrics(m.cells.select("cell_id", F.lit(False).alias("value")), m) == dict.fromkeys(MASKED, 0.0)
    half = m.cells.select("cell_id", (F.col("y") > 0).alias("value"))
    low, both = mask_metrics(half, m), mask_metrics(half, m, edges="all")
    assert 0 < low["perimeter"] <= both["perimeter"] and low["component_count"] == 1 and 0.4 < low["area_fraction"] < 0.6


STEP = "programs: {step: {nodes: {a: {op: laplacian, args: {field: $state.h}}, b: {op: pointwise, inputs: {h: $state.h, a: $node.a.value}, expr: h + 0.25 * a}}, updates: {h: $node.b.value}}}"


def world(spark):
    m = from_lists(spark, [(float(i), 0.0, 0.0) for i in range(6)], [[j for j in (i - 1, i + 1) if 0 <= j < 6] for i in range(6)])
    return World(m, spark.createDataFrame([(i, float(i), 1.0) for i in range(6)], "cell_id long, h double, k double"))


def test_perturb_and_compare(spark):
    w = world(spark)
    e = events_of(spark, [Intervention("x", "h", "field_scale", 2.0, 2, 1), Intervention("y", "h", "field_add", 1.0, 3, 1)])
    p = perturb(w, e)
    assert [r["h"] for r in p.fields.orderBy("cell_id").collect()] == [0, 2, 5, 7, 5, 5]
    c = compile_document(STEP).program
    a, b = advance(c, w), advance(c, p)
    assert downstream(c, {"h"}) == {"h"}
    assert [tuple(r) for r in unchanged_outside(a.fields, b.fields, c, {"h"}).collect()] == [("k", 0)]
    r = compare(w.fields, p.fields, "h", "h").first()
    assert r["delta"] == pytest.approx((1 + 3 + 4 + 1) / 6) and r["sign_agreement"] == 1 and r["correlation_delta"] == pytest.approx(1)
    with pytest.raises(ValueError):
        perturb(w, events_of(spark, [Intervention("x", "none", "field_add", 2.0, 2, 1)]))


def test_stream(spark, tmp_path):
    w = world(spark)
    src = tmp_path / "in"
    events_of(spark, [Intervention("y", "h", "field_add", 6.0, 3, 0)]).write.parquet(str(src))
    q, held = follow(spark.readStream.schema(EVENTS).parquet(str(src)), compile_document(STEP).program, w, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = [r["h"] for r in held["world"].fields.orderBy("cell_id").collect()]
    assert held["world"].step == 1 and got == pytest.approx([0.25, 1.0, 2.75, 7.5, 4.75, 4.75])


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    w, program, src, ck = world(spark), compile_document(STEP).program, str(tmp_path / "in"), str(tmp_path / "ck")
    lift = [events_of(spark, [Intervention("y", "h", "field_add", amount, 3, 0)]) for amount in (6.0, -2.0)]
    for part in lift:
        part.write.mode("append").parquet(src)
        q, held = follow(spark.readStream.schema(EVENTS).parquet(src), program, w, ck)  # each time a new query from the same start
        q.processAllAvailable()
        q.stop()
    want = w
    for part in lift:
        want = advance(program, perturb(want, part))
    rows = lambda x: [tuple(r) for r in x.fields.select("cell_id", "h", "k").orderBy("cell_id").collect()]
    assert held["world"].step == 2 and rows(held["world"]) == rows(want)
    past = Worlds(w, ck + "/worlds")
    assert past.epochs() == [0, 1] and rows(past.before(1)) == rows(advance(program, perturb(w, lift[0])))
    again = past.keep(advance(program, perturb(past.before(1), lift[1])), 1)  # a batch that comes again
    assert rows(again) == rows(want)
    shutil.rmtree(ck + "/worlds/1/mark")  # a crash before the mark
    assert past.epochs() == [0] and past.before(None).step == 1


def test_search(spark):
    text = "parameters: {level: {default: 0.0, search: {min: 0, max: 1, mutation_sigma: 0.3}}}\nprograms: {generate: {nodes: {a: {op: constant, args: {value: $param.level}}}, updates: {f: $node.a.value}}}"
    c = compile_document(text)
    dims = search.space(text)
    w = World(world(spark).mesh, world(spark).fields.select("cell_id"), c.parameters)
    best, verdict, history = search.optimize(c.program, w, compile_spec("metrics: {m: {op: mean, field: f}}\nobjectives: {o: {expr: metrics.m}}"), dims, generations=2, population=2, seed=1)
    assert history == sorted(history) and verdict.score == pytest.approx(best["level"]) and 0 < best["level"] <= 1


def test_command_line(spark, tmp_path):
    spec = tmp_path / "spec.yaml"
    spec.write_text("parameters: {k: {default: 0.5}}\nprograms: {generate: {nodes: {n: {op: noise}, s: {op: pointwise, inputs: {n: $node.n.value, y: $input.position_y}, params: {k: $param.k}, expr: n * k + y}}, updates: {h: $node.s.value}}}".replace("parameters:", "inputs: {position_y: scalar_field}\nparameters:"))
    out = [tmp_path / f"{i}.json" for i in range(3)]
    for path, seed in zip(out, ("42", "42", "43")):
        cli.main(["--spec", str(spec), "--output", str(path), "--level", "1", "--seed", seed, "--param", "k=0.1", "--param", "k=0.25"])
    docs = [json.loads(p.read_text()) for p in out]
    assert docs[0] == docs[1] != docs[2] and len(docs[0]["fields"]["h"]["Scalar"]) == 42 and docs[0]["parameters"] == {"k": 0.25}
    with pytest.raises(CompileError):
        cli.overridden({"k": 1.0}, ["z=1"])
    with pytest.raises(CompileError):
        cli.overridden({"k": 1.0}, ["k=inf"])


def test_snapshot_round_trip(spark, tmp_path):
    m = from_lists(spark, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], [[1, 2], [0], [0]], [(0, 1, 2)])
    f = spark.createDataFrame([(i, float(i), (1.0, 0.0, float(i)), i > 0, i) for i in range(3)], "cell_id long, h double, wind struct<x:double,y:double,z:double>, land boolean, plate long")
    net = {"rivers": spark.createDataFrame([(0, 0, 1, 0.5)], "edge_idx long, src long, dst long, value double")}
    path = str(tmp_path / "s.json")
    write_snapshot(path, m, f, net, {"p": 2.0}, 3, 2**63)
    s = read_snapshot(spark, path)
    assert s["fields"].orderBy("cell_id").select("h", "wind", "land", "plate").collect() == f.orderBy("cell_id").drop("cell_id").collect()
    assert s["parameters"] == {"p": 2.0} and s["step"] == 3 and s["seed"] == 2**63 and s["networks"]["rivers"].first()["value"] == 0.5
    assert sorted(map(tuple, s["mesh"].edges.collect())) == sorted(map(tuple, m.edges.collect()))
    write_tables(str(tmp_path / "t"), m, f)
    m2, f2 = read_tables(spark, str(tmp_path / "t"))
    assert m2.cells.count() == 3 and f2.count() == 3


def test_bits_do_not_depend_on_partitions(spark):
    seen = set()
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ball = icosphere(spark, 2)
        cells, areas = ball.cells.orderBy("cell_id").collect(), ball.calibrated().areas.orderBy("cell_id").collect()
        values = ball.cells.select("cell_id", (F.col("x") * 3.7 + F.col("y") * F.col("z")).alias("value")).repartition(n)
        seen.add(repr((cells, areas, graph.diffuse(values, ball.edges, 0.3, 4).orderBy("cell_id").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
