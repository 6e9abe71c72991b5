import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph, radius
from fieldloom.operators.components import connected_components as components
from fieldloom.plans.compiler import compile_document
from fieldloom.plans.execute import RunError, World, advance, execute, reduce_field
from fieldloom.plans.validate import edge_lengths
from fieldloom.sources.mesh import MeshError, from_lists, icosphere

X, Y, Z = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)


@pytest.fixture(scope="module")
def sphere2(spark):
    return icosphere(spark, 2).calibrated()


def line(spark, n):
    return from_lists(spark, [(float(i), 0.0, 0.0) for i in range(n)], [[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)])


def field(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"cell_id long, value {kind}")


def values(df):
    return [r["value"] for r in df.orderBy("cell_id").collect()]


def run(spark, mesh, nodes, inputs, seed=0, **fields):
    """The last node's values; inputs are (type, values, spark type)."""
    declared = "inputs: {" + ", ".join(f"{k}: {t}" for k, (t, *_ ) in inputs.items()) + "}\n"
    c = compile_document(declared + "programs: {generate: {nodes: {" + nodes + "}}}")
    given = {k: field(spark, v[1], v[2] if len(v) > 2 else "double") for k, v in inputs.items()}
    out = execute(c.program, World(mesh, mesh.cells.select("cell_id"), c.parameters, seed=seed), given)
    return [r[0] for r in out.fields.orderBy("cell_id").select("`out.value`").collect()]


def test_rowwise(spark):
    m = line(spark, 4)
    assert run(spark, m, "out: {op: pointwise, inputs: {x: $input.x}, expr: x * 2.0 + 1.0}", {"x": ("scalar_field", [0.0, 1.0, 2.0, 3.0])}) == [1, 3, 5, 7]
    assert run(spark, m, "out: {op: threshold, args: {field: $input.x, threshold: 2}}", {"x": ("scalar_field", [0.0, math.nan, 2.0, 3.0])}) == [False, False, True, True]
    v = ("vector_field", [X, Y, Z, (2.0, 2.0, 2.0)], "struct<x:double,y:double,z:double>")
    assert run(spark, m, "out: {op: vector_magnitude, args: {field: $input.v}}", {"v": v}) == pytest.approx([1, 1, 1, 2 * math.sqrt(3)])
    assert run(spark, m, "d: {op: vector_add, args: {a: $input.v, b: $input.v}}, e: {op: vector_subtract, args: {a: $node.d.value, b: $input.v}}, out: {op: vector_dot, args: {a: $node.e.value, b: $input.v}}", {"v": v}) == pytest.approx([1, 1, 1, 12])
    with pytest.raises(RunError):
        run(spark, m, "out: {op: pointwise, inputs: {x: $input.x}, expr: x > 1.0}", {"x": ("scalar_field", [0.0, 1.0, 2.0, 3.0])})
    assert run(spark, m, "out: {op: pointwise, inputs: {x: $input.x}, expr: x / 0.0}", {"x": ("scalar_field", [1.0, -1.0, 2.0, 3.0])})[:2] == [math.inf, -math.inf]


def test_vector_expression_is_tangent(spark):
    m = from_lists(spark, [X, Y, Z], [[1, 2], [0, 2], [0, 1]])
    got = run(spark, m, "out: {op: vector_expr, inputs: {s: $input.s}, expr: [s, '2.0 * s', '1.0']}", {"s": ("scalar_field", [1.0, 1.0, 1.0])})
    assert [tuple(v) for v in got] == [(0, 2, 1), (1, 0, 1), (1, 2, 0)]


def test_neighbours(spark):
    m = line(spark, 3)
    f = {"f": ("scalar_field", [2.0, 4.0, 8.0])}
    assert run(spark, m, "out: {op: neighbor_sample, args: {field: $input.f}}", f) == [4, 5, 4]
    assert run(spark, m, "out: {op: laplacian, args: {field: $input.f}}", f) == [2, 1, -4]
    lone = from_lists(spark, [X, Y], [[], []])
    assert run(spark, lone, "out: {op: neighbor_sample, args: {field: $input.f}}", {"f": ("scalar_field", [3.0, 4.0])}) == [0, 0]
    labels = ("category_field", [1, 1, 2], "long")
    assert run(spark, m, "out: {op: boundary_strength, args: {labels: $input.l}}", {"l": labels}) == [0, 0.5, 1]
    line4 = line(spark, 4)
    assert run(spark, line4, "out: {op: flow_direction, args: {potential: $input.p}}", {"p": ("scalar_field", [3.0, 2.0, 1.0, 0.0])}) == [1, 2, 3, 3]


def test_signed_difference(spark):
    m = from_lists(spark, [X, Y, Z], [[1, 2], [2, 0], [0, 1]])
    given = {"l": ("category_field", [1, 2, 2], "long"), "v": ("scalar_field", [0.0, 2.0, 2.0])}
    assert run(spark, m, "out: {op: boundary_signed_difference, args: {labels: $input.l, values: $input.v}}", given) == pytest.approx([2, -2, -2])
    assert run(spark, m, "out: {op: boundary_signed_difference, args: {labels: $input.l, values: $input.v, scale: -1}}", given) == pytest.approx([-2, 2, 2])


def test_advect(spark):
    m = from_lists(spark, [X, Y, Z, (-1.0, 0.0, 0.0)], [[1, 2, 3], [0, 2], [0, 1, 3], [0, 2]])
    still = [(0.0, 0.0, 0.0)] * 3
    kind = "struct<x:double,y:double,z:double>"
    got = run(spark, m, "out: {op: advect, args: {field: $input.f, velocity: $input.v}}", {"f": ("scalar_field", [0.0, 10.0, 20.0, 30.0]), "v": ("vector_field", [Y, *still], kind)})
    assert got == [20, 10, 20, 30]
    r = math.sqrt(0.5)
    tie = from_lists(spark, [X, (0.0, r, r), (0.0, r, -r)], [[2, 1], [], []])
    got = run(spark, tie, "out: {op: advect, args: {field: $input.f, velocity: $input.v}}", {"f": ("scalar_field", [0.0, 1.0, 2.0]), "v": ("vector_field", [(0.0, -1.0, 0.0), *still[:2]], kind)})
    assert got[0] == 1


def test_constant_fields_have_no_slope(spark, sphere2):
    n = sphere2.cells.count()
    c = ("scalar_field", [3.5] * n)
    g = run(spark, sphere2, "out: {op: gradient, args: {field: $input.c}}", {"c": c})
    assert max(abs(x) for v in g for x in v) < 1e-12
    y = [r["y"] for r in sphere2.cells.orderBy("cell_id").collect()]
    p = [tuple(r) for r in sphere2.cells.orderBy("cell_id").select("x", "y", "z").collect()]
    g = run(spark, sphere2, "out: {op: gradient, args: {field: $input.c}}", {"c": ("scalar_field", y)})
    assert max(abs(sum(a * b for a, b in zip(v, q))) for v, q in zip(g, p)) < 1e-10
    spin = [(q[2], 0.0, -q[0]) for q in p]
    d = run(spark, sphere2, "out: {op: divergence, args: {field: $input.v}}", {"v": ("vector_field", spin, "struct<x:double,y:double,z:double>")})
    assert max(map(abs, d)) < 0.1
    away = run(spark, sphere2, "n: {op: boundary_normal_component, args: {labels: $input.l, velocity: $input.v}}, t: {op: boundary_tangential_component, args: {labels: $input.l, velocity: $input.v}}, out: {op: pointwise, inputs: {n: $node.n.value, t: $node.t.value}, expr: n * n + t * t}", {"l": ("category_field", [1] * n, "long"), "v": ("vector_field", spin, "struct<x:double,y:double,z:double>")})
    assert away == [0.0] * n


def test_graph(spark):
    m = line(spark, 6)
    mask = field(spark, [True, True, False, True, True, False], "boolean")
    assert values(graph.connected_components(mask, m.edges)) == [1, 1, 0, 2, 2, 0]
    assert values(graph.distance_to_mask(field(spark, [True] + [False] * 3, "boolean"), line(spark, 4).edges)) == [0, 1, 2, 3]
    assert values(graph.distance_to_mask(field(spark, [False] * 3, "boolean"), line(spark, 3).edges)) == [0, 0, 0]
    # further than one plan walks, and through more tables than stay apart
    n = graph.HOPS * (graph.PARTS + 3)
    assert values(graph.distance_to_mask(field(spark, [True] + [False] * n, "boolean"), line(spark, n + 1).edges)) == list(range(n + 1))
    assert values(graph.accumulate(field(spark, [1.0, 2.0, 3.0]), field(spark, [1, 2, 2], "long"))) == [1, 3, 6]
    assert values(graph.accumulate(field(spark, [1.0, 2.0, 3.0, 4.0]), field(spark, [1, 3, 3, 3], "long"))) == [1, 3, 3, 10]
    with pytest.raises(graph.FieldError):
        graph.accumulate(field(spark, [1.0, 2.0]), field(spark, [1, 0], "long"))
    with pytest.raises(graph.FieldError):
        graph.accumulate(field(spark, [1.0, 2.0]), field(spark, [1, 7], "long"))
    d = values(graph.diffuse(field(spark, [0.0, 0.0, 8.0, 0.0, 0.0, 0.0]), m.edges, 0.5, 2))
    assert d == pytest.approx([1.0, 3.0, 3.0, 2.0, 0.5, 0.0][:0] or [1.0, 2.0, 3.0, 2.0, 0.5, 0.0])
    assert values(graph.diffuse(field(spark, [5.0] * 6), m.edges, 0.3, 9)) == pytest.approx([5.0] * 6)
    assert reduce_field(field(spark, [1.0, 2.0, 3.0]), "mean") == 2
    with pytest.raises(RunError):
        reduce_field(field(spark, []), "sum")
    net = graph.network_threshold(field(spark, [1.0, 2.0, 3.0, 0.0, 5.0, 6.0]), m.edges, 1.0).orderBy("edge_idx").collect()
    assert [(r["src"], r["dst"], r["value"]) for r in net] == [(0, 1, 1.0), (1, 2, 2.0), (4, 5, 5.0)]


def test_components_of_edges(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1090)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_in_few_jobs(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(400)] + [(rng.randrange(-900, 900) * 7, rng.randrange(900) * 7) for _ in range(700)]
    table = spark.createDataFrame(rng.sample(edges, len(edges)), "src long, dst long")
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    once = sorted(components(table).collect())
    # planning the jobs of many rounds fills the driver's memory
    assert jobs() - before <= 6
    monkeypatch.setattr("fieldloom.operators.components.HELD", 0)
    assert once == sorted(components(table).distinct().collect())


def test_summaries(spark):
    m = from_lists(spark, [X, Y, Z], [[1], [0, 2], [1]], [(0, 1, 2)]).calibrated()
    s = graph.component_summaries(field(spark, [1, 0, 0], "long"), m.edges, edge_lengths(m), m.areas)
    r = {x["label"]: x for x in s.collect()}
    assert r[1]["perimeter"] == pytest.approx(math.pi / 2) and r[0]["perimeter"] == 0 and r[0]["cell_count"] == 2
    assert r[1]["area"] == pytest.approx(math.pi / 6)
    assert values(graph.measure_broadcast(field(spark, [1, 0, 0], "long"), s, "cell_count")) == [1, 0, 0]


def test_icosphere(spark, sphere2):
    for level, cells, tri in ((0, 12, 20), (2, 162, 320)):
        m = sphere2 if level == 2 else icosphere(spark, level).calibrated()
        assert m.cells.count() == cells and m.triangles.count() == tri
        degree = [r["count"] for r in m.edges.groupBy("src").count().collect()]
        assert sorted(degree)[:12] == [5] * 12 and set(degree[12:]) <= {5, 6}
        assert m.areas.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi, abs=1e-10)
        m.check()
    with pytest.raises(MeshError):
        icosphere(spark, 6)
    with pytest.raises(MeshError):
        from_lists(spark, [X, Y], [[1], []]).check()


def test_meshes_that_break_rules(spark):
    flat, near = (1.0, 1.0, 0.0), [[1, 2], [0, 2], [0, 1]]
    for positions, triangles in (([X, Y, flat], [(0, 1, 2)]), ([X, Y, Z], [(0, 1, 1)]), ([X, Y, Z], [(0, 1, 7)]), ([X, Y, Z, flat], [(0, 1, 2)])):
        with pytest.raises(MeshError):
            from_lists(spark, positions, [*near, []][: len(positions)], triangles).calibrated()
    for neighbors in ([[0]], [[1, 1], [0, 0]], [[1], []], [[4]]):
        with pytest.raises(MeshError):
            from_lists(spark, [X, Y][: len(neighbors)], neighbors).check()
    with pytest.raises(MeshError):
        from_lists(spark, [X, (math.nan, 0.0, 0.0)], [[1], [0]]).check()
    one_way = from_lists(spark, [X, Y], [[1], []])
    with pytest.raises(MeshError):
        run(spark, one_way, "out: {op: boundary_signed_difference, args: {labels: $input.l, values: $input.v}}", {"l": ("category_field", [1, 2], "long"), "v": ("scalar_field", [1.0, 2.0])})
    whole = from_lists(spark, [X, Y, Z], near, [(0, 1, 2)]).calibrated()
    with pytest.raises(ValueError):
        radius.smooth_radius(whole.cells, whole.areas, field(spark, [1.0, math.inf, 2.0]), 0.5)


def test_radius(spark, sphere2):
    n = sphere2.cells.count()
    flat = radius.smooth_radius(sphere2.cells, sphere2.areas, field(spark, [3.25] * n), 0.3)
    assert values(flat) == pytest.approx([3.25] * n)
    f = field(spark, [math.sin(i) for i in range(n)])
    assert values(radius.smooth_radius(sphere2.cells, sphere2.areas, f, 0)) == values(f)
    smooth = radius.smooth_radius(sphere2.cells, sphere2.areas, f, 0.4)
    assert radius.area_mean_std(smooth, sphere2.areas)[0] == pytest.approx(radius.area_mean_std(f, sphere2.areas)[0])
    p = [tuple(r) for r in sphere2.cells.orderBy("cell_id").select("x", "y", "z").collect()]
    near = sum(1 for a in p for b in p if a == b or math.acos(max(-1, min(1, sum(x * y for x, y in zip(a, b))))) < 0.5)
    assert radius.neighborhood_count(sphere2.cells, 0.5).first()["n"] == near
    assert radius.neighborhood_count(sphere2.cells, 0).first()["n"] == n
    got = run(spark, sphere2, "out: {op: correlated_noise, args: {radius: 0.12, amplitude: 2, mean: 3}}", {}, seed=12)
    m, s = radius.area_mean_std(field(spark, got), sphere2.areas)
    assert m == pytest.approx(3) and s == pytest.approx(2)


def test_ball_means_make_no_pairs(spark, monkeypatch):
    """Cells crowded into few cubes, in several blocks, against brute force; as rows, the pairs would grow with their square."""
    rng = random.Random(2)
    p = [(rng.gauss(0, 0.2), rng.gauss(0, 0.2), 1.0) for _ in range(150)] + [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)]
    f, area = [rng.random() for _ in p], [0.5 + rng.random() for _ in p]
    cells = spark.createDataFrame([(i, *x) for i, x in enumerate(p)], "cell_id long, x double, y double, z double")
    areas = spark.createDataFrame(list(enumerate(area)), "cell_id long, area double")
    monkeypatch.setattr(radius, "ball_pairs", None)
    monkeypatch.setattr(radius, "BLOCK", 16, raising=False)
    got = values(radius.smooth_radius(cells, areas, field(spark, f), 0.3))
    u = [[c / math.hypot(*x) for c in x] for x in p]
    mean = []
    for i, a in enumerate(u):
        d = [0.0 if i == j else math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b))))) for j, b in enumerate(u)]
        w = [(1 - (x / 0.3) ** 2) ** 2 * k if x <= 0.3 else 0.0 for x, k in zip(d, area)]
        mean.append(sum(x * y for x, y in zip(w, f)) / sum(w))
    shift = sum((x - y) * k for x, y, k in zip(f, mean, area)) / sum(area)
    assert got == pytest.approx([x + shift for x in mean])


def test_random_fields(spark, sphere2):
    noise = lambda seed: run(spark, sphere2, "out: {op: noise, args: {scale: 2}}", {}, seed=seed)
    a = noise(5)
    assert a == noise(5) != noise(6) and max(map(abs, a)) <= 2 and len(set(a)) == len(a)
    v = run(spark, sphere2, "out: {op: voronoi_labels, args: {count: 7}}", {}, seed=1)
    assert set(v) == set(range(7))
    n = len(v)
    r = run(spark, sphere2, "out: {op: region_scalar, args: {labels: $input.l, scale: 3, offset: 1}}", {"l": ("category_field", v, "long")}, seed=1)
    assert {x for x, label in zip(r, v) if label == 0} == {1} and len(set(r)) == 7 and all(-2 <= x <= 4 for x in r)
    t = run(spark, sphere2, "out: {op: region_vector, args: {labels: $input.l, magnitude: 2}}", {"l": ("category_field", [3] * n, "long")})
    assert all(math.sqrt(sum(c * c for c in x)) == pytest.approx(2) for x in t)
    with pytest.raises(RunError):
        run(spark, sphere2, "out: {op: voronoi_labels, args: {count: 200}}", {})


def test_inputs_are_checked(spark):
    m = line(spark, 3)
    c = compile_document("inputs: {x: scalar_field}\nprograms: {generate: {nodes: {out: {op: laplacian, args: {field: $input.x}}}}}")
    w = World(m, m.cells.select("cell_id"))
    for given, kind in (({}, "MissingInput"), ({"x": field(spark, [1.0, 2.0])}, "FieldLength"), ({"x": field(spark, [1.0, 2.0, 3.0]), "z": 1.0}, "UnknownInput")):
        with pytest.raises(RunError) as e:
            execute(c.program, w, given)
        assert e.value.kind == kind


def test_partitions_do_not_matter(spark, sphere2):
    nodes = "n: {op: noise}, g: {op: gradient, args: {field: $node.n.value}}, l: {op: laplacian, args: {field: $node.n.value}}, out: {op: vector_magnitude, args: {field: $node.g.value}}"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(run(spark, sphere2, nodes, {}, seed=4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_advance(spark):
    m = line(spark, 4)
    c = compile_document("programs: {step: {nodes: {a: {op: laplacian, args: {field: $state.h}}, b: {op: pointwise, inputs: {h: $state.h, a: $node.a.value}, expr: h + 0.5 * a}}, updates: {h: $node.b.value}}}")
    w = World(m, spark.createDataFrame([(0, 4.0, 1), (1, 0.0, 2), (2, 0.0, 3), (3, 0.0, 4)], "cell_id long, h double, tag int"))
    new = advance(c.program, w)
    assert [(r["h"], r["tag"]) for r in new.fields.orderBy("cell_id").collect()] == [(2, 1), (1, 2), (0, 3), (0, 4)] and new.step == 1
