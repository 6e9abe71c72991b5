"""Meshes: cells with positions, directed edges in neighbour order, triangles if any."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.plans.storage import release, saved


#: Cells up to which a state is written as one document.
SNAPSHOT_CELLS = 1_000_000


class MeshError(ValueError):
    """The mesh breaks what an operator relies on."""


@dataclass(frozen=True)
class Mesh:
    cells: DataFrame  # cell_id, x, y, z
    edges: DataFrame  # src, dst, ord
    triangles: DataFrame | None = None  # a, b, c
    areas: DataFrame | None = None  # cell_id, area

    def calibrated(self) -> Mesh:
        """The mesh with spherical vertex areas; equal shares of the sphere where no triangles are given.

        Given triangles must join distinct cells off one plane through the
        centre, and leave no cell without an area; else ``MeshError``.
        """
        if self.areas is not None:
            return self
        if self.triangles is None:
            n = self.cells.count()
            return replace(self, areas=self.cells.select("cell_id", F.lit(4 * math.pi / max(n, 1)).alias("area")))
        t = saved(excesses(self.cells, self.triangles), "excesses")
        if t.where("excess IS NULL OR isnan(excess) OR NOT excess > 0 OR a = b OR b = c OR a = c").limit(1).count():
            raise MeshError("a triangle is degenerate or names a cell that does not exist")
        areas = saved(vertex_areas(self.cells, t), "areas")
        release(t)
        if areas.where("NOT area > 0").limit(1).count():
            raise MeshError("a cell belongs to no triangle")
        return replace(self, areas=areas)

    def check(self) -> None:
        """Raise if adjacency is asymmetric, repeats or names cells that don't exist, or a position isn't finite.

        A mesh that passed isn't looked at again.
        """
        if self.__dict__.get("_passed"):
            return
        odd = [F.col(k).isNull() | F.isnan(k) | (F.abs(k) == math.inf) for k in "xyz"]
        if self.cells.where(odd[0] | odd[1] | odd[2]).limit(1).count():
            raise MeshError("a position is not finite")
        # both directions of a pair meet in one group, so one shuffle answers for all of them
        pair = self.edges.groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.count_if(F.expr("src < dst")).alias("up"), F.count_if(F.expr("src > dst")).alias("down"))
        found = pair.agg(F.count_if(F.expr("p = q")).alias("loops"), F.count_if(F.expr("up > 1 OR down > 1")).alias("again"), F.count_if(F.expr("up <> down")).alias("single")).first()
        if found["loops"]:
            raise MeshError("a cell neighbours itself")
        if found["again"]:
            raise MeshError("a neighbour is repeated")
        if found["single"]:
            raise MeshError("adjacency is not symmetric")
        if self.edges.join(self.cells, F.col("dst") == F.col("cell_id"), "left_anti").limit(1).count():
            raise MeshError("a neighbour does not exist")
        object.__setattr__(self, "_passed", True)


def unit(x: str = "x", y: str = "y", z: str = "z"):
    n = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return [(F.col(c) / n).alias(c) for c in (x, y, z)]


def excesses(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """``(a, b, c, excess)``: each triangle's spherical excess, null where it names a cell that doesn't exist."""
    u = cells.select("cell_id", *unit())
    t = triangles
    for corner in "abc":
        c = u.select(F.col("cell_id").alias(corner), *[F.col(k).alias(f"{corner}{k}") for k in "xyz"])
        t = t.join(c, corner, "left")
    dot = lambda p, q: sum(F.col(f"{p}{k}") * F.col(f"{q}{k}") for k in "xyz")
    cross = [F.col("by") * F.col("cz") - F.col("bz") * F.col("cy"), F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz"), F.col("bx") * F.col("cy") - F.col("by") * F.col("cx")]
    volume = F.abs(sum(F.col(f"a{k}") * v for k, v in zip("xyz", cross, strict=True)))
    return t.select("a", "b", "c", (2 * F.atan2(volume, 1 + dot("a", "b") + dot("b", "c") + dot("c", "a"))).alias("excess"))


def vertex_areas(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """A third of each triangle's ``excess`` to each corner."""
    per = triangles.select(F.col("excess").alias("e"), F.explode(F.array("a", "b", "c")).alias("cell_id")).groupBy("cell_id")
    # a corner's few triangles in order of size, so that the sum's bits don't depend on partitions
    per = per.agg((F.aggregate(F.array_sort(F.collect_list("e")), F.lit(0.0), lambda total, e: total + e) / 3).alias("area"))
    return cells.select("cell_id").join(per, "cell_id", "left").select("cell_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def line_edges(ids: DataFrame, n: int | None = None) -> DataFrame:
    """Neighbours i - 1 and i + 1 of contiguous ids; round a ring of ``n`` if given."""
    near = F.array(F.struct(F.lit(-1).alias("d"), F.lit(0).alias("ord")), F.struct(F.lit(1).alias("d"), F.lit(1).alias("ord")))
    e = ids.select(F.col("cell_id").alias("src"), F.explode(near).alias("n")).select("src", (F.col("src") + F.col("n.d")).alias("dst"), "n.ord")
    if n is not None:
        return e.withColumn("dst", F.pmod("dst", F.lit(n)))
    last = ids.agg(F.max("cell_id")).first()[0]
    return e.where((F.col("dst") >= 0) & (F.col("dst") <= (last if last is not None else -1)))


def chain(ids: DataFrame) -> Mesh:
    """A line of cells along x over a frame with contiguous ``cell_id`` from 0."""
    cells = ids.select("cell_id", F.col("cell_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return Mesh(cells, line_edges(ids))


def ring(ids: DataFrame, n: int) -> Mesh:
    angle = F.col("cell_id") * F.lit(2 * math.pi / n)
    cells = ids.select("cell_id", F.cos(angle).alias("x"), F.lit(0.0).alias("y"), F.sin(angle).alias("z"))
    return Mesh(cells, line_edges(ids, n))


def spiral(ids: DataFrame, n: int) -> Mesh:
    """Chain adjacency at Fibonacci points of the unit sphere."""
    u = (2 * F.col("cell_id") + 1).cast("double") / F.lit(float(n))
    theta = F.lit(math.pi * (1 + math.sqrt(5))) * (F.col("cell_id") + 0.5)
    r = F.sqrt(u * (2 - u))
    cells = ids.select("cell_id", (r * F.cos(theta)).alias("x"), (1 - u).alias("y"), (r * F.sin(theta)).alias("z"))
    return Mesh(cells, line_edges(ids))


def base_icosahedron() -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Twelve unit vertices with poles on y, and the twenty faces that join neighbours."""
    v = [(0.0, 1.0, 0.0)]
    lat = math.atan(0.5)
    for sign, shift in ((1, 0.0), (-1, math.pi / 5)):
        for k in range(5):
            a = 2 * math.pi * k / 5 + shift
            v.append((math.cos(lat) * math.cos(a), sign * math.sin(lat), math.cos(lat) * math.sin(a)))
    v.append((0.0, -1.0, 0.0))
    faces = []
    for k in range(5):
        m = (k + 1) % 5
        faces += [(0, 1 + k, 1 + m), (1 + k, 6 + k, 1 + m), (1 + m, 6 + k, 6 + m), (11, 6 + m, 6 + k)]
    return v, faces


def icosphere(spark: SparkSession, level: int) -> Mesh:
    """The icosahedron with edges cut in 2 ** level, from 0 to 5; 10 * 4 ** level + 2 cells.

    Lattice points are keyed by their integer weights of base vertices, so
    faces share points without comparing coordinates.
    """
    if not 0 <= level <= 5:
        raise MeshError(f"level {level} is not between 0 and 5")
    n = 1 << level
    vertices, faces = base_icosahedron()
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(faces)], "face int, a int, b int, c int")
    grid = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(0), n - F.col("i"))))
    weights = lambda i, j: F.array_sort(F.filter(F.array(F.struct(F.col("a").alias("v"), (n - i - j).alias("w")), F.struct(F.col("b").alias("v"), i.alias("w")), F.struct(F.col("c").alias("v"), j.alias("w"))), lambda x: x["w"] > 0))
    i, j = F.col("i"), F.col("j")
    points = grid.select(weights(i, j).alias("key")).distinct()
    # summed in the order of the key, so that bits depend on nothing else
    axis = lambda k: F.aggregate("key", F.lit(0.0), lambda total, p: total + p["w"] * F.element_at(F.array(*[F.lit(v[k]) for v in vertices]), p["v"] + 1))
    where = points.select("key", *[axis(k).alias(c) for k, c in enumerate("xyz")])
    cells = saved(where.select((F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("cell_id"), "key", *unit()), "cells")  # at most 10,242 rows
    up = grid.where(i + j < n).select(weights(i, j).alias("ka"), weights(i + 1, j).alias("kb"), weights(i, j + 1).alias("kc"))
    down = grid.where(i + j < n - 1).select(weights(i + 1, j).alias("ka"), weights(i + 1, j + 1).alias("kb"), weights(i, j + 1).alias("kc"))
    t = up.unionByName(down)
    for c in "abc":
        t = t.join(cells.select(F.col("key").alias(f"k{c}"), F.col("cell_id").alias(c)), f"k{c}")
    triangles = saved(t.select("a", "b", "c"), "triangles")
    sides = F.explode(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p in "abc" for q in "abc" if p != q]))
    edges = triangles.select(sides.alias("e")).select("e.src", "e.dst").distinct()
    edges = saved(edges.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1), "edges")
    return Mesh(cells.select("cell_id", "x", "y", "z"), edges, triangles)


def from_lists(spark: SparkSession, positions: list, neighbors: list[list[int]], triangles: list | None = None) -> Mesh:
    """A small mesh from lists."""
    cells = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(positions)], "cell_id long, x double, y double, z double")
    edges = spark.createDataFrame([(i, j, o) for i, ns in enumerate(neighbors) for o, j in enumerate(ns)], "src long, dst long, ord int")
    tri = spark.createDataFrame([tuple(t) for t in triangles], "a long, b long, c long") if triangles else None
    return Mesh(cells, edges, tri)


_SNAPSHOT = "mesh struct<positions:array<array<double>>,triangles:array<array<bigint>>,neighbors:array<array<bigint>>>, fields map<string,struct<Scalar:array<double>,Vector:array<array<double>>,Bool:array<boolean>,Category:array<bigint>,Index:array<bigint>>>, networks map<string,struct<edges:array<array<bigint>>,values:array<double>>>, parameters map<string,double>, step bigint, seed decimal(20,0)"


def read_snapshot(spark: SparkSession, path: str) -> dict:
    """A state written as one JSON document: ``mesh``, ``fields`` (one wide frame), ``networks``, ``parameters``, ``step``, ``seed``."""
    raw = saved(spark.read.schema(_SNAPSHOT).json(path, multiLine=True), "snapshot")
    at = lambda c, *names: raw.select(F.posexplode(c).alias("cell_id", "v")).select(F.col("cell_id").cast("long"), *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    cells = at("mesh.positions", "x", "y", "z")
    edges = raw.select(F.posexplode("mesh.neighbors").alias("src", "ns")).select(F.col("src").cast("long"), F.posexplode("ns").alias("ord", "dst")).select("src", "dst", "ord")
    triangles = at("mesh.triangles", "a", "b", "c").drop("cell_id")
    head = raw.select(F.map_keys("fields").alias("f"), F.map_keys("networks").alias("n"), "parameters", "step", "seed").first()
    fields = cells.select("cell_id")
    for name in head["f"] or []:
        v = F.col("fields")[name]
        for kind in ("Scalar", "Vector", "Bool", "Category", "Index"):
            one = raw.where(v[kind].isNotNull()).select(F.posexplode(v[kind]).alias("cell_id", "v"))
            if one.limit(1).count():
                value = F.struct(*[F.col("v")[i].alias(k) for i, k in enumerate("xyz")]) if kind == "Vector" else F.col("v")
                fields = fields.join(one.select(F.col("cell_id").cast("long"), value.alias(name)), "cell_id", "left")
    networks = {n: raw.select(F.posexplode(F.col("networks")[n]["edges"]).alias("edge_idx", "e"), F.col("networks")[n]["values"].alias("vs")).select("edge_idx", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), F.get("vs", "edge_idx").alias("value")) for n in head["n"] or []}
    triangles = triangles if triangles.limit(1).count() else None
    return {"mesh": Mesh(cells, edges, triangles), "fields": fields, "networks": networks, "parameters": dict(head["parameters"] or {}), "step": head["step"], "seed": int(head["seed"] or 0)}


def write_snapshot(path: str, mesh: Mesh, fields: DataFrame, networks: dict[str, DataFrame] | None = None, parameters: dict[str, float] | None = None, step: int = 0, seed: int = 0) -> None:
    """The state as one JSON document, for meshes that a viewer can hold; larger ones go to ``write_tables``."""
    if mesh.cells.limit(SNAPSHOT_CELLS + 1).count() > SNAPSHOT_CELLS:
        raise MeshError(f"more than {SNAPSHOT_CELLS} cells are too many for one document; use write_tables")
    kinds = {"double": "Scalar", "boolean": "Bool", "bigint": "Category", "int": "Category"}
    cells = [list(r) for r in mesh.cells.orderBy("cell_id").select("x", "y", "z").collect()]
    near: list[list[int]] = [[] for _ in cells]
    for r in mesh.edges.orderBy("src", "ord").collect():
        near[r["src"]].append(r["dst"])
    tri = [list(r) for r in mesh.triangles.select("a", "b", "c").orderBy("a", "b", "c").collect()] if mesh.triangles is not None else []
    rows = fields.orderBy("cell_id").collect()
    out = {}
    for f in fields.schema.fields:
        if f.name != "cell_id":
            kind = (f.metadata or {}).get("kind", "").capitalize() or kinds.get(f.dataType.simpleString(), "Vector")
            out[f.name] = {kind: [list(r[f.name]) if kind == "Vector" else r[f.name] for r in rows]}
    nets = {}
    for n, d in (networks or {}).items():
        es = d.orderBy("edge_idx").collect()
        nets[n] = {"edges": [[r["src"], r["dst"]] for r in es], "values": None if all(r["value"] is None for r in es) else [r["value"] for r in es]}
    doc = {"mesh": {"positions": cells, "triangles": tri, "neighbors": near}, "fields": out, "networks": nets, "parameters": parameters or {}, "step": step, "seed": seed}
    spark = fields.sparkSession
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(json.dumps(doc, indent=2).encode()))
    stream.close()


def write_tables(path: str, mesh: Mesh, fields: DataFrame) -> None:
    """The state as Parquet tables, written in parallel."""
    for name, df in (("cells", mesh.cells), ("edges", mesh.edges), ("triangles", mesh.triangles), ("fields", fields)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, triangles: bool = True) -> tuple[Mesh, DataFrame]:
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return Mesh(read("cells"), read("edges"), read("triangles") if triangles else None), read("fields")
