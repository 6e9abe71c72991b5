"""Embedding near-duplicates by NN-descent.

A neighbour graph of ``NEIGHBOURS`` per vector starts from random hyperplane
trees: vectors on the same side of a few planes are compared in groups of at
most ``GROUP``. Rounds of local joins refine it: around each vector, its
neighbours and those it is a neighbour of are compared with each other, and
what beats a list's last entry enters the list. The number of trees follows
their depth, so that two vectors at the threshold share a leaf with a chance of
``MEET``. Rounds go on while they find links and until an audit, vectors against
all rows by brute force, finds ``RECALL`` of the true links; more trees join if
it does not, and in the end the query fails. The audit grows until ``LINKED`` of
its vectors have links, or to ``AUDIT_MOST`` vectors; if none has one, the recall
is unknown: null. Edges at or above the threshold are kept, and their components
are the duplicates.

A list whose last entry is at the threshold is saturated: the vector may have
more links than the list holds. Links that leave its component are searched in
further trees without lists, where only one link for each two components that
meet in a group is kept, until such trees find none. Then saturated lists are
enlarged to all of their component, whose members are compared block by block;
only the numbers of links come out of it, so a group of m copies costs m * m
comparisons spread over tasks but never m * m rows. Identical vectors are one
node with a weight. The audit holds these final numbers against the true ones.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing and are returned; vectors link only with those of
equal length. Rows that share an id are vectors each, under one name; a row
with a null id links nothing, has no component and isn't kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import read
from fieldloom.llm.vectors import by_groups, matrix, usable
from fieldloom.operators.components import connected_components
from fieldloom.plans.storage import release, saved

NEIGHBOURS = 8
TREES, GROUP = 8, 96
#: The chance that two vectors at the threshold meet in a tree, before any local join.
MEET = 0.98
RECALL = 0.98
#: Audited vectors: at first, at most, and how many of them must have links.
AUDIT, AUDIT_MOST, LINKED = 128, 8192, 200
#: Local joins in a row, and multiples of the first trees after which an unreached recall is an error.
ROUNDS, MOST = 6, 8
BLOCK = 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _planes(tree: int, depth: int, dims: int) -> np.ndarray:
    return np.random.default_rng([31, tree, dims]).standard_normal((depth, dims))


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / (GROUP // 2)))))


def _trees_for(n: int, threshold: float) -> int:
    """Trees with which two vectors at the threshold share a leaf with a chance of ``MEET``."""
    p = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** _depth(n)
    return max(TREES, math.ceil(math.log(1 - MEET) / math.log1p(-p))) if 0 < p < 1 else TREES


def _leaves(trees: range, depth: int):
    """Rows for each tree: the leaf by the sides of its planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in np.unique(b["dims"].to_numpy()):
                at = np.flatnonzero(b["dims"].to_numpy() == d)
                rest = [b[c].take(pa.array(at)) for c in ("id", "component", "v")]
                x = _unit(matrix(rest[2]))
                for t in trees:
                    leaf = np.zeros(len(x), np.int64)
                    for bit in (x @ _planes(t, depth, int(d)).T > 0).T:
                        leaf = leaf * 2 + bit
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t * 4096 + int(d), np.int64)), pa.array(leaf), *rest], names=["tree", "leaf", "id", "component", "v"])

    return run


def _within(k: int):
    """The k nearest of each vector within one group."""

    def work(g: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x = g["id"].to_numpy(), _unit(matrix(g["v"]))
        if len(ids) < 2:
            return
        c = x @ x.T
        np.fill_diagonal(c, -np.inf)
        m = min(k, len(ids) - 1)
        near = np.argpartition(-c, m - 1, axis=1)[:, :m]
        i = np.repeat(np.arange(len(ids)), m)
        j = near.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(c[i, j])], names=["a", "b", "c"])

    return by_groups(("tree", "leaf", "part"), work)


def _around(g: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs around one vector that beat the last entry of a list; each end's list has its own bar."""
    ids, bar, x = g["id"].to_numpy(), g["bar"].to_numpy(), _unit(matrix(g["v"]))
    c = x @ x.T
    np.fill_diagonal(c, -np.inf)
    i, j = np.nonzero(c > bar[:, None])
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(c[i, j])], names=["a", "b", "c"])


def _best(pairs: DataFrame, k: int) -> DataFrame:
    p = pairs.groupBy("a", "b").agg(F.max("c").alias("c"))
    near = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return saved(p.withColumn("no", F.row_number().over(near)).where(F.col("no") <= k), "graph")


def _touching(threshold: float):
    """For each two components that touch within one group, one link between them."""

    def work(g: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, component, x = g["id"].to_numpy(), g["component"].to_numpy(), _unit(matrix(g["v"]))
        i, j = np.nonzero((x @ x.T >= threshold) & (component[:, None] < component[None, :]))
        if len(i):
            _, one = np.unique(np.stack([component[i], component[j]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[one]]), pa.array(ids[j[one]])], names=["a", "b"])

    return by_groups(("tree", "leaf", "part"), work)


def _grouped(nodes: DataFrame, n: int, trees: range) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by groups of each tree, and the table they come from."""
    rows = saved(nodes.mapInArrow(_leaves(trees, _depth(n)), "tree long, leaf long, id long, component long, v array<double>"), "leaves")
    size = rows.groupBy("tree", "leaf").agg(F.count("*").alias("m"))
    out = rows.join(size, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("m") / GROUP)).cast("long")).select("tree", "leaf", "part", "id", "component", "v")
    return out.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part"), rows


def _steps(first: int, count: int) -> Iterator[range]:
    """``count`` trees, ``TREES`` at a time."""
    for lo in range(first, first + count, TREES):
        yield range(lo, min(lo + TREES, first + count))


def _planted(nodes: DataFrame, graph: DataFrame | None, n: int, first: int, count: int, k: int) -> DataFrame:
    """The graph with what more trees find."""
    alone = nodes.withColumn("component", F.col("id"))
    for trees in _steps(first, count):
        rows, leaves = _grouped(alone, n, trees)
        more = rows.mapInArrow(_within(k), "a long, b long, c double")
        new = _best(more if graph is None else graph.select("a", "b", "c").unionByName(more), k)
        release(leaves, *([] if graph is None else [graph]))
        graph = new
    return graph


def _crossing(nodes: DataFrame, comps: DataFrame, n: int, first: int, count: int, threshold: float) -> DataFrame:
    """Links between different components, however full their members' lists are."""
    labels = comps.select(F.col("node").alias("id"), "component")
    labelled = saved(nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "v", "dims"), "labelled")
    found = []
    for trees in _steps(first, count):
        rows, leaves = _grouped(labelled, n, trees)
        found.append(saved(rows.mapInArrow(_touching(threshold), "a long, b long").distinct(), "cross"))
        release(leaves)
    out = saved(reduce(DataFrame.unionByName, found).distinct(), "cross")
    release(labelled, *found)
    return out


def _refined(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One local join over neighbours and reverse neighbours, of which a list takes its k nearest too."""
    back = Window.partitionBy("b").orderBy(F.desc("c"), "a")
    reverse = graph.withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).select(F.col("b").alias("center"), F.col("a").alias("id"))
    forward = graph.select(F.col("a").alias("center"), F.col("b").alias("id"))
    me = forward.select("center", F.col("center").alias("id"))
    bar = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("c")).otherwise(F.lit(-2.0)).alias("bar"))
    load = nodes.join(bar, F.col("id") == F.col("a"), "left").select("id", "v", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    around = forward.unionByName(reverse).unionByName(me).distinct().join(load, "id")
    around = around.repartition("center").sortWithinPartitions("center")
    new = around.mapInArrow(by_groups(("center",), _around), "a long, b long, c double")
    return _best(graph.select("a", "b", "c").unionByName(new), k)


def _counted(threshold: float):
    """For each saturated member of one block (role 0) the weight of the members of another that it links with."""

    def work(g: pa.Table) -> Iterator[pa.RecordBatch]:
        role, ids, w, x = g["role"].to_numpy(), g["id"].to_numpy(), g["weight"].to_numpy(), _unit(matrix(g["v"]))
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if len(a) and len(b):
            hit = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(hit @ w[b])], names=["id", "n"])

    return by_groups(("component", "asked", "block"), work)


def _truth(nodes: DataFrame, n: int, threshold: float) -> tuple[DataFrame, bool]:
    """``(a, n, w)``: linked vectors and linked rows of sampled vectors, by brute force; and whether it holds all vectors.

    The sample grows until ``LINKED`` of its vectors have links, or to ``AUDIT_MOST`` vectors.
    """
    take = AUDIT
    while True:
        sample = nodes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(take).toPandas()
        groups = {d: (p["id"].to_numpy(), _unit(np.stack(p["v"].to_numpy()))) for d, p in sample.groupby("dims")}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b["dims"].to_numpy()
                for d, (q_ids, q) in groups.items():  # noqa: B023
                    at = np.flatnonzero(dims == d)
                    step = max(1, 4_000_000 // len(q_ids))
                    for lo in range(0, len(at), step):
                        some = at[lo : lo + step]
                        ids, w = b["id"].to_numpy()[some], b["weight"].to_numpy()[some]
                        hit = (q @ _unit(matrix(b["v"].take(pa.array(some)))).T >= threshold) & (q_ids[:, None] != ids[None, :])
                        i = np.flatnonzero(hit.any(1))
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(hit[i].sum(1)), pa.array(hit[i] @ w)], names=["a", "n", "w"])

        true = saved(nodes.mapInArrow(scan, "a long, n long, w long").groupBy("a").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "truth")
        if take >= min(n, AUDIT_MOST) or true.count() >= LINKED:
            return true, take >= n
        release(true)
        take *= 4


def _recall(true: DataFrame, whole: bool, want: str, held: DataFrame) -> float | None:
    """The lesser of the share of all links in ``want`` that ``held`` ``(a, m)`` has and its mean over vectors; None where no link was seen."""
    m = F.least(F.coalesce("m", F.lit(0)), F.col(want))
    r = true.join(held, "a", "left").agg(F.sum(m) / F.sum(want), F.avg(m / F.col(want))).first()
    return (1.0 if whole else None) if r[0] is None else min(r)


def _linked(nodes: DataFrame, edges: DataFrame, n: int, used: int, need: int, threshold: float, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Components, rows that each vector links with, and trees used; full lists are enlarged to all of their component."""
    comps = saved(connected_components(edges, "a", "b"), "comps")
    full = edges.groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("id"))
    cross = None
    while full.limit(1).count():
        # a full list hides links that leave its component: search those alone, until there are none
        new = _crossing(nodes, comps, n, used, need, threshold)
        used += need
        if not new.limit(1).count():
            release(new)
            break
        cross = new if cross is None else cross.unionByName(new)
        release(comps)
        comps = saved(connected_components(edges.unionByName(cross), "a", "b"), "comps")
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    recount = full if cross is None else full.unionByName(cross.select(F.col("a").alias("id")))
    big = comps.join(recount, F.col("node") == F.col("id"), "left_semi").select("component").distinct()
    members = comps.join(big, "component").join(nodes.select("id", "v", "weight"), F.col("node") == F.col("id")).select("component", "id", "v", "weight")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = saved(members.join(size, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "members")
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = members.select("component", F.lit(0).alias("role"), F.col("part").alias("asked"), spread.alias("block"), "id", "v", "weight")
    held = members.select("component", F.lit(1).alias("role"), spread.alias("asked"), F.col("part").alias("block"), "id", "v", "weight")
    met = asks.unionByName(held).repartition("component", "asked", "block").sortWithinPartitions("component", "asked", "block")
    enlarged = met.mapInArrow(_counted(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    listed = pairs.join(nodes.select(F.col("id").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("n")).join(enlarged.select("id"), F.col("a") == F.col("id"), "left_anti")
    linked = saved(enlarged.unionByName(listed.select(F.col("a").alias("id"), "n")), "linked")
    release(members)
    return comps, linked, used


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, measured_recall)`` for each row; linked are cosines at or above the threshold."""
    spark = rows.sparkSession
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = usable(every, "vec_id", "v")
    nodes = saved(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("dims", F.size("v")), "nodes")
    if nodes.groupBy("id").count().where("count > 1").limit(1).count():
        # an id stands for several vectors: number the vectors themselves
        own = F.xxhash64("id", "v")
        nodes, named = saved(nodes.withColumn("id", own), "nodes"), saved(nodes.select(own.alias("node"), F.col("id").alias("first")), "names")
    else:
        named = nodes.select(F.col("id").alias("node"), F.col("id").alias("first"))
    n = nodes.count()
    true, whole = _truth(nodes, n, threshold)
    enough = lambda r: r is None or r >= RECALL
    need = _trees_for(n, threshold)
    graph, used, recall = None, 0, None
    while True:
        links = -1
        for _ in range(ROUNDS):
            if graph is None or not enough(recall):
                count = need if graph is None else TREES
                graph = _planted(nodes, graph, n, used, count, k)
                used += count
            new = _refined(graph, nodes, k)
            release(graph)
            graph = new
            near = graph.where(F.col("c") >= threshold)
            now = near.count()
            # a full list counts as complete here, as it is enlarged below
            held = near.groupBy("a").agg(F.count("*").alias("m"))
            recall = _recall(true, whole, "n", held.select("a", F.when(F.col("m") >= k, F.lit(1 << 62)).otherwise(F.col("m")).alias("m")))
            if enough(recall) and now <= links * 1.001:
                break
            links = now
        edges = saved(graph.where(F.col("c") >= threshold).select("a", "b"), "edges")
        comps, linked, used = _linked(nodes, edges, n, used, need, threshold, k)
        recall = _recall(true, whole, "w", linked.select(F.col("id").alias("a"), F.col("n").alias("m")))
        if enough(recall):
            break
        if used > need * MOST:
            raise RuntimeError(f"recall {recall:.3f} after {used} trees")
        release(comps, linked, edges)
    roots = comps.join(named, "node").select("node", "first", "component")
    roots = roots.join(roots.groupBy("component").agg(F.min("first").alias("root")), "component").select("node", "root")
    per = nodes.join(linked, "id", "left").join(roots, F.col("id") == F.col("node"), "left").drop("node")
    per = per.join(named, F.col("id") == F.col("node"))
    per = per.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "first").alias("component"))
    out = every.join(per.withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("measured_recall"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings at a cosine of 0.95."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)


#: The same by brute force, for tables whose ids are distinct; a search that found all links has a recall of 1.
OP3_SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON len(a.v) = len(b.v)
  WHERE a.vec_id <> b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.root AS component_id, e.vec_id = r.root AS kept, 1::DOUBLE AS measured_recall
FROM embeddings e JOIN roots r ON e.vec_id = r.a LEFT JOIN degrees d ON e.vec_id = d.a
"""
