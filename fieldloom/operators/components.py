"""Connected components of an edge table: in one task if it is short, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldloom.plans.storage import release, saved

#: Edges that one task labels, about 150 bytes each; more go through rounds, whose many small jobs are planned by the driver.
HELD = 1 << 20


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges ``(u, v)`` with the smallest it is linked to, over several edges too."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        # a root above another takes the least root that an edge shows it, then all paths are shortened
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Returns ``(node, component)``. Nulls and self-loops link nothing. Up to
    ``HELD`` distinct edges are labelled by one task. Beyond, each round rewires every node to the least neighbour it knows, so the number
    of rounds is logarithmic in the longest path; hubs are only ever reduced
    by partial minima, and the joins can be split where a hub is skewed.
    """
    pair = lambda a, b: (F.col(a).alias("u"), F.col(b).alias("v"))
    size = Observation()
    cur = saved(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v"))
        .distinct()
        .observe(size, F.count("*").alias("n")),
        "cc",
    )
    if size.get.get("n", 0) <= HELD:
        return cur.coalesce(1).mapInArrow(_labelled, "node long, component long")
    mark = None
    for _ in range(max_rounds):
        both = cur.select(*pair("u", "v")).unionAll(cur.select(*pair("v", "u")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        # counted while it is written, so that a round is one job
        seen = Observation()
        nxt = saved(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
        release(cur)
        cur = nxt
        now = seen.get
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
