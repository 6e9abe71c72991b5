"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a hierarchical k-means over a bounded sample: a cluster
is split until none has more than its share, so that lists are balanced. They
are searched through an in-memory graph of near centroids. Each vector is
posted under its nearest centroid and, near a boundary, under others whose
distance is within ``REPLICATE`` of the nearest's. A query reads the lists
whose centroids' distance is within a ratio of its nearest's, and the next nearest
lists while these hold fewer than k candidates. The ratio is
measured, not guessed: for a sample of queries the true neighbours are found
by brute force against all rows, and the ratio is taken with which the lists
that are read hold at least ``RECALL`` of them. The recall that is reported is
that of the results of as many other queries, which the ratio wasn't chosen by.

Bounds: ``SAMPLE`` vectors and ``CENTROIDS`` centroids on the driver and in
each task, ``AUDIT`` queries in either half of the measurement. All rows are indexed. Lists
longer than ``CHUNK`` rows are read in chunks by several tasks. Of identical
vectors only the ``k + 1`` smallest ids are posted: no more can be in a result.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows with null ids, neither ask nor answer. Vectors of a
length other than the commonest are left out in the same way. Rows that share
an id are one candidate, the nearest of them; as a query, the vector that is
smallest, component by component, asks. Ties go to smaller ids. With
fewer than k candidates, all are returned. With a single query it serves for
both halves of the measurement; the recall is null without any true neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import read
from fieldloom.llm.vectors import by_groups, lists, matrix, usable
from fieldloom.plans.storage import saved

SAMPLE, CENTROIDS, LIST = 32768, 8192, 96
REPLICATE, REPLICAS = 1.02, 3
RECALL, AUDIT = 0.97, 192
CHUNK = 4096
#: Rows that one task compares with its queries, on average.
TASK = 16384
DEGREE, BEAM = 16, 24
#: Vectors that go through the graph in step, and queries that one task asks for.
ROWS, ASKING = 512, 2048


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def centroids_of(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """About ``k`` centroids; a cluster is split in up to 16 until it has at most its share of the sample."""
    rng = np.random.default_rng(seed)
    most = max(1, int(np.ceil(1.5 * len(x) / max(k, 1))))
    todo, out = [x], []
    while todo:
        c = todo.pop()
        if len(c) <= most:
            out.append(c.mean(0))
            continue
        parts = int(min(16, max(2, round(len(c) / most))))
        centers = c[rng.choice(len(c), parts, replace=False)]
        for _ in range(6):
            a = _nearest(c, centers)
            centers = np.stack([c[a == i].mean(0) if (a == i).any() else c[rng.integers(len(c))] for i in range(parts)])
        a = _nearest(c, centers)
        if np.bincount(a, minlength=parts).max() > 0.9 * len(c):  # hardly any two differ: cut anyhow
            a = np.arange(len(c)) % parts
        todo += [c[a == i] for i in range(parts) if (a == i).any()]
    return np.stack(out)


class Graph:
    """Centroids, each linked with its nearest ones and a few at random, in both directions."""

    def __init__(self, c: np.ndarray, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.c, self.sq = c, (c * c).sum(1)
        n = len(c)
        deg = min(DEGREE, n - 1)
        near = np.zeros((n, deg), np.int64)
        for lo in range(0, n, 1024):
            d = self.sq[None, :] - 2 * c[lo : lo + 1024] @ c.T
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
            near[lo : lo + 1024] = np.argpartition(d, deg - 1, axis=1)[:, :deg] if deg else near[lo : lo + 1024]
        links = [set(near[i].tolist()) | set(rng.integers(0, n, 4).tolist()) for i in range(n)]
        back: list[list[int]] = [[] for _ in range(n)]
        for i, s in enumerate(links):
            for j in s:
                if len(back[j]) < DEGREE:
                    back[j].append(i)
        width = max(len(s | set(b)) for s, b in zip(links, back, strict=True))
        self.links = np.empty((n, width), np.int64)
        for i in range(n):
            s = sorted(links[i] | set(back[i]))
            self.links[i] = s + [s[0]] * (width - len(s))
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def beam(self, x: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids that a best-first search finds, and squared distances; all rows go in step."""
        n, rows = len(self.c), np.arange(len(x))
        norm = (x * x).sum(1)
        dist = lambda ids: norm[:, None] + self.sq[ids] - 2 * np.einsum("bd,bkd->bk", x, self.c[ids])
        ids = np.repeat(self.entries[None, :], len(x), axis=0)
        d = dist(ids)
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        width = min(width, n)
        done = np.zeros(ids.shape, bool)
        for _ in range(4 * width):
            if ids.shape[1] > width:
                o = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids, d, done = (np.take_along_axis(y, o, 1) for y in (ids, d, done))
            best = np.where(done, np.inf, d).argmin(1)
            if done[rows, best].all():
                break
            done[rows, best] = True
            new = self.links[ids[rows, best]]
            old = seen[rows[:, None], new]
            first = np.ones(new.shape, bool)  # padding repeats a link
            first[:, 1:] = new[:, 1:] != new[:, :1]
            nd = np.where(old | ~first, np.inf, dist(new))
            seen[rows[:, None], new] = True
            ids, d, done = np.concatenate([ids, new], 1), np.concatenate([d, nd], 1), np.concatenate([done, np.isinf(nd)], 1)
        o = np.argsort(d, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, o, 1), np.maximum(np.take_along_axis(d, o, 1), 0)

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each row the centroids within ``ratio`` of the nearest's distance, spreading over the graph from the nearest; then the next nearest until they hold ``least`` rows."""
        for lo in range(0, len(x), ROWS):
            yield from self._within(x[lo : lo + ROWS], ratio, sizes, least)

    def _within(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
        near, d2 = self.beam(x)
        for i in range(len(x)):
            v = x[i]
            most = d2[i, 0] * ratio * ratio + 1e-12
            seen = np.zeros(len(self.c), bool)
            seen[near[i]] = True
            inside = near[i][d2[i] <= most]
            found, edge = [inside], near[i]
            while len(edge):
                new = np.unique(self.links[edge])
                new = new[~seen[new]]
                seen[new] = True
                d = (v @ v) + self.sq[new] - 2 * self.c[new] @ v
                edge = new[d <= most]
                found.append(edge)
            out = np.concatenate(found)
            if sizes[out].sum() < least:
                order = np.argsort(self.sq - 2 * self.c @ v, kind="stable")
                out = np.union1d(out, order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1])
            yield out


def _posted(graph: Graph, x: np.ndarray) -> list[np.ndarray]:
    """The lists of each row: the nearest, and others almost as near."""
    out = []
    for lo in range(0, len(x), ROWS):
        ids, d2 = graph.beam(x[lo : lo + ROWS])
        ok = d2 <= d2[:, :1] * REPLICATE**2 + 1e-12
        ok[:, REPLICAS:] = False
        ok[:, 0] = True
        out += [ids[i][ok[i]] for i in range(len(ids))]
    return out


def _top(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of one row of distances, ties to smaller ids."""
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))[:k]]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, from differences, so that near-identical vectors lose no digits."""
    out = np.empty((len(q), len(x)))
    step = max(1, 4_000_000 // max(1, x.size))
    for lo in range(0, len(q), step):
        diff = q[lo : lo + step, None, :] - x[None, :, :]
        out[lo : lo + step] = np.sqrt(np.einsum("qxd,qxd->qx", diff, diff))
    return out


def _scan(q_ids: np.ndarray, q: np.ndarray, k: int):
    """Brute force: each task's k nearest of its rows to each of few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b["id"].to_numpy(), matrix(b["v"])
            for lo in range(0, len(ids), 2048):
                part, d = ids[lo : lo + 2048], _distances(q, x[lo : lo + 2048])
                d[q_ids[:, None] == part[None, :]] = np.inf
                for i in range(len(q)):
                    t = _top(d[i], part, k)
                    t = t[np.isfinite(d[i][t])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), q_ids[i])), pa.array(part[t]), pa.array(d[i][t]), lists(x[lo + t])], names=["q", "id", "d", "v"])

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score, measured_recall, ratio)``: the k nearest found for each query row."""
    spark = rows.sparkSession
    base = usable(rows.select(id_col, vec_col), id_col, vec_col)
    dims = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    base = saved(base.where(F.size("v") == (dims["n"] if dims else 0)), "base")
    n = base.count()
    queries = base.withColumnRenamed("id", id_col).where(is_query).groupBy(F.col(id_col).alias("id")).agg(F.min("v").alias("v"))
    schema = "query_id long, rank int, vec_id long, score double, measured_recall double, ratio double"
    if not n:
        return spark.createDataFrame([], schema)
    same = Window.partitionBy("v").orderBy("id")
    posted = base.withColumn("no", F.row_number().over(same)).where(F.col("no") <= k + 1).select("id", "v")

    sample = matrix(pa.array(base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"]))
    graph = Graph(centroids_of(sample, min(CENTROIDS, max(1, n // LIST))))
    sent = spark.sparkContext.broadcast(graph)

    audit = queries.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(2 * AUDIT).toPandas()
    ratio, unseen = 1.0, None
    if len(audit):
        a_ids, a = audit["id"].to_numpy(), matrix(pa.array(audit["v"]))
        best = base.mapInArrow(_scan(a_ids, a, k), "q long, id long, d double, v array<double>").groupBy("q", "id").agg(F.min(F.struct("d", "v")).alias("m")).select("q", "id", "m.*")
        true = best.withColumn("no", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("no") <= k).toPandas()  # 2 * AUDIT * k rows
        half = a_ids[: (len(a_ids) + 1) // 2]
        unseen = true[~true["q"].isin(half)] if len(half) < len(a_ids) else true
        true = true[true["q"].isin(half)]
        if len(true):
            at = dict(zip(a_ids.tolist(), range(len(a_ids)), strict=True))
            qi = np.array([at[x] for x in true["q"]])
            far = np.sqrt(np.maximum((a * a).sum(1)[:, None] + graph.sq[None, :] - 2 * a @ graph.c.T, 0))
            least = np.sqrt(graph.beam(a)[1][:, 0]) + 1e-9
            need = np.array([far[i, ls].min() / least[i] for i, ls in zip(qi, _posted(graph, matrix(pa.array(true["v"]))), strict=True)])
            ratio = max(1.0, float(np.quantile(need, recall, method="higher"))) * (1 + 1e-9)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"])
            which = _posted(sent.value, x)
            i = np.repeat(np.arange(len(x)), [len(w) for w in which])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which).astype(np.int32)) if len(i) else pa.array([], pa.int32()), b["id"].take(pa.array(i)), b["v"].take(pa.array(i))], names=["list", "id", "v"])

    postings = saved(posted.mapInArrow(post, "list int, id long, v array<double>"), "postings")
    sizes = postings.groupBy("list").count().toPandas()  # at most CENTROIDS rows
    held = np.zeros(len(graph.c), np.int64)
    held[sizes["list"].to_numpy()] = sizes["count"].to_numpy()
    parts = np.ones(len(graph.c), np.int64)
    parts[sizes["list"].to_numpy()] = -(-sizes["count"].to_numpy() // CHUNK)
    tasks = max(8, int(-(-sizes["count"].sum() // TASK)))
    first = np.concatenate([[0], np.cumsum(parts)])
    cut = spark.sparkContext.broadcast((parts, first, held))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, _ = cut.value
        for b in batches:
            ls, ids = b["list"].to_numpy(), b["id"].to_numpy()
            piece = first[ls] + ids % parts[ls]
            yield pa.RecordBatch.from_arrays([pa.array((piece % tasks).astype(np.int32)), pa.array(np.zeros(len(ls), np.int32)), pa.array(piece), b["id"], b["v"], pa.nulls(len(ls), pa.list_(pa.int64()))], names=["task", "kind", "piece", "id", "v", "pieces"])

    def ask(least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, first, held = cut.value
            for b in batches:
                x = matrix(b["v"])
                row, task, pieces = [], [], []
                for i, ls in enumerate(sent.value.within(x, ratio, held, least)):
                    p = np.concatenate([np.arange(first[j], first[j + 1]) for j in ls])
                    for t in np.unique(p % tasks):
                        row.append(i)
                        task.append(t)
                        pieces.append(p[p % tasks == t])
                i = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(np.ones(len(row), np.int32)), pa.nulls(len(row), pa.int64()).fill_null(-1), b["id"].take(i), b["v"].take(i), pa.array(pieces, pa.list_(pa.int64()))], names=["task", "kind", "piece", "id", "v", "pieces"])

        return run

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, ids, v = t["kind"].to_numpy(), t["id"].to_numpy(), matrix(t["v"])
        held, asking = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(held) or not len(asking):
            return
        piece = t["piece"].to_numpy()[held]
        order = np.argsort(piece, kind="stable")
        held, piece = held[order], piece[order]
        wanted: dict[int, list[int]] = {}
        for i in asking:
            for p in t["pieces"][int(i)].as_py():
                wanted.setdefault(p, []).append(int(i))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p, qs in wanted.items():
            lo, hi = np.searchsorted(piece, [p, p + 1])
            rows_, q = held[lo:hi], np.array(qs)
            if not len(rows_):
                continue
            d = _distances(v[q], v[rows_])
            d[ids[q][:, None] == ids[rows_][None, :]] = np.inf
            for j, i in enumerate(qs):
                near = _top(d[j], ids[rows_], k)
                near = near[np.isfinite(d[j][near])]
                a, b = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                a, b = np.concatenate([a, d[j][near]]), np.concatenate([b, ids[rows_][near]])
                o = np.lexsort((a, b))
                o = o[np.concatenate([[True], b[o][1:] != b[o][:-1]])] if len(o) else o  # a replica stands in several lists
                o = o[np.lexsort((b[o], a[o]))][:k]
                best[i] = (a[o], b[o])
        for i, (d, b) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[i])), pa.array(b), pa.array(d)], names=["query_id", "vec_id", "score"])

    kinds = "task int, kind int, piece long, id long, v array<double>, pieces array<long>"

    def answered(asking: DataFrame, least: int) -> DataFrame:
        dealt = postings.mapInArrow(deal, kinds).unionByName(asking.repartition(askers, "id").mapInArrow(ask(least), kinds))
        dealt = dealt.repartition(tasks, "task").sortWithinPartitions("task", "kind")
        out = dealt.mapInArrow(by_groups(("task",), compare), "query_id long, vec_id long, score double")
        return saved(out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "hits")

    askers = max(8, -(-queries.count() // ASKING))
    least, every = REPLICAS * (k + 1), int(held.sum())  # a row stands in at most REPLICAS lists, and a query may be one itself
    hits = answered(queries, least)
    while least < every:
        # rows that share an id are one candidate: queries still short of k read more, in the end all lists
        full = hits.groupBy("query_id").count().where(F.col("count") >= k)
        short = saved(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short")
        if not short.limit(1).count():
            break
        least = min(every, least * 16)
        hits = hits.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(answered(short, least))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = None
    if unseen is not None and len(unseen):
        # a neighbour as near as the true one is as good
        worst = spark.createDataFrame(unseen.groupby("q", as_index=False).agg(n=("id", "size"), worst=("d", "max")), "query_id long, n long, worst double")
        got = out.join(F.broadcast(worst), "query_id").where(F.col("score") <= F.col("worst") * (1 + 1e-12))  # AUDIT rows
        found = got.count() / len(unseen)
    return out.select("query_id", "rank", "vec_id", "score", F.lit(found).cast("double").alias("measured_recall"), F.lit(ratio).alias("ratio"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings to those whose id is divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
