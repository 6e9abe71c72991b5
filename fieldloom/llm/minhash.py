"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set of five-word shingles gets ``K`` minima. Each pair of
coordinate and value is a token under which documents are posted. Two
documents match if at least ``MATCH`` tokens agree (a pair at a similarity of
0.75 agrees in 48 of 64 on average and falls below 32 about once in 100,000), so:

* tokens of one document only link nothing, and documents with fewer than
  ``MATCH`` other tokens can match nothing; both are left out;
* prefix: with tokens from rare to frequent in one order for all, matching
  documents share one of their first ``K - MATCH + 1``. Tokens of passages
  that many documents share are frequent and thus hardly ever posted;
* skip: a list whose documents are already in one component is skipped, and so
  is each pair within a component.

Copies count as one: documents of equal sets form a class, and its smallest
id stands for it. First each posted document is tried against few leaders of
its lists, then against the documents of other components that it agrees with
best, which joins large groups without meeting all their pairs. At last each
document outside its list's main component asks for every component with a
match for it, and its set is held against those of all members, a block at a
time; one link for each asking document, component and block comes out of it.
A pair is linked by the exact similarity of the full sets only.

Defined cases: texts that are null or without words have empty sets and link
with nothing; fewer than five words are one shingle. Rows that share an id
are classed by their own texts each. A row with a null id links nothing, has
no component and isn't kept. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import keys as K
from fieldloom.llm.common import read
from fieldloom.llm.vectors import by_groups, matrix
from fieldloom.operators.components import connected_components
from fieldloom.plans.storage import release, saved

COORDINATES = 64
MATCH = 32
#: Further coordinates, of which a byte is kept; they are not posted but counted where documents meet. At a similarity
#: of 0.75, 96 of all 128 agree on average, and fewer than ``FINE_MATCH`` once in millions.
FINE, FINE_MATCH = 64, 72
PERCENT = 75
WORDS = 5
#: Rows of a list that meet in one task.
BLOCK = 1024
#: Sets of a component, and asking documents, that meet in one task.
HELD = 256
#: Partners that a document is tried against in a round, and rounds of leaders.
TRIES, ROUNDS = 2, 1

_MULTIPLY = np.random.default_rng(9).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(u: np.ndarray, k: int) -> np.ndarray:
    """For each coordinate the least 32-bit hash of the shingle keys ``u``."""
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint64)
    for lo in range(0, len(u), 2048):
        out = np.minimum(out, ((_MULTIPLY[:k, None] * u[None, lo : lo + 2048]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def digest(u: np.ndarray) -> tuple[int, int, int]:
    """128 bits that tell sets of shingle keys apart, and 64 of them mixed, the class's number."""
    d1 = u.sum(dtype=np.uint64)
    d2 = K.mix(u * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    doc = K.mix(np.array([d1 ^ (d2 << np.uint64(1)) ^ (d2 >> np.uint64(63))], dtype=np.uint64))[0]
    return int(d1.view(np.int64)), int(d2.view(np.int64)), int(doc.view(np.int64))


def _sign(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.columns[-1].to_pylist()
            for lo, hi in K.chunks(texts):
                keys, bounds = K.word_keys(texts[lo:hi])
                n, digests, sig = [], [], np.zeros((hi - lo, k + FINE // 4), dtype=np.uint32)
                for i, u in enumerate(K.shingles(keys, bounds, words)):
                    n.append(len(u))
                    digests.append(digest(u))
                    every = signature(u, k + FINE)
                    sig[i, :k], sig[i, k:] = every[:k], every[k:].astype(np.uint8).view(np.uint32)
                d1, d2, doc = (pa.array([d[j] for d in digests], pa.int64()) for j in range(3))
                flat = pa.array(sig.view(np.int32).ravel(), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * sig.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.columns[0].slice(lo, hi - lo), pa.array(n, pa.int64()), d1, d2, doc, lists], names=["doc_id", "n_shingles", "d1", "d2", "doc", "sig"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.columns[-1].to_pylist()
            for lo, hi in K.chunks(texts):
                keys, bounds = K.word_keys(texts[lo:hi])
                sets = list(K.shingles(keys, bounds, words))
                at = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([digest(u)[2] for u in sets], pa.int64()), lists], names=["doc", "items"])

    return run


def _across(match: int, k: int, percent: int, best: int):
    """Matches between components in one list; role 0: documents outside its main component, role 1: a block of all.

    With ``best``, that many of the best matches of each document of role 0;
    else which documents have a match in which component, the smaller
    component asking, at the first token of their prefixes that both share.
    Sets whose sizes differ too much to be similar don't match.
    """
    told: set[tuple[int, int]] = set()  # what this task has asked already, or the last of it

    def pairs(g: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda n: g[n].to_numpy()
        role, doc, comp, mask, weight = col("role"), col("doc"), col("comp"), col("mask").view(np.uint64), col("weight")
        sig = matrix(g["sig"])
        at = int(g["token"][0].as_py()) >> 32
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(a) or not len(b):
            return
        count = np.zeros((len(a), len(b)), dtype=np.uint8)
        earlier = np.zeros((len(a), len(b)), dtype=bool)
        for c in range(k):
            same = sig[a, c][:, None] == sig[b, c][None, :]
            count += same
            if c < at and not best:
                bit = np.uint64(1) << np.uint64(c)
                earlier |= same & ((mask[a] & bit) != 0)[:, None] & ((mask[b] & bit) != 0)[None, :]
        fine = np.ascontiguousarray(sig[:, k:]).view(np.uint8)
        both = count.copy()
        for c in range(FINE):
            both += fine[a, c][:, None] == fine[b, c][None, :]
        n = col("n")
        fits = 100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :])
        good = (count >= match) & (both >= FINE_MATCH) & ~earlier & fits & (comp[a][:, None] != comp[b][None, :])
        if best:
            score = np.where(good, count.astype(np.int64), -1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :best]
            i, j = np.nonzero(np.take_along_axis(score, top, 1) >= 0)
            if len(i):
                j = top[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(doc[a][i]), pa.array(doc[b][j]), pa.array(score[i, j])], names=["a", "b", "n"])
            return
        i, j = np.nonzero(good)
        if len(i):
            x, y = a[i], b[j]
            less = (weight[x] < weight[y]) | (weight[x] == weight[y]) & (comp[x] < comp[y])
            asks = np.unique(np.stack([np.where(less, doc[x], doc[y]), np.where(less, comp[y], comp[x])]), axis=1)
            new = [i for i, t in enumerate(zip(*asks.tolist(), strict=True)) if t not in told]
            if len(told) > 1_000_000:
                told.clear()
            asks = asks[:, new]
            told.update(zip(*asks.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(asks[0]), pa.array(asks[1]), pa.array(np.zeros(asks.shape[1], np.int64))], names=["a", "b", "n"])

    return by_groups(("token", "strays", "block"), pairs)


def _held_against(percent: int):
    """Exact links of asking documents (role 0) with a block of a component's members (role 1), one for each."""

    def links(g: pa.Table) -> Iterator[pa.RecordBatch]:
        role, doc = g["role"].to_numpy(), g["doc"].to_numpy()
        items = g["items"].combine_chunks()
        at = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
        flat = items.flatten().to_numpy()
        members = np.flatnonzero(role == 1)
        if not len(members):
            return
        block = np.concatenate([flat[at[m] : at[m + 1]] for m in members])
        size = (at[1:] - at[:-1])[members]
        start = np.cumsum(size) - size
        a, b = [], []
        for i in np.flatnonzero(role == 0):
            own = np.sort(flat[at[i] : at[i + 1]])
            place = np.minimum(np.searchsorted(own, block), len(own) - 1)
            both = np.add.reduceat((own[place] == block).astype(np.int64), start)
            hit = np.flatnonzero((100 * both >= percent * (len(own) + size - both)) & (doc[members] != doc[i]))
            if len(hit):
                a.append(doc[i])
                b.append(doc[members[hit[0]]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return by_groups(("comp", "asked", "block"), links)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``(a, b)`` whose sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    j = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return j.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, k: int = COORDINATES, match: int = MATCH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row; linked are sets with 100 * intersection >= percent * union."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    signs = saved(plain.mapInArrow(_sign(words, k), "doc_id long, n_shingles long, d1 long, d2 long, doc long, sig array<int>"), "signs")
    some = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(some.groupBy("d1", "d2", "doc", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.min_by("sig", "doc_id").alias("sig")), "classes")

    posted = classes.select("doc", F.posexplode(F.slice("sig", 1, k)).alias("c", "v")).select("doc", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    per_doc = posted.join(shared, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("ts")).where(F.size("ts") >= match)
    prefix = per_doc.select("doc", F.transform(F.slice(F.col("ts"), F.lit(1), F.size("ts") - (match - 1)), lambda t: t["token"]).alias("prefix"))
    prefix = saved(prefix, "prefix")
    # a short last token list is no cut: a document's first K - MATCH + 1 tokens include those of its own, which are rarest
    posts = saved(prefix.select("doc", F.explode("prefix").alias("token")), "posts")
    lists = posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    posts2 = posts.join(lists.select("token"), "token")

    ids = prefix.join(classes, "doc").select(F.col("first_id").alias("doc_id"))
    texts = plain.join(ids, "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "doc long, items array<long>")
    # rows that share an id with one that is posted may have other texts
    sets = saved(sets.groupBy("doc").agg(F.first("items").alias("items")), "sets")

    links = saved(docs.sparkSession.createDataFrame([], "a long, b long"), "links")
    comps: DataFrame | None = None
    for r in range(ROUNDS):
        order = F.struct(F.xxhash64("doc", F.pmod("token", F.lit(4)), F.lit(r)), "doc")
        if comps is None:
            lead = posts2.groupBy("token").agg(F.min(order)["doc"].alias("lead"))
            tries = posts2.join(lead, "token").where("lead <> doc")
        else:
            p, top = _mixed(posts2, comps)
            lead = p.join(top, ["token", "comp"]).groupBy("token").agg(F.min(order)["doc"].alias("lead"))
            tries = p.join(top.withColumnRenamed("comp", "main"), "token").where("comp <> main").join(lead, "token")
        tries = tries.groupBy("doc", "lead").agg(F.count("*").alias("n"))
        best = tries.withColumn("no", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "lead"))).where(F.col("no") <= TRIES)
        links, comps = _joined(links, _verified(best.select(F.col("doc").alias("a"), F.col("lead").alias("b")), sets, percent), comps)

    # a quarter of the lists is enough to find likely partners; the last pass reads all
    near = _met(posts2.where(F.pmod(F.xxhash64("token"), F.lit(4)) == 0), comps, prefix, classes).mapInArrow(_across(match, k, percent, TRIES), "a long, b long, n long")
    near = near.groupBy("a", "b").agg(F.max("n").alias("n"))
    near = near.withColumn("no", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("no") <= TRIES)
    links, comps = _joined(links, _verified(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), comps)

    asks = _met(posts2, comps, prefix, classes).mapInArrow(_across(match, k, percent, 0), "a long, b long, n long")
    asks = saved(asks.select(F.col("a").alias("doc"), F.col("b").alias("comp")).distinct(), "asks")
    member = prefix.select("doc").join(comps, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("comp"))
    asked = asks.groupBy("comp").agg(F.count("*").alias("asking"))
    member = member.join(asked, "comp")
    size = member.groupBy("comp", "asking").agg(F.count("*").alias("m"))
    parts = lambda n: F.ceil(F.col(n) / HELD).cast("int")
    slot = lambda n: F.pmod(F.xxhash64("doc", "comp"), parts(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    asking = asks.join(size, "comp").select("comp", F.lit(0).alias("role"), "doc", slot("asking").alias("asked"), spread("m").alias("block"))
    members = member.join(size.select("comp", "m"), "comp").select("comp", F.lit(1).alias("role"), "doc", spread("asking").alias("asked"), slot("m").alias("block"))
    held = asking.unionByName(members).join(sets, "doc").repartition("comp", "asked", "block").sortWithinPartitions("comp", "asked", "block")
    links, comps = _joined(links, held.mapInArrow(_held_against(percent), "a long, b long"), comps)

    linked = classes.select("doc", "first_id").join(comps, F.col("doc") == F.col("node")).select("doc", "first_id", "component")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least"))
    least = linked.join(least, "component").select("doc", "least")
    out = signs.select("doc_id", "n_shingles", "d1", "d2", "doc").join(classes.drop("sig", "n_shingles"), ["d1", "d2", "doc"], "left").join(least, "doc", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "first_id", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(False)).alias("kept"))


def _met(posts: DataFrame, comps: DataFrame, prefix: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists with several components, in blocks: their documents outside the main component, and all."""
    p, top = _mixed(posts, comps)
    weight = comps.groupBy("component").agg(F.count("*").alias("weight"))
    full = p.join(prefix, "doc").join(classes.select("doc", F.col("n_shingles").alias("n"), "sig"), "doc").join(top.withColumnRenamed("comp", "main"), "token")
    full = full.join(weight, F.col("comp") == F.col("component"), "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    bit = F.aggregate("prefix", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 32).cast("int"))))
    full = full.select("token", "doc", "comp", "weight", "n", bit.alias("mask"), "sig", (F.col("comp") != F.col("main")).alias("stray"))
    sizes = p.join(top.withColumnRenamed("comp", "main"), "token").groupBy("token").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("main")).alias("s"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    full = full.join(sizes, "token").withColumn("h", F.xxhash64("doc", "token"))
    mine = lambda n: F.pmod("h", blocks(n)).cast("int")
    cols = ["doc", "comp", "weight", "n", "mask", "sig"]
    strays = full.where("stray").select("token", F.lit(0).alias("role"), *cols, mine("s").alias("strays"), F.explode(F.sequence(F.lit(0), blocks("m") - 1)).alias("block"))
    every = full.select("token", F.lit(1).alias("role"), *cols, F.explode(F.sequence(F.lit(0), blocks("s") - 1)).alias("strays"), mine("m").alias("block"))
    return strays.unionByName(every).repartition("token", "strays", "block").sortWithinPartitions("token", "strays", "block")


def _mixed(posts: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts with their components of lists with several, and each such list's component of the most documents."""
    p = posts.join(comps, posts["doc"] == comps["node"], "left").select("token", "doc", F.coalesce("component", "doc").alias("comp"))
    per = p.groupBy("token", "comp").agg(F.count("*").alias("n"))
    top = per.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("comp"), F.count("*").alias("comps")).where("comps > 1").select("token", "comp")
    top = saved(top, "mixed")
    return p.join(top.select("token"), "token"), top


def _joined(links: DataFrame, more: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    every = saved(links.unionByName(more), "links")
    release(links)
    return every, saved(connected_components(every, "a", "b"), "comps")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


#: The same by brute force: rows of equal sets are classes, classes meet by each shingle, and all that is reached is listed.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS items FROM words
), classes AS MATERIALIZED (
  SELECT items, row_number() OVER () AS class, min(doc_id) AS first_id FROM sets WHERE len(items) > 0 AND doc_id IS NOT NULL GROUP BY items
), posts AS MATERIALIZED (
  SELECT class, len(items) AS n, unnest(items) AS item FROM classes
), links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM posts a JOIN posts b ON a.item = b.item AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT class AS a, class AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT r.a AS class, min(c.first_id) AS root FROM reach r JOIN classes c ON r.b = c.class GROUP BY r.a
)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, coalesce(coalesce(r.root, s.doc_id) = s.doc_id, false) AS kept
FROM sets s LEFT JOIN classes c ON s.items = c.items AND s.doc_id IS NOT NULL LEFT JOIN roots r ON c.class = r.class
"""
