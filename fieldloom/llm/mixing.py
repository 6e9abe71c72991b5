"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the mix is the point frac(n / golden ratio), mapped through the
cumulative shares of the sources; the slots of one source are ranked, and
slot r of a source takes block r of that source's shuffled token stream.
All blocks hold ``block_tokens`` tokens, but for the last of a source, which
ends where the source's target does.

Weights and targets take one row per source through one task; sources must be
few enough for that, as their names are, millions at the most.

Defined cases: a null source is a source of its own, last in order. Null
texts and texts without words have size 0 and are never placed. Rows with
null or repeated ids are rows like any other. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import read, running_offset, words_of
from fieldloom.plans.storage import saved

WEIGHTS = (5, 2, 1)
RATIO = 1.5
MOST = 2.0
BLOCK_TOKENS = 512
#: Cells into which the unit interval is cut to find a point's source by an equality join.
CELLS = 4096
#: Slots that one task ranks at once.
CHUNK = 1 << 13
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share ``ratio`` times all tokens. A source gets ``most`` times its size at
    the most; the excess is shared again. With sources ordered by how much of
    a common level they can take per weight, the ones that are full are a
    prefix, so running sums give the level without iterating.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    per = per.withColumn("level", most * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", ratio * F.sum("source_size").over(every))
        .withColumn("at", (F.col("total") - F.col("full")) / F.col("left"))
        # the level is set by the first source that it doesn't fill
        .withColumn("water", F.min(F.when(F.col("at") <= F.col("level"), F.struct("level", "full", "at"))).over(every)["at"])
    )
    return per.select("source", "source_size", F.least(F.col("weight") * F.coalesce("water", "level"), most * F.col("source_size")).alias("target"))


def schedule(spark: SparkSession, quotas: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(slot, source, rank)`` from ``(source, quota)``: as many slots for a source as its quota has blocks."""
    q = quotas.withColumn("blocks", F.ceil(F.col("quota") / block_tokens).cast("long")).where("blocks > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    q = q.withColumn("hi", F.sum("blocks").over(order).cast("double") / F.sum("blocks").over(Window.partitionBy()))
    q = saved(q.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("no", F.row_number().over(order)), "quota")
    n = q.agg(F.sum("blocks")).first()[0] or 0
    cells = q.select("no", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int")))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    hits = points.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "no", "blocks").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = hits.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = hits.join(base, ["no", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.where("rank < blocks").select("slot", "no", "rank")
    # the points miss a source's share by a few slots at the most; what is missing comes at the end
    short = q.join(counts.groupBy("no").agg(F.sum("n").alias("got")), "no", "left").where(F.coalesce("got", F.lit(0)) < F.col("blocks"))
    short = short.select("no", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("blocks") - 1)).alias("rank"))
    short = short.select((F.lit(n) + F.row_number().over(Window.orderBy("rank", "no")) - 1).cast("long").alias("slot"), "no", "rank")
    return ranked.unionByName(short).join(q.select("no", "source"), "no").select("slot", "source", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, ratio: float = RATIO, most: float = MOST, block_tokens: int = BLOCK_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where the mix takes tokens of each document.

    Returns a row for each part of a document that falls into a block, and
    at least one for each document: ``doc_id, source, size, source_size,
    target, position`` (of the document in its source's stream), ``pass``,
    ``slot`` (null: not taken), ``start`` and ``stop`` (tokens of the document),
    and the columns of ``keep``.
    """
    spark = docs.sparkSession
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(text_col).alias("size"), *keep), "sizes")
    share = saved(targets(sizes, weights, ratio, most).withColumn("quota", F.least(F.round("target"), most * F.col("source_size")).cast("long")), "targets")
    placed = running_offset(sizes, ["source"], "size", ["doc_id", "size"], sizes.count(), "position")
    placed = placed.join(share.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    passes = F.array(*[F.lit(p) for p in range(max(1, -int(-most // 1)))])
    part = placed.withColumn("pass", F.explode(passes)).withColumn("at", F.col("position") + F.col("pass") * F.col("source_size"))
    part = part.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota")))
    blocks = F.when(F.col("end") > F.col("at"), F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("end") - 1) / block_tokens)))
    part = part.select("*", F.explode_outer(blocks).alias("block")).where("block IS NOT NULL OR pass = 0")
    part = part.withColumn("start", F.greatest(F.col("at"), F.col("block") * block_tokens) - F.col("at")).withColumn("stop", F.least(F.col("end"), (F.col("block") + 1) * block_tokens) - F.col("at"))
    slots = schedule(spark, share.select("source", "quota"), block_tokens).withColumnRenamed("source", "__s")
    hit = part.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("rank")), "left")
    return hit.select("doc_id", "source", "size", "source_size", "target", "position", "slot", "start", "stop", F.col("pass").cast("int").alias("pass"), *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents of the same columns: a row for each pass over a document, cut to the words that are taken.

    A document that the mix takes twice is there twice. A part of a document
    is its words with single spaces between them. ``n_chars`` is that of the
    text of the row.
    """
    hashed = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64("text").alias("__h"), F.col("text").alias("__text")]
    key = [F.coalesce(F.col("__id").cast("long"), F.lit(-(1 << 63))).alias("__k"), F.coalesce("__source", F.lit("\0")).alias("__s"), F.col("__h")]
    same = Window.partitionBy("__k", "__s", "__h")
    parts = mix(docs.select(*hashed), "__id", "__source", "__text", keep=("__h",), **options).where("slot IS NOT NULL")
    parts = parts.withColumnsRenamed({"doc_id": "__id", "source": "__source"})
    parts = parts.groupBy("__id", "__source", "__h", "size", "position", "pass").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    takes = F.collect_list(F.struct("pass", "size", "start", "stop")).alias("__takes")  # as many as there are passes
    parts = parts.groupBy("__id", "__source", "__h", "position").agg(takes)
    # rows that are equal in all may swap places
    parts = parts.select(*key, "position", "__takes").withColumn("__n", F.row_number().over(same.orderBy("position"))).drop("position")
    rows = docs.select("*", *hashed[:3]).select("*", *key[:2]).withColumn("__n", F.row_number().over(same.orderBy(F.lit(0))))
    rows = rows.join(parts, ["__k", "__s", "__h", "__n"]).withColumn("__take", F.explode("__takes"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    t = F.col("__take")
    part = F.array_join(F.slice(words, (t["start"] + 1).cast("int"), (t["stop"] - t["start"]).cast("int")), " ")
    text = F.when(t["stop"] - t["start"] == t["size"], F.col("text")).otherwise(part)
    out = rows.withColumn("__out", text)
    new = {"text": F.col("__out").alias("text"), "n_chars": F.length("__out").cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with what the mix takes of it."""
    rows = mix(read(spark, sf_dir, "documents"))
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("stop") - F.col("start")).otherwise(0))
    # the position keeps rows that share an id apart
    out = rows.groupBy("doc_id", "source", "size", "source_size", "target", "position").agg(taken.cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")
