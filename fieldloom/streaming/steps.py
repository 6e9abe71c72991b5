"""Worlds in time: perturbations, steps, and a stream of perturbation events."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.compare import Intervention
from fieldloom.plans.execute import RunError, World, advance
from fieldloom.plans.ir import Program
from fieldloom.plans.storage import release, saved

EVENTS = "event_id long, kind string, field string, center_cell long, radius_hops int, amount double"


def regions(events: DataFrame, edges: DataFrame) -> DataFrame:
    """``(event_id, cell_id)``: the cells within each event's hops of its centre; all events spread at once."""
    near = events.select("event_id", F.col("center_cell").alias("cell_id"), F.col("radius_hops").alias("left"))
    most = events.agg(F.max("radius_hops")).first()[0] or 0
    for _ in range(most):
        out = near.where("left > 0").join(edges.select(F.col("src").alias("cell_id"), "dst"), "cell_id").select("event_id", F.col("dst").alias("cell_id"), (F.col("left") - 1).alias("left"))
        near = saved(near.unionByName(out).groupBy("event_id", "cell_id").agg(F.max("left").alias("left")), "region")
    return near.select("event_id", "cell_id")


def perturb(world: World, events: DataFrame) -> World:
    """Events applied to state fields in order of their id: ``field_scale`` times, ``field_add`` plus ``amount``."""
    strange = events.where(F.col("field").isNull() | ~F.col("field").isin([c for c in world.fields.columns if c != "cell_id"])).select("field").first()
    if strange is not None:
        raise RunError("UnknownState", str(strange["field"]))
    known = [r["field"] for r in events.select("field").distinct().collect()]  # no more than the world has fields
    if events.where(~F.col("kind").isin("field_scale", "field_add")).limit(1).count():
        raise RunError("Perturbation", "kinds are field_scale and field_add")
    hit = events.join(regions(events, world.mesh.edges), "event_id")
    # a cell's events of one field compose to a factor and an offset, in order
    steps = F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("kind") == "field_scale", F.col("amount")).otherwise(1.0).alias("m"), F.when(F.col("kind") == "field_add", F.col("amount")).otherwise(0.0).alias("p"))))
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("p"))
    both = F.aggregate("steps", start, lambda a, e: F.struct((a["m"] * e["m"]).alias("m"), (a["p"] * e["m"] + e["p"]).alias("p")))
    per = hit.groupBy("cell_id", "field").agg(steps.alias("steps")).select("cell_id", "field", both.alias("t"))
    fields = world.fields
    for f in sorted(known):
        own = per.where(F.col("field") == f).select("cell_id", F.col("t").alias("__t"))
        fields = fields.join(own, "cell_id", "left").withColumn(f, F.when(F.col("__t").isNotNull(), F.col(f"`{f}`") * F.col("__t.m") + F.col("__t.p")).otherwise(F.col(f"`{f}`"))).drop("__t")
    return replace(world, fields=saved(fields, "perturbed"))


def events_of(spark: SparkSession, items: list[Intervention]) -> DataFrame:
    return spark.createDataFrame([(i, x.kind, x.field, x.center_cell, x.radius_hops, x.amount) for i, x in enumerate(items)], EVENTS)


def run_steps(program: Program, world: World, steps: int, inputs: Mapping | None = None) -> World:
    """``steps`` times the program's updates; each step's state is written."""
    for _ in range(steps):
        world = advance(program, world, inputs)
    return world


class Worlds:
    """Worlds of a stream's epochs in a shared folder; the two latest are kept.

    An epoch's tables count once its mark is there, which is written last.
    """

    def __init__(self, start: World, folder: str) -> None:
        self.start, self.folder, self.spark = start, folder, start.fields.sparkSession
        self.path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n) for n in names if n.isdigit() and self.files.exists(self.path(f"{self.folder}/{n}/mark/_SUCCESS")))

    def before(self, epoch: int | None) -> World:
        """The latest marked world of an earlier epoch (of any, if None), or the one to start from."""
        done = [e for e in self.epochs() if epoch is None or e < epoch]
        return self.read(done[-1]) if done else self.start

    def read(self, epoch: int) -> World:
        at = f"{self.folder}/{epoch}"
        mark = self.spark.read.schema("step int, networks array<string>").json(f"{at}/mark").first()
        networks = {n: self.spark.read.parquet(f"{at}/network-{i}") for i, n in enumerate(mark["networks"])}
        return replace(self.start, fields=self.spark.read.parquet(f"{at}/fields"), networks=networks, step=mark["step"])

    def keep(self, world: World, epoch: int) -> World:
        at = f"{self.folder}/{epoch}"
        self.files.delete(self.path(at), True)
        world.fields.write.parquet(f"{at}/fields")
        names = sorted(world.networks)
        for i, n in enumerate(names):
            world.networks[n].write.parquet(f"{at}/network-{i}")
        self.spark.createDataFrame([(world.step, names)], "step int, networks array<string>").coalesce(1).write.json(f"{at}/mark")
        for old in self.epochs()[:-2]:
            self.files.delete(self.path(f"{self.folder}/{old}"), True)
        release(world.fields)
        return self.read(epoch)


def follow(events: DataFrame, program: Program, world: World, checkpoint: str, inputs: Mapping | None = None, on_world=None):
    """A streaming query: each micro-batch of events is applied, then one step is run.

    ``events`` is a streaming frame of ``EVENTS``. The latest world is in the
    dictionary that is returned with the query, under ``world``. Each world is
    written below ``checkpoint`` under its epoch, its mark last; a start reads
    the latest marked one, and a batch that comes again after a crash starts
    from the world before it, so that no event is applied twice. ``world`` then
    gives only mesh, parameters and seed.
    """
    past = Worlds(world, f"{checkpoint.rstrip('/')}/worlds")
    held = {"world": past.before(None)}

    def batch(df: DataFrame, epoch: int) -> None:
        rows = saved(df, "events")
        if rows.limit(1).count():
            new = advance(program, perturb(past.before(epoch), rows), inputs)
            held["world"] = past.keep(new, epoch)
            if on_world is not None:
                on_world(held["world"], epoch)
        release(rows)

    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    return query, held
