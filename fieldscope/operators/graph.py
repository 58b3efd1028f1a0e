"""Reachability over reference graphs and load closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.functions.text import source_attribution
from fieldscope.plans import top_per_key
from fieldscope.session import fresh_dir, pin


class _Levels:
    """Result of a walk in steps: one folder per step, readable as one table with the step's number as ``column``."""

    def __init__(self, spark: SparkSession, label: str, column: str = "depth"):
        self.spark = spark
        self.column = column
        self.path = fresh_dir(spark, label)
        self.schema = None

    def add(self, df: DataFrame, number: int) -> DataFrame | None:
        """Write a step, which ends its lineage; None if it has no rows."""
        folder = f"{self.path}/{self.column}={number}"
        df.write.parquet(folder)
        self.schema = df.schema
        level = self.spark.read.schema(df.schema).parquet(folder)
        return None if level.isEmpty() else level

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path).withColumn(
            self.column, F.col(self.column).cast("int")
        )


def chain_hops(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, to, w, last) of every node inside a chain: one way in, one way out, and no root.

    ``to`` is the first node along the chain that is not inside it, ``w`` edges away, ``last`` the node before, which names the
    chain. Pointers are doubled, so a chain of n nodes takes log2(n) rounds, and nodes that have arrived are
    not joined again. Nodes on closed rings, which no root can enter, are left out.
    """
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").drop("n")
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    inside = out.join(into, "id").join(roots.select("id"), "id", "left_anti")
    hops = pin(inside.select("id", "to", F.lit(1).cast("long").alias("w"), F.col("id").alias("last"), F.lit(True).alias("open")), "chain-hops")
    nodes = hops.count()
    reach = 1
    while reach <= nodes and not hops.where("open").isEmpty():
        onward = hops.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("last").alias("_last"))
        moved = hops.where("open").join(onward, "to", "left").select(
            "id", F.coalesce("_to", "to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.coalesce("_last", "last").alias("last"), F.col("_to").isNotNull().alias("open")
        )
        hops = pin(hops.where("not open").unionByName(moved), "chain-hops")
        reach *= 2
    return hops.where(F.col("w") <= nodes).drop("open")


def graph_reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from ``roots`` (column ``id``) over ``edges`` (``src``, ``dst``) with their least depth.

    ``max_depth`` stops the walk early; ``truncated`` then tells at each node of the last level whether an edge leads on
    to a node that was not reached. Edges with a null end lead nowhere.

    Chains are bridged first (``chain_hops``): the walk takes one hash join per branching on a path, not per node. A round
    hands on only the nodes that it reaches for the first time or by fewer edges than before. Then the nodes inside a
    chain get their depth from the node before it. Rounds are written to the shared folder.
    """
    links = pin(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    starts = pin(roots.select("id").distinct(), "roots")
    hops = chain_hops(links, starts)
    heads = links.join(hops.select(F.col("id").alias("src")), "src", "left_anti").join(hops.withColumnRenamed("id", "dst"), "dst", "left")
    bridges = pin(heads.select("src", F.coalesce("to", "dst").alias("dst"), (F.coalesce("w", F.lit(0)) + 1).alias("w"), "last"), "bridges")
    shortest = pin(bridges.groupBy("src", "dst").agg(F.min("w").alias("w")), "bridge-lengths")

    rounds = _Levels(edges.sparkSession, "reach", "round")
    at = F.lit(0).cast("long").alias("depth")
    frontier, number = rounds.add(starts.select("id", at), 0), 0
    while frontier is not None:
        number += 1
        step = shortest.join(frontier.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("w") + F.col("depth")).alias("depth"))
        if max_depth is not None:
            step = step.where(F.col("depth") <= max_depth)
        known = rounds.all().groupBy("id").agg(F.min("depth").alias("_depth"))
        better = step.join(known, "id", "left").where(F.col("_depth").isNull() | (F.col("depth") < F.col("_depth")))
        frontier = rounds.add(better.select("id", "depth"), number)
    walked = rounds.all().groupBy("id").agg(F.min("depth").alias("depth"))
    chains = bridges.where("last is not null").join(walked.withColumnRenamed("id", "src"), "src").select("last", (F.col("depth") + F.col("w")).alias("_end"))
    inside = hops.join(chains, "last").select("id", (F.col("_end") - F.col("w")).alias("depth"))
    if max_depth is not None:
        inside = inside.where(F.col("depth") <= max_depth)
    reached = pin(walked.unionByName(inside).withColumn("depth", F.col("depth").cast("int")), "reached")
    if max_depth is None:
        return reached.withColumn("truncated", F.lit(False))
    leaving = links.join(reached.filter(F.col("depth") == max_depth).select(F.col("id").alias("src")), "src")
    onward = leaving.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.lit(True).alias("truncated")).distinct()
    return reached.join(onward, "id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def bounded_reach(reached: DataFrame, max_objects: int) -> DataFrame:
    """The first objects by depth, with a flag when there were more."""
    total = reached.agg(F.count(F.lit(1)) > max_objects).scalar()
    return reached.orderBy("depth", "id").limit(max_objects).withColumn("truncated", total)


def owner_frames(objects: DataFrame, addon: str, reached: DataFrame) -> DataFrame:
    """Objects reached from the addon's roots, plus all whose source location names the addon."""
    owned = objects.filter(source_attribution(F.col("location"))["source"] == addon).select("object_id")
    marked = (
        reached.select(F.col("id").alias("object_id"), F.lit(1).alias("via_graph"), F.lit(0).alias("via_source"))
        .unionByName(owned.distinct().select("object_id", F.lit(0).alias("via_graph"), F.lit(1).alias("via_source")))
    )
    return marked.groupBy("object_id").agg(F.max("via_graph").alias("via_graph"), F.max("via_source").alias("via_source"))


def resolve_reference(base_dir: Column, reference: Column) -> Column:
    """Path of a reference relative to a folder below the root; null if it leaves the root."""
    parts = F.split(F.concat_ws("/", base_dir, F.replace(reference, F.lit("\\"), F.lit("/"))), "/")
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def walk(state, part):
        up = F.struct(
            F.slice(state["at"], F.lit(1), F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"),
            (state["out"] | (F.size(state["at"]) == 0)).alias("out"),
        )
        down = F.struct(F.concat(state["at"], F.array(part)).alias("at"), state["out"].alias("out"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(down)

    return F.aggregate(parts, start, walk, lambda s: F.when(~s["out"], F.array_join(s["at"], "/")))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def load_closure(entries: DataFrame, references: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files a manifest loads, following the references of its XML files breadth-first.

    ``entries`` (build, path), ``references`` (src, reference), ``files`` (path). Returns the
    loaded files (build, path, depth), each once, and the findings (build, finding, path,
    evidence) for references that are missing or leave the root.
    """
    links = pin(references.select(F.lower("src").alias("src"), folder_of(F.col("src")).alias("base"), "reference").distinct(), "links")
    present = pin(files.select("path", F.lower("path").alias("file")).groupBy("file").agg(F.min("path").alias("path")), "files")
    target = resolve_reference(F.col("base"), F.col("reference"))
    # References that leave the root are told apart by their own text.
    file = F.lower(F.coalesce("target", F.concat(F.lit("\0"), "reference")))
    status = F.when(F.col("target").isNull(), "load-path-escape").when(F.col("path").isNull(), "missing-load-file").otherwise("loaded")
    placed = F.coalesce("path", "target")

    levels = _Levels(entries.sparkSession, "closure")
    asked = entries.select("build", F.lit("").alias("base"), F.col("path").alias("reference"))
    depth, level = -1, entries
    while level is not None:  # every round finds files that no earlier one has, so there is a last one
        depth += 1
        fresh = asked.withColumn("target", target).groupBy("build", file.alias("file")).agg(
            F.min("target").alias("target"), F.min("reference").alias("evidence")
        )
        if depth:
            fresh = fresh.join(levels.all().select("build", "file"), ["build", "file"], "left_anti")
        level = levels.add(
            fresh.join(present, "file", "left").select("build", "file", "evidence", placed.alias("path"), status.alias("status")), depth
        )
        if level is None:
            break
        sources = level.filter((F.col("status") == "loaded") & F.col("file").endswith(".xml")).select("build", F.col("file").alias("src"))
        asked = links.join(sources, "src").select("build", "base", "reference").distinct()
    everything = levels.all()
    loaded = everything.filter("status = 'loaded'").select("build", "path", "depth")
    findings = everything.filter("status <> 'loaded'").select(
        "build", F.col("status").alias("finding"), F.coalesce("path", "evidence").alias("path"), "evidence"
    )
    return loaded, findings
