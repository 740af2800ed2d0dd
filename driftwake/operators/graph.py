"""Graphs in edge tables (G1, G2, G4, G7-G10). Loops are driven from here, but every hop is a join and an aggregation;
lineage is cut in the shared checkpoint folder, and only counts come to the driver."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from driftwake.operators import circles
from driftwake.values import MAX_HOPS, THRESHOLD

#: Edges that a task holds at once; so many or fewer are one task's.
HELD = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset one is made, but only if driver and
    executors are one process; on a cluster a folder of the driver's would lose what executors write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def over_cores(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer: a small table may be one file of one row group, and
    work on its texts would then be one task's. Large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder, so that lineage ends and lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_in_loop(df: DataFrame) -> DataFrame:
    """cut, for loops. A cut table passes on the optimizer's guess of its size, which each join squares; after some dozen
    rounds that number alone has more digits than can be worked with. Here the guess is forgotten."""
    spark, done = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def propagate(edges: DataFrame, seeds: DataFrame, changed: DataFrame | None = None, threshold: float = THRESHOLD, hops: int = MAX_HOPS) -> DataFrame:
    """G1. node, hops, score: the best product of step weights along any chain of at most `hops` edges against their
    direction, from a seed's score. edges(src, dst, weight); seeds(node, score). Changed nodes (the seeds, if not given)
    are neither listed nor walked through; chains end below the threshold. Of equal scores the fewest hops count.

    A hop keeps one row a node, the best; as weights only multiply, a worse row at the same hop can never win later.
    """
    changed = (changed if changed is not None else seeds).select("node").distinct()
    front = seeds.groupBy("node").agg(F.max("score").alias("score"))
    steps = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), "weight")
    found = None
    for hop in range(1, hops + 1):
        reached = front.join(steps, "node").select(F.col("next").alias("node"), (F.col("score") * F.col("weight")).alias("score"))
        front = reached.filter(F.col("score") >= threshold).groupBy("node").agg(F.max("score").alias("score")).join(changed, "node", "left_anti")
        if hop % 3 == 0:
            front = cut(front)
            if not front.head(1):
                break
        part = front.withColumn("hops", F.lit(hop))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = front.withColumn("hops", F.lit(1))
    best = found.groupBy("node").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"))).alias("b"))
    return best.select("node", (-F.col("b.h")).alias("hops"), F.col("b.score").alias("score"))


def reach(edges: DataFrame, start: DataFrame, hops: int | None = None, backward: bool = False) -> DataFrame:
    """G2/G7/G8/G9. node, hops: all that start(node) reaches along edges (or against them), itself at 0; to any
    distance, or to `hops`. Each round joins only what the last one found, less what is known. Steps and known nodes meet the
    front by shuffles: were they broadcast, the driver would hold them anew each round."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = cut_in_loop(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()).hint("merge")
    known = cut_in_loop(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front, hop = known, 0
    while hops is None or hop < hops:
        hop += 1
        new = front.join(steps, "node").select(F.col("next").alias("node")).distinct().join(known.hint("merge"), "node", "left_anti")
        front = cut_in_loop(new.withColumn("hops", F.lit(hop)))
        if not front.head(1):
            break
        known = cut_in_loop(known.unionByName(front)) if hop % 5 == 0 else known.unionByName(front)
    return known


def trimmed(edges: DataFrame) -> DataFrame:
    """edges less those of nodes without a way in or a way out, which lie on no cycle; four layers a job, while they are more than
    HELD."""
    now, size = edges, edges.count()
    while size > HELD:
        for _ in range(4):
            now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = cut_in_loop(now)
        n = now.count()
        if n == size:
            break
        size = n
    return now


def spread(colours: DataFrame, steps: DataFrame) -> DataFrame:
    """colours(node, colour): the least colour that reaches each node along steps(src, dst); three hops a job."""
    while True:
        now = colours
        for _ in range(3):
            come = steps.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            now = now.unionByName(come).groupBy("node").agg(F.min("colour").alias("colour"))
        now = cut_in_loop(now)
        if not now.join(colours.withColumnRenamed("colour", "was"), "node").filter("colour <> was").head(1):
            return now
        colours = now


def cycles(edges: DataFrame) -> DataFrame:
    """G4/G5. node, component: strongly connected components of more than one node, named by their least node.

    Tasks find the components of the edges that they hold, HELD at a time, wherever these lie; circles.py. Pieces whose nodes are
    in no other piece are done, so edges that lie by what they belong to are never shuffled. Of the others go on what a
    piece connects: edges between its components, and each component's nodes with its least one, there and back."""
    e = edges.filter("src <> dst").select("src", "dst")
    kind = e.select("src").union(e.select("dst")).schema["src"].dataType
    e = e.select(F.col("src").cast(kind), F.col("dst").cast(kind))
    told = cut_in_loop(circles_of(e))
    nodes = told.filter("NOT edge").select("piece", F.col("src").alias("node"), F.col("dst").alias("component"))
    shared = cut_in_loop(nodes.groupBy("node").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a <> b").select("node"))
    found = nodes.filter("component IS NOT NULL")
    if not shared.head(1):
        return found.select("node", "component")
    open_ = cut_in_loop(nodes.join(shared, "node", "left_semi").select("piece").distinct())
    rest = told.filter("dst IS NOT NULL AND src <> dst").join(open_, "piece", "left_semi")
    back = rest.filter("NOT edge").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rest = rest.select("src", "dst").unionByName(back).distinct()
    return found.join(open_, "piece", "left_anti").select("node", "component").unionByName(coloured(rest))


def circles_of(edges: DataFrame) -> DataFrame:
    """piece, src, dst, edge: what circles.py tells of each part of edges(src, dst)."""
    kind = edges.schema["src"].dataType
    return edges.mapInArrow(functools.partial(circles.parts, held=HELD), StructType([StructField("piece", LongType()), StructField("src", kind), StructField("dst", kind), StructField("edge", BooleanType())]))


def coloured(edges: DataFrame) -> DataFrame:
    """node, component as cycles gives them, of edges(src, dst) wherever they lie.

    Nodes on no cycle are trimmed. Then rounds of colouring: each node takes the least node that reaches it; within a
    colour, what reaches the node of that name back is its component. Edges between colours lie on no cycle and go. Nothing
    but edges and one row a node is ever held, whatever the components' sizes. HELD edges or fewer are left to one task."""
    now, out = trimmed(cut_in_loop(edges)), None
    while n := now.count():
        if n <= HELD:
            found = circles_of(now.repartition(1)).filter("NOT edge AND dst IS NOT NULL").select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return found if out is None else out.unionByName(found)
        nodes = now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))).distinct()
        colours = spread(nodes.withColumn("colour", F.col("node")), now)
        one, two = colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("d"))
        inside = cut_in_loop(now.join(one, "src").join(two, "dst").filter("c = d").select("src", "dst", F.col("c").alias("colour")))
        back = reach_within(inside, colours.filter("node = colour"))
        sizes = back.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        found = back.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        out = found if out is None else out.unionByName(found)
        rest = inside.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        now = trimmed(cut_in_loop(rest.select("src", "dst")))
    if out is None:
        return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return out


def reach_within(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges(src, dst, colour), start(node, colour) -> all nodes that reach start's of their colour, itself included."""
    known = front = cut_in_loop(start.select("node", "colour"))
    while True:
        new = front
        steps = None
        for _ in range(3):
            new = edges.join(new.withColumnRenamed("node", "dst"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            steps = new if steps is None else steps.unionByName(new)
        front = cut_in_loop(steps.distinct().join(known, ["node", "colour"], "left_anti"))
        if not front.head(1):
            return known
        known = cut_in_loop(known.unionByName(front))


def shortest_rings(edges: DataFrame, start: DataFrame, hops: int = 8) -> DataFrame:
    """G5/G6. node, ring: of each start node the shortest way along edges(src, dst) back to itself, of equally short ones the
    least in order; null beyond `hops`. A walk keeps one way a (start, place): the least of the shortest."""
    steps = edges.select("src", "dst").distinct()
    walk = start.select("node", F.col("node").alias("at"), F.array("node").alias("ring"))
    found = None
    for hop in range(hops):
        walk = walk.join(steps, F.col("at") == F.col("src")).select("node", F.col("dst").alias("at"), F.concat("ring", F.array("dst")).alias("ring"))
        walk = walk.groupBy("node", "at").agg(F.min("ring").alias("ring"))
        closed = walk.filter("at = node").select("node", "ring", F.lit(hop).alias("hop"))
        found = closed if found is None else found.unionByName(closed)
        walk = walk.filter("at <> node")
        if hop % 3 == 2:
            walk = cut_in_loop(walk)
    best = found.groupBy("node").agg(F.min_by("ring", "hop").alias("ring"))
    return start.select("node").distinct().join(best, "node", "left")


def communities(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """G10. node, label: synchronous label propagation over undirected weighted edges(src, dst, weight); each round a node
    takes the label of the greatest weight round it, ties to the smaller. (An asynchronous order is not reproducible in
    parallel; this is the defined form here.) Two rounds are one job. The result is that of all rounds: it ends early only
    where labels are those of two rounds ago, which an even number of rounds more brings back, settled or swinging."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = cut_in_loop(both)
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    while rounds:
        step, now = 2 - rounds % 2, labels  # an odd round goes first
        for _ in range(step):
            votes = both.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
            now = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label"))
        was, labels, rounds = labels, cut_in_loop(now), rounds - step
        if not labels.join(was.withColumnRenamed("label", "was"), "node").filter("label <> was").head(1):
            break
    return labels
