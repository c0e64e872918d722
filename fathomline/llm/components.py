"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few joins over the edges and is written to the shared folder, so lineage stays
short and a lost executor repeats one round.  Nothing but one number a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, work_dir


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either the child of one root or a root."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("root", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, *, name: str = "components") -> DataFrame:
    """From edges (a, b) of comparable ids: (node, root), root the least id of the node's component.

    Nodes without an edge to another node don't appear.  Null ends, loops and repeated edges count
    for nothing.  A hub's edges are aggregated before they are shuffled.  Least neighbours are written
    before they meet the edges: both sides of the join are then plain exchanges, and adaptive
    execution can split the partition that a hub fills.
    """
    folder = work_dir(edges.sparkSession, name)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("root")).distinct()
    now = materialise(now, f"{folder}/0")
    step = 0
    while not _is_forest_of_stars(now):
        step += 1
        both = now.unionAll(now.select("root", "child")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialise(least, f"{folder}/{step}/least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("root")).distinct()
        large = materialise(large, f"{folder}/{step}/large")
        least = materialise(large.groupBy("child").agg(F.min("root").alias("m")), f"{folder}/{step}/least-of-large")
        small = large.join(least, "child").select(F.explode(F.array(F.struct("child", F.col("m").alias("root")), F.struct(F.col("root").alias("child"), F.col("m").alias("root")))).alias("e")).select("e.*").filter("child <> root").distinct()
        now = materialise(small, f"{folder}/{step}/small")
    return now.select(F.col("child").alias("node"), "root").unionAll(now.select(F.col("root").alias("node"), "root").distinct())
